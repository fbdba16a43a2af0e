"""sievework: curation analytics for annotated samples, expressed as Spark DataFrame plans."""
