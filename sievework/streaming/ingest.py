"""Continuous ingestion that adds each path once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "path"):
    """Streams Parquet files from `source` into `target`; rows whose key it has already stay out.

    Runs over what is there and ends. A repeated run, or a batch repeated after a failure, adds nothing. Each
    batch reads the target's keys alone.
    """

    def there(path: str) -> bool:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        if there(target):  # not yet with the first batch
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
