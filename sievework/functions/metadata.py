"""Typed access to JSON metadata columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"([^.\[\]]+)|\[(-?\d+)\]")


def at_path(data: Column, path: str) -> Column:
    """Text at a path such as a.b[0] or a[-1] of a JSON string column; null where there is none."""
    here = data
    for name, index in _STEP.findall(path):
        if name:
            here = F.get_json_object(here, "$['" + name.replace("'", "\\'") + "']")
        elif int(index) >= 0:
            here = F.get_json_object(here, f"$[{index}]")
        else:
            size = F.json_array_length(here)
            items = F.from_json(here, "array<string>")
            here = F.when(size >= -int(index), F.element_at(items, int(index)))
    return here


def at_key(data: Column, key: str) -> Column:
    """Text under a literal top-level key, whatever characters it has."""
    return F.from_json(data, "map<string,string>")[key]


def compare(data: Column, path: str, op: str, value) -> Column:
    """path <op> value: numbers as doubles, booleans and the rest as text."""
    text = at_path(data, path)
    if isinstance(value, bool):
        left, right = F.lower(text), F.lit(str(value).lower())
    elif isinstance(value, (int, float)):
        left, right = text.try_cast("double"), F.lit(float(value))
    else:
        left, right = text, F.lit(value)
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def is_in(data: Column, key: str, values: list) -> Column:
    """The literal key's value is among `values`; a None among them also takes missing values."""
    text = at_key(data, key)
    wanted = [str(v).lower() if isinstance(v, bool) else v for v in values if v is not None]
    test = F.coalesce(text.isin(wanted), F.lit(False)) if wanted else F.lit(False)
    return test | text.isNull() if None in values else test


def sort_keys(data: Column, path: str, descending: bool = False) -> list[Column]:
    """Order by the number at the path, then by its text, nulls last either way."""
    text = at_path(data, path)
    keys = [text.try_cast("double"), text]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def key_info(rows: DataFrame, data: str) -> DataFrame:
    """(key, n, low, high) of the top-level keys: rows that have it, and bounds if all its values are numbers."""
    pairs = rows.select(F.explode(F.from_json(F.col(data), "map<string,string>")).alias("key", "value")).where(F.col("value").isNotNull())
    number = F.col("value").try_cast("double")
    numeric = F.count(number) == F.count("value")
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.when(numeric, F.min(number)).alias("low"), F.when(numeric, F.max(number)).alias("high"))


def kind_of(raw: Column) -> Column:
    """The type of a JSON text: string, boolean, integer, float, list or dict; null for JSON's null and for none."""
    head = F.substring(raw, 1, 1)
    return (
        F.when(head == '"', "string")
        .when(raw.isin("true", "false"), "boolean")
        .when(head == "[", "list")
        .when(head == "{", "dict")
        .when(raw.rlike(r"^-?\d+$"), "integer")
        .when(raw.rlike(r"^-?\d"), "float")
    )


def raw_entries(data: Column) -> Column:
    """Map of an object's top-level keys to their values' JSON texts, numbers and nesting as they are.

    A variant keeps types, which a map of strings would not.
    """
    held = F.from_json(data, "map<string,variant>")
    return F.transform_values(held, lambda _, v: F.to_json(v))


def typed(data: Column, key: str, kind: str) -> Column:
    """The value under a literal key as a Spark type; fails on a value of another type than `kind`, null if missing.

    kind: string, boolean, integer or float (an integer counts as one).
    """
    raw = raw_entries(data)[key]
    found = kind_of(raw)
    fits = found.isNull() | (found == kind) | (F.lit(kind == "float") & (found == "integer"))
    target = {"string": "string", "boolean": "boolean", "integer": "bigint", "float": "double"}[kind]
    value = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"array<{target}>"), F.lit(0))
    return F.when(raw.isNull() | found.isNull(), F.lit(None).cast(target)).when(fits, value).otherwise(F.raise_error(F.concat(F.lit(f"{key} is no {kind}: "), raw)).cast(target))


def key_types(rows: DataFrame, data: str) -> DataFrame:
    """(key, kind, kinds) of the top-level keys: the pinned type, or `mixed`; integers among floats are floats."""
    each = rows.select(F.explode(raw_entries(F.col(data))).alias("key", "raw")).select("key", kind_of(F.col("raw")).alias("kind")).where("kind IS NOT NULL")
    held = each.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    pinned = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.col("kinds") == F.array(F.lit("float"), F.lit("integer")), "float").otherwise("mixed")
    return held.select("key", pinned.alias("kind"), "kinds")


def key_histograms(rows: DataFrame, data: str, bins: int = 10) -> DataFrame:
    """(key, bin, n): equal bins between the bounds of every key whose values all are numbers; empty bins are left out."""
    each = rows.select(F.explode(raw_entries(F.col(data))).alias("key", "raw")).select("key", kind_of(F.col("raw")).alias("kind"), F.col("raw").try_cast("double").alias("v")).where("kind IS NOT NULL")
    limits = each.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("kind").isin("integer", "float")).alias("numbers")).where("numbers")
    place = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    return each.join(limits, "key").groupBy("key", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def violations(old: DataFrame, new: DataFrame, data: str) -> DataFrame:
    """(key, kind, found): keys for which `new` has values of another type than `old` pinned; integers pass for floats."""
    pinned = key_types(old, data).select("key", "kind")
    found = key_types(new, data).select("key", F.explode("kinds").alias("found"))
    return found.join(pinned, "key").where((F.col("found") != F.col("kind")) & ~((F.col("kind") == "float") & (F.col("found") == "integer"))).select("key", "kind", "found")


def upsert(old: DataFrame, new: DataFrame, key: str, data: str) -> DataFrame:
    """Per-key merge of JSON objects by row key; values of `new` win, and every value keeps its type.

    Both must be persisted or cheap: `violations` says beforehand which keys would change their type.
    Rows of one side alone keep their text. Of values merged, numbers, booleans, nested objects and
    strings are spliced as JSON texts, keys in alphabetical order.
    """
    a = old.select(key, F.col(data).alias("__a"))
    b = new.select(key, F.col(data).alias("__b"))
    both = a.join(b, key, "full")
    empty = F.expr("map()").cast("map<string,string>")
    left, right = F.coalesce(raw_entries(F.col("__a")), empty), F.coalesce(raw_entries(F.col("__b")), empty)
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    entries = F.array_sort(F.map_entries(F.map_concat(rest, right)))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'^\{"k":(.*)\}$', 1)
    spliced = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    merged = F.when(F.col("__b").isNull(), F.coalesce("__a", F.lit("{}"))).when(F.col("__a").isNull(), F.col("__b")).otherwise(spliced)
    return both.select(key, merged.alias(data))
