"""JSON lists on disk: a folder of files that are each one JSON list, read strictly and added to without repeating keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.collections_ import merge_keep
from vigilake.sources.store import file_system


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a JSON list, or of all lists in a folder. What is not JSON, or has a value of another type than the schema's, is an error; keys that are not there are null."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of a task (JSON texts) as the lines of one list."""
    start = "["
    for batch in batches:
        items = batch.column(0).to_pylist()
        if items:
            yield pa.record_batch([pa.array([start + items[0], *("," + x for x in items[1:])])], ["value"])
            start = ","
    yield pa.record_batch([pa.array(["[]" if start == "[" else "]"])], ["value"])


def write_list(items: DataFrame, path: str) -> None:
    """Replace a list by items: they are written to a new folder, which then takes the old one's name."""
    spark = items.sparkSession
    text = items.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex[:12]}" for kind in ("new", "old"))
    text.mapInArrow(_lists, "value string").write.text(new)
    fs, at = file_system(spark, path)
    _, new_at = file_system(spark, new)
    _, old_at = file_system(spark, old)
    had = fs.exists(at)
    if had and not fs.rename(at, old_at):
        raise OSError(f"{path} cannot be moved away")
    if not fs.rename(new_at, at):
        raise OSError(f"{new} holds the list, but cannot be moved to {path}")
    if had:
        fs.delete(old_at, True)


def merge_list(spark: SparkSession, path: str, new: DataFrame, key: str, order: str) -> int:
    """Add to the list at path those items of new whose key it does not have, the first of each in the order of its column `order`, which is no part of the items; returns how many.

    Items that are there stay, also with keys that the new ones do not have; a value of another type than the new ones' is an error. An
    absent list is an empty one. Merging again changes nothing, not even a file. A null key is a key like others; null values are not written.
    """
    fs, at = file_system(spark, path)
    fields = [f for f in new.schema.fields if f.name != order]
    there = fs.exists(at)
    old = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path) if there else spark.createDataFrame([], new.drop(order).schema)
    old = old.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields if f.name in old.columns})
    mark = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    names = list(dict.fromkeys([*old.columns, *(f.name for f in fields)]))
    none = {c: F.lit(None).cast(new.schema[c].dataType if c in new.columns else old.schema[c].dataType) for c in [*names, order]}
    full = lambda df, flag: df.withColumns({c: x for c, x in none.items() if c not in df.columns}).select(*names, order, mark.alias("__key"), F.lit(flag).alias("__old"))
    kept = merge_keep(full(old, True), full(new, False), "__key", order)
    added = kept.where("not __old").count()
    if added or not there:
        write_list(kept.select(names), path)
    return added
