"""Keyed collections: upsert, lookup, listing, merges that keep what is there, conditional text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_written(writes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last write of each key, with first_seq, the place of its first (a list in order of insertion keeps that place)."""
    w = Window.partitionBy(key)
    return writes.withColumns({"first_seq": F.min(seq).over(w), "__n": F.row_number().over(w.orderBy(F.desc(seq)))}).where("__n = 1").drop("__n")


def get(collection: DataFrame, key: str, value: str) -> DataFrame:
    return collection.where(F.col(key) == value)


def listed(collection: DataFrame, by: str) -> DataFrame:
    """In order of the key's text, or of insertion (first_seq)."""
    return collection.orderBy(by)


def documents(collection: DataFrame, key: str) -> DataFrame:
    """(obj_id, doc): each row as a JSON document, nulls kept."""
    return collection.select(F.col(key).alias("obj_id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("doc"))


def merge_keep(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing and those rows of new whose key it does not have, the first of each; applying it again changes nothing."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def append_once(text: Column, marker: str, addition: str, separator: str = "\n") -> Column:
    """text with the addition, unless it has the marker already."""
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, F.lit(separator + addition)))
