"""Replay: sources rebuilt from evidence, and two runs compared collection by collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import content_hash


def integrity(evidence: DataFrame, vault: DataFrame) -> DataFrame:
    """Each evidence row with intact: its blob is there and hashes to its key."""
    joined = evidence.join(vault.withColumnRenamed("ref", "storage_ref").withColumnRenamed("data", "blob"), "storage_ref", "left")
    return joined.withColumn("intact", F.coalesce(content_hash(F.col("blob")) == F.col("storage_ref"), F.lit(False)))


def rebuilt_sources(evidence: DataFrame, vault: DataFrame) -> DataFrame:
    """The sources that evidence came from; fails on a blob that is missing or damaged."""
    found = integrity(evidence.drop("data"), vault)
    data = F.when(F.col("intact"), F.col("blob")).otherwise(F.raise_error(F.concat(F.lit("evidence is damaged: "), "evidence_id")).cast("binary"))
    return found.select(F.col("source").alias("name") if "source" in found.columns else "name", "source_type", "media_type", "source_ord", "file_no", data.alias("data"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (n, high, low): the number of rows, and sums of two 60-bit parts of their hashes.

    Equal collections have equal fingerprints, whatever their order and partitioning, repeated rows included; a row's hash is that of
    its canonical JSON (columns by name, nulls kept).
    """
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substr("h", F.lit(at), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), part(1).alias("high"), part(16).alias("low"))


def difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """One row: the collection, how many rows are on one side only, and whether it is equal; order and partitioning do not matter."""
    columns = sorted(left.columns)
    only = left.select(columns).exceptAll(right.select(columns)).agg(F.count("*").alias("only_left")).crossJoin(right.select(columns).exceptAll(left.select(columns)).agg(F.count("*").alias("only_right")))
    return only.select(F.lit(name).alias("collection"), "only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def compare(a, b, collections: tuple[str, ...]) -> DataFrame:
    """A row as of `difference` for each collection. One aggregate tells which are equal; rows are compared only where fingerprints differ."""
    sides = {name: [getattr(x, name).drop("data") for x in (a, b)] for name in collections}
    prints = reduce(DataFrame.unionByName, [fingerprint(df).select(F.lit(name).alias("name"), F.lit(k).alias("side"), F.struct("n", "high", "low").alias("f")) for name, both in sides.items() for k, df in enumerate(both)])
    found = {(r.name, r.side): tuple(r.f) for r in prints.collect()}  # two rows for each collection
    equal = [name for name in collections if found[name, 0] == found[name, 1] and sorted(sides[name][0].columns) == sorted(sides[name][1].columns)]
    spark = sides[collections[0]][0].sparkSession
    out = spark.createDataFrame([(name, 0, 0, True) for name in equal], "collection string, only_left long, only_right long, equal boolean")
    return reduce(DataFrame.unionByName, [difference(*sides[name], name) for name in collections if name not in equal], out)
