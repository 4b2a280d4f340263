"""Grouping and scoring: alerts with one dedup key are one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.knowledge import ASSET_CRITICALITY, BANDS, CRITICALITY_BONUS, SEVERITY_WEIGHT, lookup
from vigilake.functions.text import BUCKET, number, numbered
from vigilake.sources.store import save


def weight(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT, F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce(severity, F.lit("null")))).cast("int"))


def score(severity: Column, count: Column, asset: Column) -> Column:
    criticality = lookup(asset, ASSET_CRITICALITY, F.lit("low"))
    return F.least(F.lit(100), weight(severity) + F.least(count, F.lit(5)) * 5 + lookup(criticality, CRITICALITY_BONUS)).cast("int")


def band(score_: Column) -> Column:
    out = F.when(F.lit(False), "")
    for least, name in BANDS:
        out = out.when(score_ >= least, name)
    return out.otherwise("informational")


#: Lists of alerts and evidence are made for groups of so many alerts; larger ones have theirs in `members` and `evidence` alone.
LISTED = 1000


def evidence(alerts: DataFrame) -> DataFrame:
    """The evidence of every group, whole: distinct (dedup_key, evidence_id)."""
    return alerts.select("dedup_key", F.explode("evidence_ids").alias("evidence_id")).distinct()


def evidence_lists(backed: DataFrame, key: str) -> DataFrame:
    """(key, evidence_ids): all evidence of each key in order, whole at any size, from distinct (key, evidence_id)."""
    return backed.groupBy(key).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def members(alerts: DataFrame) -> DataFrame:
    """Every alert (dedup_key, seq, alert_id, evidence_ids) with its place in its group, from 1 on.

    A group is numbered bucket by bucket, so that one with a large share of all alerts is dealt over many tasks.
    """
    rows = alerts.select("dedup_key", "seq", "alert_id", "evidence_ids", F.floor(F.col("seq") / BUCKET).alias("__b"))
    sizes = rows.groupBy("dedup_key", "__b").agg(F.count("*").alias("__n"))
    before = sizes.select("dedup_key", "__b", (F.sum("__n").over(Window.partitionBy("dedup_key").orderBy("__b")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("dedup_key", "__b").orderBy("seq")) + F.col("__before")
    return rows.join(before, ["dedup_key", "__b"]).withColumn("place", place).drop("__b", "__before")


def group(alerts: DataFrame) -> DataFrame:
    """One row per dedup key, numbered by its first alert, over all its alerts and evidence; what these are is in `members` and `evidence`."""
    backed = evidence(alerts).groupBy("dedup_key").agg(F.count("*").alias("evidence_count"))
    grouped = alerts.groupBy("dedup_key").agg(
        F.min_by("signature", "seq").alias("signature"), F.min_by("asset_id", "seq").alias("asset_id"), F.max_by("severity", weight(F.col("severity"))).alias("severity"), F.count("*").cast("int").alias("count"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.min("seq").alias("first_seq"))
    grouped = save(grouped.join(backed, "dedup_key", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long"))), "grouped")
    out = numbered(grouped, ["first_seq"], F.floor(F.col("first_seq") / BUCKET), "group_no").withColumn("risk_score", score(F.col("severity"), F.col("count"), F.col("asset_id")))
    return out.select(number("AG", F.col("group_no")).alias("group_id"), "group_no", "dedup_key", "signature", "asset_id", "severity", "count", "evidence_count", "first_seen", "last_seen", "risk_score", band(F.col("risk_score")).alias("risk_band"))


def with_lists(groups: DataFrame, alerts: DataFrame, most: int = LISTED) -> DataFrame:
    """groups with alert_ids and evidence_ids as lists, for reports: whole, or null for a group of more than `most` alerts. No list is ever cut."""
    few = groups.where(F.col("count") <= most).select("dedup_key")
    mine = alerts.select("dedup_key", "seq", "alert_id", "evidence_ids").join(few, "dedup_key", "left_semi")
    lists = mine.groupBy("dedup_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "alert_id"))), lambda x: x["alert_id"]).alias("alert_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias("evidence_ids"))
    return groups.join(lists, "dedup_key", "left")
