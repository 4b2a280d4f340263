"""Shared helpers of the corpus operators: tables, size-checked joins, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.sources.store import save

#: A side with at most this many slim rows (ids or hashes) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Rows that go to a Python worker at a time, where the session leaves Spark's default: texts can be long.
ARROW_ROWS, ARROW_DEFAULT = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(key, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Edges that a task deals with at least, so that a small graph's rounds do not take every shuffle partition's task and file.
EDGES_A_TASK = 100_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star rounds.

    edges: columns a, b of one orderable type; self loops and repeated rows are allowed, rows with a null are left out.
    Returns (node, component) for every node that has an edge to another node; component is the smallest node.
    Every round has grouped minima, pre-aggregated, and joins with them. The minima are written to the shared folder
    before they are joined, so that the join has an exchange of its own and a node with very many neighbours can be split.
    """
    e = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for k in range(rounds + 1):
        rows = e.count()
        if not rows:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        tasks = rows // EDGES_A_TASK + 2
        # settled when every node has one edge, and none that is pointed at has an edge itself
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        unsettled = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").coalesce(tasks)
        if not unsettled.take(1):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        if k == rounds:
            break
        # large star: every neighbour above the node is hung on the node's least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = save(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(tasks), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        # small star: a node's lower neighbours and the node itself are hung on the least of them
        low = save(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "low")
        star = large.join(low, "a")
        e = save(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
