"""A streaming front end: raw lines as they arrive, parsed by the same expressions, counted in windows with late data cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.knowledge import MONTHS, YEAR, lookup
from vigilake.operators.design import windowed_counts
from vigilake.operators.normalize import SSH


def auth_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files dropped into a folder, as failed logins (ts, key)."""
    return auth_events(spark.readStream.text(folder).withColumnRenamed("value", "line"))


def auth_events(lines: DataFrame) -> DataFrame:
    """Failed logins (ts, key) of lines; works on a batch as on a stream."""
    part = lambda k: F.regexp_extract("line", SSH, k)
    month = lookup(part(1), {m: i for i, m in enumerate(MONTHS, 1)})
    ts = F.to_timestamp(F.format_string("%04d-%02d-%02d %s", F.lit(YEAR), month, part(2).cast("int"), part(3)))
    found = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(SSH))
    return found.select(ts.alias("ts"), F.concat_ws(":", F.lit("ssh_failed_password"), part(4), part(6)).alias("key"))


def counted(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and window; windows close when the watermark passes them."""
    return windowed_counts(events.withWatermark("ts", late), width)


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of events of one key, ended by a gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def without_repeats(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """events (ts, ...) of a stream without rows that repeat the keys of one that came before, as collectors send them again.

    A row is known for as long as lateness lets a repetition arrive, so that state is bounded; what is later than that is left out.
    ts should be among the keys: then the result is that of `dropDuplicates` on the whole log, but for rows that come too late.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
