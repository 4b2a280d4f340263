"""Stop conditions and stuck flows over a whole log: what the stream in `streaming.watch` finds as it goes, found again in batch.

Both are sequences per target or flow. A log is cut into buckets of time, so that a target with a large share of all rows is
dealt over many tasks: totals of earlier buckets are added up from one row for each bucket, and what a row must see of the
bucket before it is handed over. Design-level extension.

Requests (target, request_id, at, kind, error): kind is start or finish; error counts on finishes, null is an error (what is
not known to have gone well). Rows without a target or a time take no part. Ties in time go by request_id, starts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: limits of the design
PER_SECOND, AT_ONCE, ERROR_SHARE = 2, 3, 0.02
CONDITIONS = ("rate", "concurrency", "error_rate")
#: Statuses after which a flow owes no progress.
ENDED = ("completed", "failed", "cancelled")
#: Milliseconds of a bucket.
BUCKET_MS = 3_600_000


def stop_conditions(requests: DataFrame, per_second: int = PER_SECOND, at_once: int = AT_ONCE, share: float = ERROR_SHARE, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(target, condition, at, request_id): the first request of each target that breaks each condition.

    rate: it starts within a second of the start `per_second` places before; concurrency: more than at_once are open after it;
    error_rate: more than this share of the target's finished requests were errors, from the first on.
    """
    rows = requests.where("target is not null and at is not null and kind in ('start', 'finish')")
    finish = F.col("kind") == "finish"
    rows = rows.select("target", "request_id", F.unix_millis("at").alias("ms"), finish.cast("int").alias("finish"), (finish & F.coalesce("error", F.lit(True))).cast("int").alias("error"))
    rows = rows.withColumn("bucket", F.expr(f"ms div {bucket_ms}"))
    place = ["ms", "finish", "request_id"]

    one = {"open": 1 - 2 * F.col("finish"), "done": F.col("finish"), "errors": F.col("error")}
    sums = rows.groupBy("target", "bucket").agg(*(F.sum(x).alias(f"{k}_all") for k, x in one.items()))
    earlier = Window.partitionBy("target").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("target", "bucket", *(F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_before") for k in one))
    so_far = Window.partitionBy("target", "bucket").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.join(before, ["target", "bucket"]).select("target", "request_id", "ms", "finish", *((F.sum(x).over(so_far) + F.col(f"{k}_before")).alias(k) for k, x in one.items()))
    broken = F.array(F.when((F.col("finish") == 0) & (F.col("open") > at_once), "concurrency"), F.when((F.col("finish") == 1) & (F.col("errors") > share * F.col("done")), "error_rate"))
    found = counted.select("target", "request_id", "ms", "finish", F.explode(F.array_compact(broken)).alias("condition"))

    # starts of a bucket's last second stand in the next bucket as well, where they count for others only
    starts = rows.where("finish = 0").select("target", "request_id", "ms", F.explode(F.array_distinct(F.array("bucket", F.expr(f"(ms + 1000) div {bucket_ms}")))).alias("in"), "bucket")
    back = F.lag("ms", per_second).over(Window.partitionBy("target", "in").orderBy("ms", "request_id"))
    fast = starts.withColumn("back", back).where((F.col("in") == F.col("bucket")) & (F.col("ms") - F.col("back") < 1000))
    found = found.unionByName(fast.select("target", "request_id", "ms", F.lit(0).alias("finish"), F.lit("rate").alias("condition")))
    first = found.groupBy("target", "condition").agg(F.min(F.struct(*place)).alias("f"))
    return first.select("target", "condition", F.timestamp_millis("f.ms").alias("at"), "f.request_id")


def stuck_flows(changes: DataFrame, limit_ms: int, as_of: Column | None = None, bucket_ms: int = 24 * BUCKET_MS) -> DataFrame:
    """(flow_id, status, since, noticed): every time a flow made no progress for longer than the limit.

    changes (flow_id, at, status): what counts as progress. A gap begins at a change to a status that is not one of ENDED, and is
    noticed limit_ms later; the last change of a flow counts if as_of (default: the log's last time) is beyond that. Of changes
    of one time, the greatest status is the last.
    """
    rows = changes.where("flow_id is not null and at is not null").groupBy("flow_id", F.unix_millis("at").alias("ms")).agg(F.max("status").alias("status"))
    rows = rows.withColumn("bucket", F.expr(f"ms div {bucket_ms}"))
    now = rows.agg(F.max("ms").alias("now")) if as_of is None else rows.sparkSession.range(1).select(F.unix_millis(as_of).alias("now"))
    rows = rows.crossJoin(F.broadcast(now)).where("ms <= now")  # now: one row
    edges = rows.groupBy("flow_id", "bucket").agg(F.min("ms").alias("first"))
    edges = edges.select("flow_id", "bucket", F.lead("first").over(Window.partitionBy("flow_id").orderBy("bucket")).alias("later"))
    within = F.lead("ms").over(Window.partitionBy("flow_id", "bucket").orderBy("ms"))
    gaps = rows.withColumn("next", within).join(edges, ["flow_id", "bucket"])
    until = F.coalesce("next", "later", "now")
    open_ = ~F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    return gaps.where(open_ & (until - F.col("ms") > limit_ms)).select("flow_id", "status", F.timestamp_millis("ms").alias("since"), F.timestamp_millis(F.col("ms") + limit_ms).alias("noticed"))
