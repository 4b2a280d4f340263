"""Watching running jobs: a target's stop conditions as they are broken, and flows that make no progress, on event time.

Rows of one key are held until the watermark has passed them and are then looked at in order, so that a stream finds what
`operators.stops` finds in the finished log, however its rows were cut into batches and whatever order they came in (rows
later than the watermark are left out). State per key: the rows that wait, which lateness bounds, and a few numbers. Each stop
is given once; after a restart from the checkpoint the watch goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.stops import AT_ONCE, ENDED, ERROR_SHARE, PER_SECOND

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_state(spark: SparkSession) -> None:
    """Timers and lists in state need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Gives rows of a key to `step` in the order of `place` once the watermark has passed their ms; `quiet` is asked when a time has come at which nothing happened."""

    WAITING, NOTED = "", ""  # schemas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.noted = handle.getValueState("noted", self.NOTED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        new = [tuple(r[c] for c in self.FIELDS) for r in rows]
        first = min(r[0] for r in new)
        self.waiting.appendList(new)
        if first not in set(self.handle.listTimers()):
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted((r for r in every if r[0] <= now), key=self.place), [r for r in every if r[0] > now]
        noted = list(self.noted.get()) if self.noted.exists() else self.begin()
        out = [x for r in due for x in self.step(key[0], noted, r)] + self.quiet(key[0], noted, now)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        self.noted.update(tuple(noted))
        wake = min([r[0] for r in later] + [t for t in (self.wake(noted),) if t is not None and t > now], default=None)
        if wake is not None:
            self.handle.registerTimer(wake)
        return iter(out)

    def quiet(self, key, noted: list, now: int) -> list[Row]:
        return []

    def wake(self, noted: list) -> int | None:
        return None

    def close(self) -> None:
        pass


class StopWatch(_InOrder):
    """noted: open, done, errors, the last starts, and which conditions have been broken."""

    FIELDS = ("ms", "finish", "request_id", "error")
    WAITING = "ms long, finish int, request_id string, error int"
    NOTED = "open long, done long, errors long, starts array<long>, broken array<string>"

    def __init__(self, per_second: int, at_once: int, share: float):
        self.per_second, self.at_once, self.share = per_second, at_once, share

    @staticmethod
    def place(r: tuple):
        return r[:3]

    @staticmethod
    def begin() -> list:
        return [0, 0, 0, [], []]

    def step(self, key, noted: list, r: tuple) -> list[Row]:
        ms, finish, request_id, error = r
        open_, done, errors, starts, broken = noted
        starts, now = list(starts), []
        if finish:
            open_, done, errors = open_ - 1, done + 1, errors + error
            now += ["error_rate"] * (errors > self.share * done)
        else:
            open_ += 1
            now += ["concurrency"] * (open_ > self.at_once)
            now += ["rate"] * (len(starts) == self.per_second and ms - starts[0] < 1000)
            starts = [*starts, ms][-self.per_second :]
        now = [c for c in now if c not in broken]
        noted[:] = [open_, done, errors, starts, [*broken, *now]]
        return [Row(target=key, condition=c, ms=ms, request_id=request_id) for c in now]


class ProgressWatch(_InOrder):
    """noted: the last change's time and status, and whether its silence has been told."""

    FIELDS = ("ms", "status")
    WAITING = "ms long, status string"
    NOTED = "ms long, status string, told boolean"

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    @staticmethod
    def place(r: tuple):
        return (r[0], r[1] is not None, r[1] or "")

    @staticmethod
    def begin() -> list:
        return [None, None, True]

    def step(self, key, noted: list, r: tuple) -> list[Row]:
        out = [] if r[0] == noted[0] else self.quiet(key, noted, r[0])
        noted[:] = [r[0], r[1] if r[0] != noted[0] or r[1] is not None else noted[1], r[1] in ENDED]
        return out

    def quiet(self, key, noted: list, now: int) -> list[Row]:
        ms, status, told = noted
        if told or now - ms <= self.limit_ms:
            return []
        noted[2] = True
        return [Row(flow_id=key, status=status, ms=ms)]

    def wake(self, noted: list) -> int | None:
        return None if noted[2] else noted[0] + self.limit_ms + 1


def stop_stream(requests: DataFrame, late: str = "10 minutes", per_second: int = PER_SECOND, at_once: int = AT_ONCE, share: float = ERROR_SHARE) -> DataFrame:
    """(target, condition, at, request_id) of a stream of requests (target, request_id, at, kind, error), as `stops.stop_conditions` has them, each given once when it is broken."""
    _keyed_state(requests.sparkSession)
    finish = F.col("kind") == "finish"
    rows = requests.withWatermark("at", late).where("target is not null and at is not null and kind in ('start', 'finish')")
    rows = rows.select("target", "at", F.unix_millis("at").alias("ms"), finish.cast("int").alias("finish"), F.col("request_id").cast("string").alias("request_id"), (finish & F.coalesce("error", F.lit(True))).cast("int").alias("error"))
    found = rows.groupBy("target").transformWithState(StopWatch(per_second, at_once, share), "target string, condition string, ms long, request_id string", "append", "eventTime")
    return found.select("target", "condition", F.timestamp_millis("ms").alias("at"), "request_id")


def stuck_stream(changes: DataFrame, limit_ms: int, late: str = "10 minutes") -> DataFrame:
    """(flow_id, status, since, noticed) of a stream of changes (flow_id, at, status), as `stops.stuck_flows` has them: given when the watermark passes the limit, though nothing arrives for the flow."""
    _keyed_state(changes.sparkSession)
    rows = changes.withWatermark("at", late).where("flow_id is not null and at is not null").select("flow_id", "at", F.unix_millis("at").alias("ms"), "status")
    found = rows.groupBy("flow_id").transformWithState(ProgressWatch(limit_ms), "flow_id string, status string, ms long", "append", "eventTime")
    return found.select("flow_id", "status", F.timestamp_millis("ms").alias("since"), F.timestamp_millis(F.col("ms") + limit_ms).alias("noticed"))
