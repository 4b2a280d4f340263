"""Stop conditions and stuck flows: the stream, cut into batches and restarted, against the batch and against plain loops."""

import random
import zlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vigilake.operators import stops
from vigilake.streaming import watch

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
REQUESTS, CHANGES = "target string, request_id string, at timestamp, kind string, error boolean", "flow_id string, at timestamp, status string"


def requests(seed=1):
    """Calm, fast, crowded and failing targets; ties, rows of unknown outcome, and rows that are left out."""
    rng, out = random.Random(seed), []
    for t, (step, length, bad) in {"calm": (4000, 900, 0), "fast": (450, 100, 0), "crowded": (1500, 7000, 0), "failing": (3000, 500, 0.05), "all": (300, 4000, 0.5), "late": (2000, 10, 0)}.items():
        ms = 3_595_000
        for i in range(120):
            ms += step + rng.choice([0, 0, 1, 400]) if t != "late" or i < 100 else 200
            end, rid = ms + length, f"{t}-{i:03d}"
            out += [(t, rid, BASE + timedelta(milliseconds=ms), "start", None), (t, rid, BASE + timedelta(milliseconds=end), "finish", None if rng.random() < bad / 3 else rng.random() < bad)]
    return [*out, (None, "x", BASE, "start", None), ("calm", "y", None, "start", None), ("calm", "z", BASE, "other", None), ("ties", "b", BASE, "start", None), ("ties", "a", BASE, "start", None), ("ties", "c", BASE, "start", None), ("ties", "c", BASE, "finish", True)]


def replayed(rows):
    out, state = {}, {}
    for t, rid, at, kind, error in sorted((r for r in rows if r[0] and r[2] and r[3] != "other"), key=lambda r: (r[2], r[3] == "finish", r[1])):
        s = state.setdefault(t, {"open": 0, "done": 0, "bad": 0, "starts": []})
        if kind == "start":
            s["open"] += 1
            s["starts"].append(at)
            if s["open"] > 3:
                out.setdefault((t, "concurrency"), (at, rid))
            if len(s["starts"]) > 2 and at - s["starts"][-3] < timedelta(seconds=1):
                out.setdefault((t, "rate"), (at, rid))
        else:
            s["open"], s["done"], s["bad"] = s["open"] - 1, s["done"] + 1, s["bad"] + (error is not False)
            if s["bad"] > 0.02 * s["done"]:
                out.setdefault((t, "error_rate"), (at, rid))
    return {(t, c, at, rid) for (t, c), (at, rid) in out.items()}


def changes(seed=2):
    rng, out = random.Random(seed), []
    for k in range(12):
        at = BASE + timedelta(hours=k)
        for i in range(30):
            at += timedelta(minutes=rng.choice([1, 5, 9, 10, 11, 40]))
            out.append((f"F{k}", at, rng.choice(["running", "waiting", None, "completed"])))
            if rng.random() < 0.1:
                out.append((f"F{k}", at, "completed"))
        if k % 3 == 0:
            out.append((f"F{k}", at + timedelta(minutes=3), "completed"))
    return [*out, (None, BASE, "running"), ("F1", None, "running"), ("END", BASE + timedelta(days=3), "completed")]


def silent(rows, limit, now):
    by = {}
    for f, at, status in rows:
        if f and at and at <= now:
            by.setdefault(f, {}).setdefault(at, []).append(status)
    for f, each in by.items():
        times = sorted(each)
        for at, after in zip(times, [*times[1:], now]):
            status = max((s for s in each[at] if s is not None), default=None)
            if after - at > limit and status not in stops.ENDED:
                yield (f, status, at, at + limit)


def utc(rows):
    return {tuple(x.astimezone(timezone.utc) if isinstance(x, datetime) else x for x in r) for r in rows}


def streamed(spark, tmp_path, rows, schema, make):
    """The rows come in four folders' worth of files, out of order by some minutes; the query is stopped and started again between them."""
    rows = sorted(rows, key=lambda r: ((r[2] if isinstance(r[2], datetime) else r[1] if isinstance(r[1], datetime) else None) or BASE) + timedelta(minutes=zlib.crc32(repr(r).encode()) % 7))
    cut = len(rows) // 4 + 1
    for k in range(4):
        part = spark.createDataFrame(rows[k * cut : (k + 1) * cut], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    out = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(out) == len(set(out))
    return utc(out)


@pytest.mark.parametrize("bucket", [stops.BUCKET_MS, 2000])
def test_stops_in_batch(spark, bucket):
    rows = requests()
    got = stops.stop_conditions(spark.createDataFrame(rows, REQUESTS).repartition(3), bucket_ms=bucket).select("target", "condition", "at", "request_id")
    assert utc(map(tuple, got.collect())) == replayed(rows) and len({c for _, c, *_ in replayed(rows)}) == 3
    assert stops.stop_conditions(spark.createDataFrame([], REQUESTS)).collect() == []


def test_stops_on_a_stream(spark, tmp_path):
    rows = [*requests(), ("end", "e", BASE + timedelta(days=1), "start", None)]  # moves the watermark beyond all others
    assert streamed(spark, tmp_path, rows, REQUESTS, lambda s: watch.stop_stream(s, "10 minutes")) == replayed(rows)


@pytest.mark.parametrize("bucket", [stops.BUCKET_MS, 60_000])
def test_stuck_in_batch(spark, bucket):
    rows, limit = changes(), timedelta(minutes=10)
    got = stops.stuck_flows(spark.createDataFrame(rows, CHANGES).repartition(3), 600_000, bucket_ms=bucket)
    assert utc(map(tuple, got.collect())) == set(silent(rows, limit, BASE + timedelta(days=3)))
    now = BASE + timedelta(hours=8)
    got = stops.stuck_flows(spark.createDataFrame(rows, CHANGES), 600_000, F.lit(now), bucket)
    assert utc(map(tuple, got.collect())) == set(silent(rows, limit, now))


def test_stuck_on_a_stream(spark, tmp_path):
    """Timers tell of flows for which nothing arrives any more."""
    rows, limit = changes(), timedelta(minutes=10)
    got = streamed(spark, tmp_path, rows, CHANGES, lambda s: watch.stuck_stream(s, 600_000, "20 minutes"))
    assert got == set(silent(rows, limit, BASE + timedelta(days=3) - timedelta(minutes=20)))
