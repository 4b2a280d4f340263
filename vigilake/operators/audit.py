"""Audit: events chained by hash within each chain, verified for all chains at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions.text import canonical_json, content_hash

GENESIS = "sha256:" + "0" * 64
FIELDS = ("actor", "event_id", "event_type", "flow_id", "payload", "recorded_at", "subject_ref")


def _value(x: Column) -> Column:
    """A field as a JSON value."""
    whole = canonical_json(x=x)
    return F.substr(whole, F.lit(6), F.length(whole) - 6)  # what stands after {"x": and before }


def entry_hash(field, prev: Column) -> Column:
    """The hash of an event: its fields in alphabetical order as JSON, with the hash before it. payload is JSON itself."""
    body = {c: _value(field(c)) for c in FIELDS if c != "payload"}
    parts = []
    for c in sorted((*FIELDS, "prev_hash")):
        value = field("payload") if c == "payload" else F.concat(F.lit('"'), prev, F.lit('"')) if c == "prev_hash" else body[c]
        parts += [F.lit(("," if parts else "{") + f'"{c}":'), value]
    return content_hash(F.concat(*parts, F.lit("}")))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of whole chains in order with event_id, prev_hash and entry_hash; of a chain only its last hash is held."""
    chain, n, last = None, 0, GENESIS
    for batch in batches:
        ids, before, after = [], [], []
        for at, a, b, c, so_far, head in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("chain_id", "__a", "__b", "__c", "__n", "__head")), strict=True):
            if at != chain:
                chain, n, last = at, so_far or 0, head or GENESIS
            n += 1
            ids.append(f"AUD-{n:04d}")
            before.append(last)
            last = "sha256:" + sha256(f'{a}"{ids[-1]}"{b}"{last}"{c}'.encode()).hexdigest()
            after.append(last)
        columns = [batch.column(k) for k, name in enumerate(batch.schema.names) if not name.startswith("__")]
        names = [name for name in batch.schema.names if not name.startswith("__")]
        yield pa.record_batch([*columns, pa.array(ids, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "event_id", "prev_hash", "entry_hash"])


def chained(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """events (chain_id, seq, actor, event_type, flow_id, subject_ref, payload, recorded_at) with event_id, prev_hash and entry_hash.

    heads (chain_id, events, head): chains that are there already, of so many events, and that go on from their head; others begin.

    A chain is a sequence by its nature: chains go side by side, each followed in order in one task, which holds no more than its last hash.
    The JSON is made before by built-in functions, in three pieces around event_id and prev_hash, so that a row costs one hash.
    """
    json = {c: F.col("payload") if c == "payload" else _value(F.col(c)) for c in FIELDS if c != "event_id"}
    piece = lambda start, names, end: F.concat(F.lit(start), *(x for i, c in enumerate(names) for x in (F.lit(("," if i or start != "{" else "") + f'"{c}":'), json[c])), F.lit(end))
    rows = events.select("chain_id", "seq", "actor", "event_type", "flow_id", "payload", "recorded_at", "subject_ref", piece("{", ["actor"], ',"event_id":').alias("__a"), piece("", ["event_type", "flow_id", "payload"], ',"prev_hash":').alias("__b"), piece("", ["recorded_at", "subject_ref"], "}").alias("__c"))
    if heads is None:
        rows = rows.withColumns({"__n": F.lit(None).cast("long"), "__head": F.lit(None).cast("string")})
    else:
        rows = rows.join(heads.select("chain_id", F.col("events").alias("__n"), F.col("head").alias("__head")), "chain_id", "left")
    schema = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__")] + [T.StructField(c, T.StringType()) for c in ("event_id", "prev_hash", "entry_hash")])
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq").mapInArrow(_follow, schema)


def verified(events: DataFrame) -> DataFrame:
    """Each event with ok: its own hash holds and it names the hash before it."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("chain_id").orderBy("seq")), F.lit(GENESIS))
    return events.withColumn("ok", (entry_hash(F.col, before) == F.col("entry_hash")) & (F.col("prev_hash") == before))


def chain_state(events: DataFrame) -> DataFrame:
    """One row per chain: intact, the first broken place, and the anchor (events, head) that shows a cut tail."""
    v = verified(events)
    return v.groupBy("chain_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("intact"), F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("seq"))).alias("first_broken"), F.count("*").alias("events"), F.max_by("entry_hash", "seq").alias("head"))


def heads(events: DataFrame) -> DataFrame:
    """(chain_id, events, head, last_seq): where each chain of hashed events ends."""
    return events.groupBy("chain_id").agg(F.count("*").alias("events"), F.max_by("entry_hash", "seq").alias("head"), F.max("seq").alias("last_seq"))


def forks(events: DataFrame) -> DataFrame:
    """(chain_id, prev_hash, branches): places from which a chain goes on in more than one way."""
    return events.groupBy("chain_id", "prev_hash").agg(F.countDistinct("entry_hash").alias("branches")).where("branches > 1")
