"""Benchmark decontamination: find passages of test items in training text and cut them out, or drop the documents.

The normalised test n-grams (windows of ten words) become a set of hashes that every task holds; whole texts are
scanned window by window in numpy, and every hash hit is verified on the words themselves. The set is broadcast only
after its size was checked; a larger one is joined by a shuffle on the window's hash and words instead.

Defined results: a null text has no words; a null item_id or an item without words is left out; items of fewer than
ten words are one window of their own length; repeated rows each give a row; other columns are not read, or in
`decontaminate` are kept as they are. Empty tables give no hits, and an empty table of documents an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import save, table
from vigilake.llm.words import _LOWER, ALNUM, slices, windows, words

#: Words in a window; how many test windows a task may hold, and how many bytes of them (words, and 16 bytes for each window and each item of one).
WINDOW, HELD_WINDOWS, HELD_BYTES = 10, 1_000_000, 150_000_000
#: A document of which more than this share of words is hit is dropped whole.
DROP_SHARE = 0.5

_FOUND = "n_words long, n_hit long, items array<long>, kept string"


def _keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, m: int) -> list[bytes]:
    raw = low.tobytes()
    return [b" ".join([raw[starts[j] : ends[j]] for j in range(i, i + m)]) for i in at]


def _item_windows(n: int):
    """(item_id, m, hash, key) of every window of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            h, starts, ends, rows = words(data, offsets, ALNUM)
            low, ids = _LOWER[data], part.column(0)
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
                m = int(min(n, b - a))
                if m and ids[i].is_valid:
                    at = np.arange(a, b - m + 1)
                    out += zip([ids[i].as_py()] * len(at), [m] * len(at), windows(h[a:b], m).view(np.int64).tolist(), _keys(low, starts, ends, at, m), strict=True)
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["item_id", "m", "hash", "key"])

    return run


class _Scanner:
    """The test windows as one task holds them: for each length their sorted hashes, and the words and items of all in one array each (see `_packed`)."""

    def __init__(self, held: dict[int, tuple]):
        self.held, self.quick = held, {}
        for m, (h, *_) in held.items():
            self.quick[m] = np.zeros(1 << 20, bool)
            self.quick[m][(h >> np.uint64(44)).astype(np.int64)] = True

    def items(self, m: int, h: int, key: bytes, j: int) -> np.ndarray | None:
        """The items of the window with these words; j: the first of its hash."""
        known, words_, ends, ids, id_ends = self.held[m]
        while j < len(known) and known[j] == h:
            if words_[ends[j] : ends[j + 1]] == key:
                return ids[id_ends[j] : id_ends[j + 1]]
            j += 1
        return None

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, row offsets, hit words, for each row the ids of its items)."""
        h, starts, ends, rows = words(data, offsets, ALNUM)
        change, found, low = np.zeros(len(h) + 1, np.int64), defaultdict(set), _LOWER[data]
        for m, (known, *_) in self.held.items():
            w = windows(h, m)
            at = np.flatnonzero(self.quick[m][(w >> np.uint64(44)).astype(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, w[at]), len(known) - 1)] == w[at]]
            row = np.searchsorted(rows, at, "right") - 1
            inside = at + m <= rows[row + 1]
            at, row = at[inside], row[inside]
            for i, r, key in zip(at.tolist(), row.tolist(), _keys(low, starts, ends, at, m), strict=True):
                if (ids := self.items(m, w[i], key, int(np.searchsorted(known, w[i])))) is not None:
                    change[i] += 1
                    change[i + m] -= 1
                    found[r].update(ids.tolist())
        return starts, ends, rows, np.cumsum(change[:-1]) > 0, found

    def cut(self, text: bytes) -> bytes:
        """The text without its hit runs, from the first byte of a run's first word to the last of its last, until no hit is left."""
        while True:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _, hit, _ = self.scan(data, np.array([0, len(text)]))
            if not hit.any():
                return text
            edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            pieces, last = [], 0
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
                pieces.append(text[last : starts[a]])
                last = ends[b]
            text = b"".join([*pieces, text[last:]])


def _scan(held, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(held.value)
        for part, data, offsets in slices(batches, "text"):
            _, _, rows, hit, found = scanner.scan(data, offsets)
            total = np.concatenate(([0], np.cumsum(hit)))
            kept: list[bytes | None] = [None] * part.num_rows
            if cut:
                for r in found:
                    kept[r] = scanner.cut(data[offsets[r] : offsets[r + 1]].tobytes())
            cols = [c for name, c in zip(part.schema.names, part.columns, strict=True) if cut or name != "text"]
            names = [name for name in part.schema.names if cut or name != "text"]
            yield pa.record_batch(
                [*cols, pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]]), pa.array([sorted(found[r]) if r in found else [] for r in range(part.num_rows)], pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())],
                [*names, "n_words", "n_hit", "items", "kept"],
            )

    return run


def _doc_windows(lengths: list[int]):
    """For the way without a broadcast: every window of every document as (doc_id, at, m, hash, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text", 1 << 18):
            h, starts, ends, rows = words(data, offsets, ALNUM)
            low, ids = _LOWER[data], part.column(0).to_numpy(zero_copy_only=False)
            for m in lengths:
                w = windows(h, m)
                at = np.arange(len(w))
                row = np.searchsorted(rows, at, "right") - 1
                inside = at + m <= rows[row + 1]
                at, row = at[inside], row[inside]
                yield pa.record_batch([pa.array(ids[row]), pa.array(at - rows[row]), pa.array(np.full(len(at), m, np.int32)), pa.array(w[at].view(np.int64)), pa.array(_keys(low, starts, ends, at, m), pa.binary())], ["uid", "at", "m", "hash", "key"])

    return run


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        yield pa.record_batch([part.column(0), pa.array(np.diff(words(data, offsets, ALNUM)[3]))], ["uid", "n_words"])


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: m (words), hash, key (the words), item_ids."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_windows(n), "item_id long, m int, hash long, key binary")
    return rows.groupBy("m", "hash", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _held(grams: DataFrame, most: int):
    """The windows as a broadcast value, or None where there are more than `most`, or more than HELD_BYTES of them."""
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + 16 + 16 * F.size("item_ids")), F.lit(0)).alias("bytes")).first()
    if size.n > most or size.bytes > HELD_BYTES:
        return None
    return grams.sparkSession.sparkContext.broadcast(_packed(grams.select("m", "hash", "key", "item_ids").toArrow()))


def _packed(rows: pa.Table) -> dict[int, tuple]:
    """For each length: (hashes, sorted; the windows' words in one string of bytes; where each begins; the items' ids; where each window's begin)."""
    out = {}
    for m in pc.unique(rows.column("m")).to_pylist():
        own = rows.filter(pc.equal(rows.column("m"), m))
        h = own.column("hash").to_numpy().view(np.uint64)
        own = own.select(["key", "item_ids"]).take(pa.array(np.argsort(h, kind="stable"))).combine_chunks()
        key, ids = own.column("key").cast(pa.large_binary()), own.column("item_ids")
        sizes = lambda c: np.concatenate(([0], np.cumsum(c.to_numpy()))).astype(np.int64)
        out[m] = (np.sort(h), b"".join(key.to_pylist()), sizes(pc.binary_length(key)), pc.list_flatten(ids).to_numpy(), sizes(pc.list_value_length(ids)))
    return out


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, most: int = HELD_WINDOWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted ids of the items with windows in the text)."""
    docs = docs.select("doc_id", "text")
    grams = save(item_windows(items, n), "grams")
    if held := _held(grams, most):
        return docs.mapInArrow(_scan(held, False), f"doc_id long, {_FOUND}").drop("kept")
    lengths = [r.m for r in grams.select("m").distinct().collect()]  # n values at most
    numbered = save(docs.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    spots = numbered.select("uid", "text").mapInArrow(_doc_windows(lengths), "uid long, at long, m int, hash long, key binary").join(grams, ["m", "hash", "key"])
    hit = spots.select("uid", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("word")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    of = spots.select("uid", F.explode("item_ids").alias("item_id")).distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    sized = numbered.select("uid", "text").mapInArrow(_sized, "uid long, n_words long")
    out = numbered.select("uid", "doc_id").join(sized, "uid").join(hit, "uid", "left").join(of, "uid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def _cut_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, n_words, n_hit, text without the hit runs) of texts with their hit windows (at and m, side by side)."""
    for part, data, offsets in slices(batches, "text"):
        _, starts, ends, rows = words(data, offsets, ALNUM)
        hits, texts = [], []
        for r, spots in enumerate(part.column(part.schema.get_field_index("spots")).to_pylist()):
            change = np.zeros(rows[r + 1] - rows[r] + 1, np.int64)
            for x in spots:
                change[x["at"]] += 1
                change[x["at"] + x["m"]] -= 1
            hit = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            pieces, last = [], offsets[r]
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
                pieces.append(data[last : starts[rows[r] + a]].tobytes())
                last = ends[rows[r] + b]
            hits.append(int(hit.sum()))
            texts.append(b"".join([*pieces, data[last : offsets[r + 1]].tobytes()]))
        yield pa.record_batch([part.column(0), pa.array(np.diff(rows)), pa.array(hits, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["uid", "n_words", "n_hit", "text"])


def _cut_by_join(docs: DataFrame, grams: DataFrame, drop_share: float) -> DataFrame:
    """docs with __words, __hit and __kept as _scan gives them, for more windows than a task may hold; __words is 0 without a hit."""
    lengths = [r.m for r in grams.select("m").distinct().collect()]  # n values at most
    numbered = save(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")

    def cut(texts: DataFrame) -> DataFrame:
        spots = texts.mapInArrow(_doc_windows(lengths), "uid long, at long, m int, hash long, key binary").join(grams.select("m", "hash", "key"), ["m", "hash", "key"], "left_semi")
        spots = spots.groupBy("uid").agg(F.collect_list(F.struct("at", "m")).alias("spots"))
        return save(texts.join(spots, "uid").mapInArrow(_cut_at, "uid long, n_words long, n_hit long, text string"), "cut")

    first = cut(numbered.select(F.col("__uid").alias("uid"), "text"))
    settled, open_ = [], first.where(F.col("n_hit") <= drop_share * F.col("n_words")).select("uid", "text")
    while open_.take(1):  # words that a cut has brought together may be a passage again; every round takes out words
        again = cut(open_)
        settled.append(open_.join(again, "uid", "left_anti"))
        open_ = again.select("uid", "text")
    kept = first.select("uid", "text").limit(0)
    for x in settled:
        kept = kept.unionByName(x)
    kept = first.select("uid", F.col("n_words").alias("__words"), F.col("n_hit").alias("__hit")).join(kept.withColumnRenamed("text", "__kept"), "uid", "left")
    out = numbered.join(kept.withColumnRenamed("uid", "__uid"), "__uid", "left").drop("__uid")
    return out.withColumns({"__words": F.coalesce("__words", F.lit(0)), "__hit": F.coalesce("__hit", F.lit(0))})


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, drop_share: float = DROP_SHARE, most: int = HELD_WINDOWS) -> DataFrame:
    """docs without the test items' passages; columns as they came.

    A document of which more than drop_share of the words is hit goes; drop_share=0 drops every document with a hit.
    Of the others the hit runs are cut out of the text, and n_chars, if there, is counted anew.
    """
    grams = save(item_windows(items, n), "grams")
    if held := _held(grams, most):
        schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("__words long, __hit long, __items array<long>, __kept string").fields])
        found = docs.mapInArrow(_renamed(_scan(held, True)), schema)
    else:
        found = _cut_by_join(docs, grams, drop_share)
    found = found.where(F.col("__hit") <= drop_share * F.col("__words")).where((F.col("__hit") == 0) | (F.trim(F.col("__kept")) != ""))
    text = F.coalesce("__kept", "text")
    new = {"text": text} | ({"n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def _renamed(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(batches):
            yield b.rename_columns([*b.schema.names[:-4], "__words", "__hit", "__items", "__kept"])

    return run


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_CLASS}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, {_CLASS}) AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM (SELECT *, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0))),
dw AS (
  SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)),
h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, k)),
w AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
}
