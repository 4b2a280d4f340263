"""Suffix-array dedup: cut every byte of a string of SPAN bytes that also starts anywhere else in the corpus.

1. Every start of a SPAN-byte string belongs to one anchor: the place of the least K-byte hash within the string. Equal
   strings have equal anchors at the same distance, so only starts whose anchors share a hash can be equal. Anchors that
   occur once need no more work, and starts are dealt into shards by their anchor's hash.
2. In a shard, the neighbourhoods of the anchors are one text. Its suffix array is built by Larsson-Sadakane refinement
   (ranks of prefixes of 8 bytes, doubled; only groups that are not yet settled are sorted again), and the common
   prefixes of neighbours by Kasai's walk along each neighbourhood, all neighbourhoods abreast.
   Neighbours with a common prefix of SPAN bytes are repeats.
   Equal neighbourhoods are one; if there are several of it, all its starts are repeats.
3. An anchor with more than HOT_ROWS different neighbourhoods is dealt over several shards, which are merged pairwise:
   the starts of one are looked up in the other's suffix array by binary search.

Whole texts that occur more than once are repeats from end to end; one of them stands for all in the steps above. They are
known by two 64-bit hashes: of 10**10 texts, two different ones are taken for equal with a probability of about 10**-18.
Texts count as UTF-8 bytes, matches never cross documents, overlaps count, and strings are judged on the input.

Defined results: a null text is empty; texts under SPAN bytes lose nothing; a repeated row is a copy, so all its bytes
go if there are SPAN or more; null ids are allowed; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checked, save, table
from vigilake.llm.words import _BYTE, mix, slices

SPAN, K = 400, 32
#: Bytes of neighbourhoods in a shard, and the most different neighbourhoods of one anchor in a shard.
SHARD, HOT_ROWS = 3 << 20, 5000

_LOW = np.uint64(0xFFFFFFFF)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on; those that reach past the end mean nothing."""
    h, k = _BYTE[data], 1
    while k < K:
        h[: len(h) - k] = h[: len(h) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) + h[k:]
        k *= 2
    return mix(h)


def _anchors(span: int):
    """Rows (anchor, k1, k2, lo, hi): the starts lo..hi of the text k1, k2 belong to this anchor."""
    width = span - K + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text", 2 << 20):
            n = len(data)
            if n < span:
                continue
            grams = _grams(data)
            least = (grams & ~_LOW) | np.arange(n, dtype=np.uint64)
            w = 1
            while 2 * w <= width:
                least[: n - w] = np.minimum(least[: n - w], least[w:])
                w *= 2
            least = np.minimum(least[: n - width + 1], least[width - w : n - w + 1])[: n - span + 1]
            at = (least & _LOW).astype(np.int64)
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)[: len(at)]
            inside = np.arange(len(at)) + span <= offsets[row + 1]
            change = np.ones(len(at) + 1, bool)
            change[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
            edge = np.flatnonzero(change)
            lo, hi = edge[:-1], edge[1:] - 1
            keep = inside[lo]
            lo, hi = lo[keep], hi[keep]
            r = row[lo]
            k1, k2 = (part.column(c).to_numpy(zero_copy_only=False)[r] for c in (0, 1))
            yield pa.record_batch([pa.array(grams[at[lo]].view(np.int64)), pa.array(k1), pa.array(k2), pa.array((lo - offsets[r]).astype(np.int64)), pa.array((hi - offsets[r]).astype(np.int64))], ["anchor", "k1", "k2", "lo", "hi"])

    return run


def _contexts(span: int):
    """Rows (anchor, c1, c2, k1, k2, lo, starts, context) from texts with their list of runs.

    c1, c2: a digest of the neighbourhood; its bytes come with the first of equal ones of a slice only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text", 1 << 20):
            runs = part.column(3)
            k1, k2 = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            flat, size = runs.flatten(), np.diff(runs.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), size)
            lo, hi = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi"))
            a, b = offsets[row] + lo, offsets[row] + hi + span
            raw, seen, digests, bodies = data.tobytes(), set(), [], []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                body = raw[x:y]
                digests.append(blake2b(body, digest_size=16).digest())
                bodies.append(None if body in seen else body)
                seen.add(body)
            c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [flat.field("anchor"), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(k1[row]), pa.array(k2[row]), pa.array(lo), pa.array(hi - lo + 1), pa.array(bodies, pa.binary())],
                ["anchor", "c1", "c2", "k1", "k2", "lo", "starts", "context"],
            )

    return run


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in their order."""
    x = np.zeros(len(data), np.uint64)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    for j in range(8):
        x |= wide[j : j + len(data)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return x


def suffix_array(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, packed): all places of data by the span bytes that follow, equal ones in order of place.

    Larsson-Sadakane refinement: rank is the index of a group's first place, h the number of bytes the groups agree on.
    """
    x = _packed(data)
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(index: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Give the places order[index], sorted by key, the ranks of their new groups; the index of those that still share one."""
        first = np.ones(len(index), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(index)))
        rank[order[index]] = np.repeat(index[start], size)
        return index[np.repeat(size > 1, size)]

    open_, h = settle(np.arange(n), x[order]), 8
    while h < span and len(open_):
        step = min(h, span - h)  # the last step overlaps, so that exactly span bytes count
        at = order[open_]
        to = at + step
        after = np.where(to < n, rank[np.minimum(to, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        open_ = settle(open_, key[by])
        h += step
    return order, rank, x


def _forward(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, so_far: np.ndarray, span: int) -> np.ndarray:
    """How many bytes, span at most, the texts agree on from the places a and b, of which so_far are known."""
    n, live = so_far.copy(), np.flatnonzero(so_far < span)
    while len(live):
        d = x[a[live] + n[live]] ^ y[b[live] + n[live]]
        same = np.full(len(d), 8)
        for j in range(8):
            same[d >> np.uint64(8 * j) != 0] = 7 - j
        n[live] += same
        live = live[(same == 8) & (n[live] < span)]
    return np.minimum(n, span)


def common_prefixes(starts: np.ndarray, ends: np.ndarray, order: np.ndarray, x: np.ndarray, data: np.ndarray, span: int) -> np.ndarray:
    """For each place the bytes it has in common with the one before it in order (-1: none before, or no start).

    order: the places starts..ends-1 of all rows, sorted. Kasai's walk: the place after one that has l bytes in common
    has l - 1 at least, as long as the neighbour's successor is a start as well and sorts before it.
    """
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eligible = np.zeros(n + 1, bool)
    eligible[order] = True
    out = np.full(n, -1, np.int64)
    rows = np.argsort(starts - ends, kind="stable")  # longest first, so that the rows still walked are a prefix
    starts, ends = starts[rows], ends[rows]
    known = np.zeros(len(rows), np.int64)
    wide = np.concatenate((x, np.zeros(span + 8, np.uint64)))
    for t in range(int((ends - starts).max(initial=0))):
        live = int(np.searchsorted(starts - ends, -t, "left"))
        i = starts[:live] + t
        p = before[i]
        have = np.flatnonzero(p >= 0)
        got = np.full(live, -1, np.int64)
        got[have] = _forward(wide, i[have], wide, p[have], known[:live][have], span)
        out[i] = got
        # what the next place has in common at least
        nxt = np.maximum(got - 1, 0)
        ok = (p >= 0) & eligible[p + 1]
        full = ok & (got >= span)
        q = np.flatnonzero(full & (i + span < len(data)) & (p + span < len(data)))
        sorts_before = np.zeros(live, bool)
        a, b = data[i[q] + span], data[p[q] + span]
        sorts_before[q] = (b < a) | (b == a) & (p[q] < i[q])
        known[:live] = np.where(ok & (~full | sorts_before), nxt, 0)
    return out


def _text(contexts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the contexts one after another, and the places in each that begin a string of span bytes."""
    size = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(size) - size
    return np.frombuffer(b"".join(contexts), np.uint8), starts, starts + size - span + 1


def _sorted_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    order, _, x = suffix_array(data, span)
    eligible = np.zeros(len(data) + 1, np.int64)
    eligible[starts] += 1
    np.add.at(eligible, ends, -1)
    return order[np.cumsum(eligible)[order] > 0], x


def repeats_within(contexts: list[bytes], counts: list[int], anchors: list[int], span: int) -> list[np.ndarray]:
    """For each of the distinct contexts which of its starts are repeated in the shard."""
    out = [np.full(len(c) - span + 1, n > 1) for c, n in zip(contexts, counts, strict=True)]
    kinds = Counter(anchors)
    todo = [i for i, a in enumerate(anchors) if kinds[a] > 1]  # an anchor with a single context has nothing to be compared with
    if todo:
        data, starts, ends = _text([contexts[i] for i in todo], span)
        order, x = _sorted_starts(data, starts, ends, span)
        common = common_prefixes(starts, ends, order, x, data, span)
        twin = np.flatnonzero(common[order] >= span)
        hit = np.zeros(len(data), bool)
        hit[order[twin]] = hit[order[twin - 1]] = True
        for i, a, b in zip(todo, starts.tolist(), ends.tolist(), strict=True):
            out[i] |= hit[a:b]
    return out


def repeats_between(left: list[bytes], right: list[bytes], span: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Which starts of either side's contexts occur on the other: binary search of left's starts in right's suffix array."""
    a, a_starts, a_ends = _text(left, span)
    b, b_starts, b_ends = _text(right, span)
    order, y = _sorted_starts(b, b_starts, b_ends, span)
    x = np.concatenate((_packed(a), np.zeros(span + 8, np.uint64)))
    y = np.concatenate((y, np.zeros(span + 8, np.uint64)))
    places = np.concatenate([np.arange(s, e) for s, e in zip(a_starts, a_ends, strict=True)])
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(order), np.int64)
    while (live := np.flatnonzero(lo < hi)).size:  # the first start on the right that is not less
        mid = (lo[live] + hi[live]) // 2
        p, q = places[live], order[mid]
        n = _forward(x, p, y, q, np.zeros(len(live), np.int64), span)
        inner = np.minimum(n, span - 1)
        less = (n < span) & (b[q + inner] < a[p + inner])
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    at = np.minimum(lo, len(order) - 1)
    equal = (lo < len(order)) & (_forward(x, places, y, order[at], np.zeros(len(places), np.int64), span) >= span)
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    hit_a[places[equal]] = True
    for k in np.unique(lo[equal]).tolist():  # and the ones that are equal to it
        while k < len(order):
            hit_b[order[k]] = True
            if k + 1 == len(order) or b[order[k] : order[k] + span].tobytes() != b[order[k + 1] : order[k + 1] + span].tobytes():
                break
            k += 1
    return [hit_a[s:e] for s, e in zip(a_starts, a_ends, strict=True)], [hit_b[s:e] for s, e in zip(b_starts, b_ends, strict=True)]


def _spans(t: pa.Table, masks: list[np.ndarray], span: int) -> pa.Table:
    """Rows (anchor, c1, c2, first, last): the bytes of each context that are covered by its repeated starts.

    Contexts that occur several times are left out, since all of their starts are repeated.
    """
    rows, first, last = [], [], []
    for i, (m, times) in enumerate(zip(masks, t.column("times").to_pylist(), strict=True)):
        if times == 1 and m.any():
            edge = np.diff(np.concatenate(([0], m.view(np.int8), [0])))
            first.append(np.flatnonzero(edge == 1))
            last.append(np.flatnonzero(edge == -1) - 1 + span)
            rows += [i] * len(first[-1])
    cut = t.select(["anchor", "c1", "c2"]).take(pa.array(rows, pa.int64()))
    none = np.zeros(0, np.int64)
    return cut.append_column("first", pa.array(np.concatenate(first) if first else none)).append_column("last", pa.array(np.concatenate(last) if last else none))


def _within(span: int):
    def run(t: pa.Table) -> pa.Table:
        return _spans(t, repeats_within(*(t.column(c).to_pylist() for c in ("context", "times", "anchor")), span), span)

    return run


def _between(span: int):
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        halves = [t.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1)]
        own = [h.column("context").to_pylist() for h in halves]
        if not own[0] or not own[1]:
            return _spans(t, [np.zeros(1, bool)] * t.num_rows, span)
        return pa.concat_tables([_spans(h, found, span) for h, found in zip(halves, repeats_between(own[0], own[1], span), strict=True)])

    return run


def repeated_bytes(texts: DataFrame, span: int = SPAN, shard: int = SHARD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (k1, k2, first, last) of texts (k1, k2, text): byte ranges covered by repeats, one row or more per anchor's run; they overlap."""
    runs = save(texts.where(F.octet_length("text") >= span).mapInArrow(_anchors(span), "anchor long, k1 long, k2 long, lo long, hi long"), "runs")
    several = save(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    of_text = save(runs.join(several, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("runs")), "of_text")
    wanted = texts.join(checked(of_text.select("k1", "k2")), ["k1", "k2"], "left_semi")
    places = wanted.join(of_text, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_contexts(span), "anchor long, c1 long, c2 long, k1 long, k2 long, lo long, starts long, context binary")
    places = save(places, "places")
    key = ["anchor", "c1", "c2"]
    contexts = save(places.groupBy(*key).agg(F.count("*").alias("times"), F.max("starts").alias("starts"), F.max("context").alias("context")), "contexts")
    # an anchor with a single context has nothing to be compared with
    kinds = save(contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("starts") + span).alias("bytes")).where("kinds > 1"), "kinds")
    total = kinds.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    rows = contexts.join(kinds.select("anchor", "kinds"), "anchor").withColumn("parts", F.ceil(F.col("kinds") / hot_rows))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("c1", "c2"), F.col("parts"))).select(*key, "times", "context", "parts", "salt")
    # a shard for many anchors, or several for one
    own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.xxhash64("anchor", "salt"))
    schema = "anchor long, c1 long, c2 long, first long, last long"
    found = rows.withColumn("shard", own).groupBy("shard").applyInArrow(_within(span), schema)
    if kinds.where(F.col("kinds") > hot_rows).take(1):
        hot = rows.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other <> salt")
        hot = hot.withColumn("pair", F.xxhash64("anchor", F.least("salt", "other"), F.greatest("salt", "other"))).withColumn("side", (F.col("salt") > F.col("other")).cast("int"))
        found = found.unionByName(hot.groupBy("pair").applyInArrow(_between(span), schema))
    zero = F.lit(0).cast("long")
    found = found.unionByName(contexts.where("times > 1").select(*key, zero.alias("first"), (F.col("starts") + span - 1).alias("last")))
    return places.drop("context", "starts").join(save(found, "spans"), key).select("k1", "k2", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text", 1 << 20):
            rows = []
            for r in range(part.num_rows):
                raw = data[offsets[r] : offsets[r + 1]]
                cover = np.zeros(len(raw) + 1, np.int32)
                if part.column(2)[r].as_py():
                    if len(raw) >= span:
                        cover[0], cover[-1] = 1, -1
                elif part.column(3)[r].is_valid:
                    cut = part.column(3)[r].values
                    np.add.at(cover, cut.field("first").to_numpy(), 1)
                    np.add.at(cover, cut.field("last").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = raw[~gone].tobytes()
                rows.append((len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([part.column(0), *(pa.array([x[k] for x in rows], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def cut_repeats(docs: DataFrame, span: int = SPAN, shard: int = SHARD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    long = docs.where(F.octet_length("text") >= span)
    copies = save(long.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    held = checked(copies)
    # each text once, whatever the ids of its rows are: only copied texts are shuffled, and each task passes one of a kind on
    copied = save(long.join(held, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("text").alias("text")), "copied")
    texts = long.join(held, ["k1", "k2"], "left_anti").select("k1", "k2", "text").unionByName(copied)
    found = repeated_bytes(texts, span, shard, hot_rows)
    # a copied text goes as a whole, so its ranges are not needed
    found = found.join(held, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    found = save(found, "found")
    copied = copies.withColumn("copied", F.lit(True))
    hit = save(found.select("k1", "k2").unionByName(copies), "hit")
    hit = checked(hit)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    part = docs.join(hit, ["k1", "k2"], "left_semi").join(found, ["k1", "k2"], "left").join(checked(copied), ["k1", "k2"], "left")
    part = part.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "cuts").mapInArrow(_cut(span), schema)
    rest = docs.join(hit, ["k1", "k2"], "left_anti")
    zero = F.lit(0).cast("long")
    return part.unionByName(rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
#: Every start of every text with a hash of its string: for small tables.
ORACLE_SQL = {
    "op10_suffix_dedup": f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, i, hash(b[i:i + {SPAN - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {SPAN - 2})) AS i FROM t WHERE octet_length(b) >= {SPAN})),
s AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END AS first FROM s),
g AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
r AS (SELECT doc_id, min(i) AS a, max(i) + {SPAN - 1} AS z FROM g GROUP BY doc_id, run),
k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y, z - a + 1 AS cut FROM r
  UNION ALL SELECT doc_id, max(z) + 1, NULL, 0 FROM r GROUP BY doc_id),
j AS (SELECT doc_id, sum(cut) AS n_removed, count(*) - 1 AS n_spans, string_agg(CASE WHEN x <= coalesce(y, octet_length(b)) THEN hex(b[x:coalesce(y, octet_length(b))]) ELSE '' END, '' ORDER BY x) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM t LEFT JOIN j ON j.doc_id = t.doc_id
""",
}
