"""MinHash near-dedup: one permutation, densified, in bands; the members of a bucket are compared with one of them.

One 64-bit hash of a shingle is the permutation: its first bits name one of BINS bins, and a bin's value is its least hash
(the first one, since a document's hashes are sorted). An empty bin takes the value of the first filled one in a random order
of bins of its own (optimal densification), the same for all documents. BANDS keys are made of ROWS bins each; documents with
an equal key are in one bucket. A pair of similarity s shares no bucket with a probability of about (1 - s**ROWS)**BANDS:
5 in 10**9 at 0.8.

Buckets give stars: every member is compared with the bucket's leader alone, the one that meets most others in all its buckets
(of many copies of a text, that which they were made from). So pairs are at most BANDS per document, whatever the size of a
group. Candidates that pass tests of size, of a sketch (one bit of each bin) and of a parity map of the whole set (an exact
bound) are confirmed on the full sets, links are closed to components. Documents that are similar to each other but not to
their leader are left: they are in buckets that still hold several components. There the members outside the bucket's main
component are compared with all others of other components, in blocks and with the same tests inside the join.

Equal sets are one class from the start and are known by their size and two sums of 64-bit hashes.

Defined results: null or word-less text has no shingles and is linked with nothing; a document of fewer words than a shingle
has all of them as one; a repeated doc_id gets one component for all its rows (its rows count as linked); a row with a null
doc_id takes no part, has a null component and is kept; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checked, connected_components, save, table
from vigilake.llm.jaccard_join import FRAGMENTS, MAP_BITS, _A, _B, _maps, _maps_agree, _sums
from vigilake.llm.words import NOT_SPACE, mix, shingle_sets, slices, words

#: Shingle length in words, and the similarity as a fraction.
WORDS, SHARE = 2, (80, 100)
#: Bins of the permutation (a power of two), bands, and bins in a band.
BINS, BANDS, ROWS = 256, 48, 5
#: Members outside a bucket's main component are compared with the bucket in blocks of so many.
BLOCK = 2000
#: Standard deviations by which a sketch may differ from what is expected at the threshold.
SIGMAS = 8
#: Sketches of so many documents (40 bytes each) may be broadcast.
SKETCHES_HELD = 500_000

_SKETCH, _PARTS = "doc_id long, n long, h1 long, h2 long, keys array<long>, bits array<long>, map array<long>", "doc_id long, n long, h1 long, h2 long, fragment int, tokens array<long>"


def _orders(bins: int) -> np.ndarray:
    """place[i, j]: when bin i, if empty, looks at bin j."""
    rng = np.random.default_rng(20240317)
    return np.argsort(np.argsort(rng.random((bins, bins)), axis=1), axis=1).astype(np.int16)


def signature(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value of every bin, from sorted distinct hashes (one at least)."""
    bins = len(place)
    at, first = np.unique((tokens >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), return_index=True)
    source = at[place[:, at].argmin(1)]  # a filled bin's own place is not looked at: it keeps its value
    value = np.zeros(bins, np.uint64)
    value[at] = tokens[first]
    source[at] = at
    return value[source]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Every row's set as sorted hashes; its identity, which is size and two sums; and its parity map."""
    h, _, _, rows = words(data, offsets, NOT_SPACE)
    sets = list(shingle_sets(h, rows, n))
    size = np.array([len(s) for s in sets], np.int64)
    every, ends = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
    return sets, size, _sums(mix(every ^ _A), ends), _sums(mix(every ^ _B), ends), _maps(every, ends)


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _orders(BINS)
        factor = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for part, data, offsets in slices(batches, "text"):
            sets, size, a, b, maps = _sets(data, offsets, n)
            values = np.array([signature(s, place) for s in sets if len(s)], np.uint64).reshape(-1, BINS)
            keys = mix((mix(values[:, : BANDS * ROWS]).reshape(-1, BANDS, ROWS) * factor).sum(2, dtype=np.uint64) ^ band).view(np.int64)
            bits = np.packbits((mix(values) & np.uint64(1)).astype(bool), axis=1, bitorder="little").view(np.int64)
            # rows without shingles have empty lists
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((size > 0) * x.shape[1]))).astype(np.int32)), pa.array(x.ravel())) for x in (keys, bits)]
            yield pa.record_batch([part.column(0), pa.array(size), pa.array(a), pa.array(b), *lists, maps], ["doc_id", "n", "h1", "h2", "keys", "bits", "map"])

    return run


def _parts(n: int):
    """The sets in FRAGMENTS parts by hash, so that no row holds the whole of a very long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)
        for part, data, offsets in slices(batches, "text"):
            sets, size, a, b, _ = _sets(data, offsets, n)
            ends = np.cumsum([0, *(k for s in sets for k in np.diff([0, *np.searchsorted(s, edges), len(s)]))]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            each = pa.array(np.repeat(np.arange(len(size)), FRAGMENTS))
            fragment = pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(size)))
            yield pa.record_batch([*(c.take(each) for c in (part.column(0), pa.array(size), pa.array(a), pa.array(b))), fragment, tokens], ["doc_id", "n", "h1", "h2", "fragment", "tokens"])

    return run


_BITS = BINS // 64


def may_agree(x: str, y: str, n: str, m: str, share: tuple[int, int]) -> Column:
    """Whether sets of n and m shingles with the bits x0.. and y0.. may be similar: by size (exact), and by the bits that differ.

    At the threshold, half of the bins with other values differ; the fewer shingles fill the bins, the less even is the count.
    """
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(_BITS)))
    half = (1 - share[0] / share[1]) / 2
    drawn = F.least(F.lit(float(BINS)), F.least(n, m).cast("double"))
    return close(n, m, share) & (apart <= BINS * half + SIGMAS * BINS * F.sqrt(half / drawn))


def close(n: str, m: str, share: tuple[int, int]) -> Column:
    return share[1] * F.least(n, m) >= share[0] * F.greatest(n, m)


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs a < b with sizes na, nb of rows (x, nx, y, ny)."""
    up = F.col("x") < F.col("y")
    return rows.where("x <> y").select(*(F.when(up, F.col(p)).otherwise(F.col(q)).alias(k) for p, q, k in (("x", "y", "a"), ("y", "x", "b"), ("nx", "ny", "na"), ("ny", "nx", "nb")))).distinct()


class _Search:
    """One search among classes (node, n, h1, h2, rep): their sketches, and the components found so far."""

    def __init__(self, docs: DataFrame, sketch: DataFrame, classes: DataFrame, repeated: bool, n: int, share: tuple[int, int]):
        self.docs, self.classes, self.repeated, self.n, self.share = docs, classes, repeated, n, share
        of = classes.select("node", F.col("rep").alias("doc_id"), "n", "h1", "h2")
        mine = sketch.join(of, ["doc_id", "n", "h1", "h2"]).select("node", F.col("n").cast("int").alias("n"), "keys", "bits", "map")
        self.sketches = save(mine.dropDuplicates(["node"]) if repeated else mine, "sketches")
        self.groups = None

    def bits(self, side: str, *more: str) -> DataFrame:
        return self.sketches.select(F.col("node").alias(side), *(F.col("bits")[k].alias(f"{side}{k}") for k in range(_BITS)), *more)

    def maps_agree(self, x: str, y: str, n: str, m: str) -> Column:
        longs = lambda c: [F.col(c)[k] for k in range(MAP_BITS // 64)]
        return _maps_agree(F.col(n), F.col(m), longs(x), longs(y), self.share)

    def sides(self, pairs: DataFrame, side: str) -> DataFrame:
        """The sets of one side of pairs in parts. The text of a class is that of its representative."""
        want = self.classes.join(checked(pairs.select(F.col(side).alias("node")).distinct()), "node", "left_semi").select(F.col("rep").alias("doc_id"), "n", "h1", "h2", F.col("node").alias(side))
        want = save(want, "want")
        texts = self.docs.join(checked(want.select("doc_id").distinct()), "doc_id", "left_semi")
        parts = texts.mapInArrow(_parts(self.n), _PARTS).join(checked(want), ["doc_id", "n", "h1", "h2"]).select(side, "fragment", F.col("tokens").alias(f"tokens_{side}"))
        return parts.dropDuplicates([side, "fragment"]) if self.repeated else parts

    def link(self, pairs: DataFrame) -> None:
        """Confirm pairs (a, b, na, nb) on the full sets, part by part, and add the links to the components."""
        met = pairs.join(self.sides(pairs, "b"), "b").join(self.sides(pairs, "a"), ["a", "fragment"])
        both = met.select("a", "b", "na", "nb", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both")).groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
        self.add(both.where(self.share[1] * F.col("both") >= self.share[0] * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        if self.groups is not None:
            links = links.unionByName(self.groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.groups = save(connected_components(links), "groups")

    def stars(self, posts: DataFrame) -> DataFrame:
        """Compare the members of every bucket with its leader. Returns posts (key, node, n) of buckets of several members.

        The leader is the member that meets most others in all its buckets: of copies of one text, that which they were made from.
        Sizes and leaders are aggregates that are joined back: a bucket of very many members is dealt over several tasks.
        """
        sizes = posts.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        shared = save(posts.join(sizes, "key"), "shared")
        met = shared.groupBy("node").agg(F.sum("members").alias("met"))
        led = shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", F.xxhash64("node").alias("h"), "node", "n")).alias("lead"))
        both = shared.join(led.select("key", F.col("lead.node").alias("y"), F.col("lead.n").alias("ny")), "key")
        pairs = _pairs(both.where(close("n", "ny", self.share)).select(F.col("node").alias("x"), F.col("n").alias("nx"), "y", "ny"))
        near = pairs.join(checked(self.bits("a"), SKETCHES_HELD), "a").join(checked(self.bits("b"), SKETCHES_HELD), "b").where(may_agree("a", "b", "na", "nb", self.share))
        near = save(near.select("a", "b", "na", "nb"), "near")
        mapped = near.join(self.sketches.select(F.col("node").alias("a"), F.col("map").alias("map_a")), "a").join(self.sketches.select(F.col("node").alias("b"), F.col("map").alias("map_b")), "b")
        self.link(save(mapped.where(self.maps_agree("map_a", "map_b", "na", "nb")).select("a", "b", "na", "nb"), "mapped"))
        return shared

    def rest(self, shared: DataFrame) -> None:
        """Compare what the stars did not settle: in buckets of several components, those outside the main one with all others.

        Pairs are tested in the join, in blocks of the former; a row of a bucket meets each of its blocks.
        """
        of = self.groups.withColumnRenamed("node", "__node")
        mine = shared.join(of, F.col("node") == F.col("__node"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        parts = mine.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), (F.sum("c") - F.max("c")).alias("others"))
        open_ = parts.where("parts > 1").select("key", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks"))
        mine = save(mine.join(open_, "key").join(self.bits("w", "map"), F.col("node") == F.col("w")), "open")
        block = {"x": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
        side = lambda s: mine.select(F.col("key").alias(f"key_{s}"), block[s].alias(f"block_{s}"), F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("component").alias(f"c{s}"), (F.col("component") == F.col("main")).alias(f"main_{s}"), *(F.col(f"w{k}").alias(f"{s}{k}") for k in range(_BITS)), F.col("map").alias(f"map_{s}"))
        same = (F.col("key_x") == F.col("key_y")) & (F.col("block_x") == F.col("block_y"))
        apart = (F.col("cx") != F.col("cy")) & (F.col("main_y") | (F.col("x") < F.col("y")))
        met = side("x").where("not main_x").join(side("y"), same & apart & may_agree("x", "y", "nx", "ny", self.share) & self.maps_agree("map_x", "map_y", "nx", "ny"))
        found = save(_pairs(met.select("x", "nx", "y", "ny")), "rest")
        if found.take(1):
            self.link(found)

    def run(self) -> None:
        self.rest(self.stars(self.sketches.select("node", "n", F.explode("keys").alias("key"))))


def similarity_components(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    sketch = save(docs.mapInArrow(_sketched(n), _SKETCH), "sketch")
    own = sketch.select("doc_id", "n", "h1", "h2")
    classes = own.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    repeated = bool(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
    search = _Search(docs, sketch, classes, repeated, n, share)
    search.run()
    located = save(own.where("doc_id is not null").join(classes.select("n", "h1", "h2", "node"), ["n", "h1", "h2"]).select("doc_id", "node"), "located")
    if repeated:  # the rows of one id are linked
        least = located.groupBy("doc_id").agg(F.min("node").alias("b"))
        search.add(located.join(least, "doc_id").select(F.col("node").alias("a"), "b"))
        located = least.withColumnRenamed("b", "node")
    groups = search.groups.join(classes.select("node", "rep"), "node")
    named = groups.join(groups.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    # ids that are not their own class's representative, or whose class has links
    found = located.join(classes.select("node", "rep"), "node").join(named, "node", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    return own.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component; columns as they came."""
    drop = save(similarity_components(docs, n, share).where("component_id < doc_id").select("doc_id").distinct(), "drop")
    return docs.join(checked(drop), "doc_id", "left_anti").select(docs.columns)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op13_minhash_dedup": op13_minhash_dedup}
ORACLE_SQL = {
    "op13_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reached AS (SELECT DISTINCT a AS doc_id, a AS root FROM links UNION SELECT links.b, root FROM reached JOIN links ON links.a = reached.doc_id),
least_ AS (SELECT doc_id, min(root) AS root FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ l ON l.doc_id = d.doc_id
""",
}
