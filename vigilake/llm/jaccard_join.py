"""N-gram Jaccard join: documents whose sets of word shingles overlap by three quarters, and their groups.

Vertical partitioning. The n-grams have one global order: rare ones by hash, then those that many documents share,
by how many do. A document's set is cut along that order; any two documents that reach the threshold share an n-gram
in the first quarter (the prefix) of both. Candidates come from prefixes alone. Their overlaps are then counted
separately in each fragment of the n-gram space and summed per pair.

No group is expanded into all its pairs: first every document is compared with one leader per prefix n-gram and size
class, links are closed to components, and only pairs of *different* components that share a prefix n-gram are looked at
after that, long lists in blocks. Two documents of one component need no comparison, since the result is the component.
Of the pairs looked at, those go on that pass three exact tests: of size, of place, and of a parity map. A document's map
has a bit for each of MAP_BITS classes of n-grams, set where the document has an odd number of them; the bits in which
two maps differ are at most the n-grams in which the documents differ.

The order of n-grams comes from a table of the most frequent ones (NGRAMS_HELD at most, chosen by their counts over all
documents) with the logarithm of how often each occurs; all others count as rare. Any order that all tasks have in common
is right; this one keeps the lists short, and an n-gram that is not in the table never lends its place to another. Counts
are of n-grams that repeat within COUNTED shingles of a task. One that repeats only across tasks shows by the length of its
list: where lists of more than LEADER_LOAD documents come out that were not ranked, their n-grams are ranked by that
length and the prefixes are taken again, RANKINGS times at most (what is then still long is compared as it is).

Equal sets are known by their size and two sums of 64-bit hashes: of 10**10 documents, two with different sets pass for
equal with a probability of about 10**-18.

Defined results: null or word-less text has no shingles and is linked with nothing, not even with another such text;
equal sets are one class from the start; a repeated doc_id gets one component for all its rows; a row with a null
doc_id takes no part and has a null component; other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import checked, connected_components, save, table
from vigilake.llm.words import NOT_SPACE, mix, shingle_sets, slices, words

#: Shingle length in words, and the similarity as a fraction.
WORDS, SHARE = 5, (75, 100)
#: The n-gram space is cut into so many fragments for counting.
FRAGMENTS = 8
#: N-grams in the table of frequencies (9 bytes each), steps for each doubling of a frequency, and how often prefixes are taken.
NGRAMS_HELD, STEPS, RANKINGS = 1_000_000, 8, 3
#: Bits of the hash by which most n-grams that are not in the table are told (a byte for each value).
SIEVE_BITS = 22
#: Bits of a parity map, and of the folded ones by which pairs are tested first; folded maps of so many documents (40 bytes each) may be broadcast.
MAP_BITS, FOLD_BITS, FOLDS_HELD = 1024, 256, 500_000
#: Shingles that a task looks through at a time for shared ones.
COUNTED = 2_000_000
#: Lists of more documents than this are dealt over several leaders; a list that the leaders leave open is compared in blocks.
LEADER_LOAD, BLOCK = 50_000, 1_000

_PROFILE = "kind int, doc_id long, n long, a long, b long, map array<long>"
_A, _B = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _sums(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))[ends]
    return (total[1:] - total[:-1]).view(np.int64)


def _gathered(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, rows = words(data, offsets, NOT_SPACE)
    sets = list(shingle_sets(h, rows, n))
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def _maps(every: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The parity map of every row as MAP_BITS / 64 longs."""
    rows, words_ = len(ends) - 1, MAP_BITS // 64
    spot = np.repeat(np.arange(rows), np.diff(ends)) * MAP_BITS + (every & np.uint64(MAP_BITS - 1)).astype(np.int64)
    bits = np.packbits((np.bincount(spot, minlength=rows * MAP_BITS) & 1).astype(bool), bitorder="little")
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * words_ + 1, words_, dtype=np.int32)), pa.array(bits.view(np.int64)))


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        names = ["kind", "doc_id", "n", "a", "b", "map"]

        def shared() -> pa.RecordBatch:
            """The n-grams that several different documents of the last ones share."""
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, count = token[count >= 2], count[count >= 2]
            none = pa.nulls(len(token), pa.int64())
            held.clear()
            seen.clear()
            return pa.record_batch([pa.array(np.ones(len(token), np.int32)), none, pa.array(count.astype(np.int64)), pa.array(token.view(np.int64)), none, pa.nulls(len(token), pa.list_(pa.int64()))], names)

        for part, data, offsets in slices(batches, "text"):
            every, ends = _gathered(data, offsets, n)
            size, a, b = np.diff(ends), _sums(mix(every ^ _A), ends), _sums(mix(every ^ _B), ends)
            yield pa.record_batch([pa.array(np.zeros(len(size), np.int32)), part.column(0), pa.array(size), pa.array(a), pa.array(b), _maps(every, ends)], names)
            once = np.array([not (x in seen or seen.add(x)) for x in a.tolist()], bool)
            held.append(every[np.repeat(once, size)])
            if sum(map(len, held)) >= COUNTED:
                yield shared()
        yield shared()

    return run


class _Ranks:
    """The levels of the n-grams that are held; 0 for all others."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._spot(tokens)] = True

    @staticmethod
    def _spot(tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def of(self, every: np.ndarray) -> np.ndarray:
        level = np.zeros(len(every), np.uint8)
        if len(self.tokens):
            may = np.flatnonzero(self.sieve[self._spot(every)])
            at = np.minimum(np.searchsorted(self.tokens, every[may]), len(self.tokens) - 1)
            level[may] = np.where(self.tokens[at] == every[may], self.levels[at], 0)
        return level


def _in_order(every: np.ndarray, ends: np.ndarray, ranks: _Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Every row's n-grams put in the global order, and their levels."""
    level = ranks.of(every)
    if level.any():
        order = np.lexsort((level, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))  # stable: equal levels stay by hash
        every, level = every[order], level[order]
    return every, level


def _prefixes(n: int, share: tuple[int, int], held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _Ranks(*held.value)
        for part, data, offsets in slices(batches, "text"):
            every, ends = _gathered(data, offsets, n)
            every, level = _in_order(every, ends, ranks)
            size = np.diff(ends)
            take = np.where(size > 0, size - -(-size * share[0] // share[1]) + 1, 0)
            row = np.repeat(np.arange(len(size)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            at = ends[row] + place
            doc = part.column(0).to_numpy(zero_copy_only=False)[row]
            salts = 1 + np.exp2(level[at] / STEPS).astype(np.int64) // LEADER_LOAD
            salt = np.where(salts > 1, (mix(doc.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int64), 0)
            yield pa.record_batch(
                [pa.array(every[at].view(np.int64)), pa.array(np.where(salts > 1, salt + 1, 0).astype(np.int32)), pa.array(doc), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))],
                ["token", "salt", "doc_id", "n", "place"],
            )

    return run


def _segments(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)).astype(np.uint64)
        for part, data, offsets in slices(batches, "text", 1 << 20):
            every, ends = _gathered(data, offsets, n)
            cuts = [0]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                cuts += [*(a + np.searchsorted(every[a:b], edges)), b]
            lists = pa.ListArray.from_arrays(pa.array(np.array(cuts, np.int32)), pa.array(every.view(np.int64)))
            rows = part.num_rows
            yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), rows)), lists], ["doc_id", "fragment", "tokens"])

    return run


def _counts(profile: DataFrame) -> DataFrame:
    """(token, level) of the n-grams that were seen to repeat."""
    return profile.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.least(F.round(F.log2(F.sum("n")) * STEPS), F.lit(255)).cast("short").alias("level"))


def _most_frequent(counts: DataFrame, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) and levels of about `held` n-grams: those of the highest levels, and of the level that does not fit whole a part by hash."""
    cut, room, part = 256, held, 0
    for level, number in sorted(counts.groupBy("level").count().collect(), reverse=True):  # at most 255 rows
        if number > room:
            part = 1000 * room // number
            break
        cut, room = level, room - number
    chosen = (F.col("level") >= cut) | ((F.col("level") == level) & (F.pmod(F.xxhash64("token"), F.lit(1000)) < part)) if part else F.col("level") >= cut
    got = counts.where(chosen).toArrow()
    tokens, levels = got.column("token").to_numpy().view(np.uint64), got.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def _posts(docs: DataFrame, counts: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """(token, salt, doc_id, n, place, band) for each n-gram of each document's prefix that another one's has as well."""
    spark = docs.sparkSession
    for ranking in range(RANKINGS):
        held = spark.sparkContext.broadcast(_most_frequent(counts, NGRAMS_HELD))
        posts = docs.mapInArrow(_prefixes(n, share, held), "token long, salt int, doc_id long, n int, place int")
        posts = posts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(share[1] / share[0]))).cast("int"))
        length = F.count("*").over(Window.partitionBy("token", "salt"))
        posts = save(posts.withColumn("length", length).where("length > 1 or salt > 0"), "posts")
        held.destroy()
        if ranking + 1 == RANKINGS or not (long := posts.where((F.col("salt") == 0) & (F.col("length") > LEADER_LOAD))).take(1):
            break
        level = F.least(F.round(F.log2(F.max("length")) * STEPS), F.lit(255)).cast("short").alias("level")
        more = long.groupBy("token").agg(level)
        counts = save(counts.unionByName(more).groupBy("token").agg(F.max("level").alias("level")), "counts")
    return posts.drop("length")


def _links(docs: DataFrame, pairs: DataFrame, share: tuple[int, int], n: int) -> DataFrame:
    """The pairs (a, b, with sizes na, nb) that reach the threshold: overlaps by fragment, summed per pair."""
    def sides(col: str) -> DataFrame:
        ids = save(pairs.select(F.col(col).alias("doc_id")).distinct(), "sides")  # counted, then joined
        return docs.join(checked(ids), "doc_id", "left_semi").mapInArrow(_segments(n), "doc_id long, fragment int, tokens array<long>").select(F.col("doc_id").alias(col), "fragment", F.col("tokens").alias(f"tokens_{col}"))

    found = pairs.join(sides("b"), "b").join(sides("a"), ["a", "fragment"])
    part = found.select("a", "b", "na", "nb", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(share[1] * F.col("both") >= share[0] * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _may_link(share: tuple[int, int]) -> Column:
    """Whether the rows of two documents x and y (doc_id, n, place of the n-gram that they share) may belong to a link: by size and by place.

    The sizes must be close enough, and the first n-gram that a pair shares must leave room for the overlap that is needed.
    """
    n, m = F.col("n_x"), F.col("n_y")
    close = share[1] * F.least(n, m) >= share[0] * F.greatest(n, m)
    return close & (F.least(n - F.col("place_x"), m - F.col("place_y")) >= F.ceil((n + m) * share[0] / (share[0] + share[1])))


def _folded(maps: DataFrame, side: str) -> DataFrame:
    """(doc_id, and in columns the longs of the map folded to FOLD_BITS): the parity map for coarser classes."""
    step = FOLD_BITS // 64
    fold = lambda k: reduce(Column.bitwiseXOR, (F.col("map")[j] for j in range(k, MAP_BITS // 64, step)))
    return maps.select(F.col("doc_id").alias(side), *(fold(k).alias(f"{side}{k}") for k in range(step)))


def _maps_agree(n: Column, m: Column, x: list[Column], y: list[Column], share: tuple[int, int]) -> Column:
    """Whether documents of n and m n-grams whose maps have the longs x and y may overlap by the share."""
    apart = reduce(Column.__add__, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)))
    return apart <= n + m - 2 * F.ceil((n + m) * share[0] / (share[0] + share[1]))


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs a < b with sizes na, nb of rows of x and y."""
    up = F.col("doc_id_x") < F.col("doc_id_y")
    return rows.select(*(F.when(up, F.col(p)).otherwise(F.col(q)).alias(k) for p, q, k in (("doc_id_x", "doc_id_y", "a"), ("doc_id_y", "doc_id_x", "b"), ("n_x", "n_y", "na"), ("n_y", "n_x", "nb")))).distinct()


def _by_rows(docs: DataFrame, repeated: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, component_id) where ids repeat: rows get numbers of their own and are compared by these; rows of one id are linked.

    Only rows of the repeated ids are shuffled to find the distinct ones among them.
    """
    held = checked(repeated)
    docs = docs.where("doc_id is not null")
    rows = docs.join(held, "doc_id", "left_anti").unionByName(docs.join(held, "doc_id", "left_semi").distinct())
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = similarity_components(rows.select(F.col("row").alias("doc_id"), "text"), n, share).select(F.col("doc_id").alias("row"), "component_id")
    found = save(rows.select("row", "doc_id").join(found, "row"), "found")
    low = found.groupBy("doc_id").agg(F.min("component_id").alias("b"))
    groups = connected_components(found.join(low, "doc_id").select(F.col("component_id").alias("a"), "b"))
    of = low.join(groups, low["b"] == groups["node"], "left").select("doc_id", F.coalesce("component", "b").alias("c"))
    return of.join(of.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")


def similarity_components(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    profile = save(docs.mapInArrow(_profile(n), _PROFILE), "profile", "kind")
    own = profile.where("kind = 0").select("doc_id", "n", "a", "b")
    maps = profile.where("kind = 0").select("doc_id", "map")
    repeated = save(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.take(1):
        return own.select("doc_id", F.col("n").alias("n_shingles")).join(_by_rows(docs, repeated, n, share), "doc_id", "left")
    classes = save(own.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    # copies of a class's representative take no further part
    copies = own.where("n > 0").join(classes.where("rep < last"), ["n", "a", "b"]).where("doc_id > rep").select("doc_id").distinct()
    copies = save(copies, "copies")
    alone = docs.where("doc_id is not null").join(checked(copies), "doc_id", "left_anti")

    posts = _posts(alone, save(_counts(profile), "counts"), n, share)
    # a list's leaders: the document that shares most of its own prefix (the one that others were made from), and one by hash
    support = posts.groupBy("doc_id").agg((F.count("*") / F.first("n")).alias("support"))
    led = Window.partitionBy("token", "salt", "band")
    me = F.struct("doc_id", "n", "place")
    ranked = posts.join(support, "doc_id").withColumns({"by_share": F.max(F.struct("support", me.alias("x"))).over(led)["x"], "by_hash": F.min(F.struct(F.xxhash64("doc_id").alias("h"), me.alias("x"))).over(led)["x"]})
    rows = ranked.select(me.alias("x"), F.explode(F.array("by_share", "by_hash")).alias("y")).select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("doc_id", "n", "place")))
    first = save(_pairs(rows.where("doc_id_x <> doc_id_y").where(_may_link(share))), "pairs")
    longs = lambda c, n=MAP_BITS // 64: [F.col(c)[k] for k in range(n)]
    pair, folds = ("a", "b", "na", "nb"), range(FOLD_BITS // 64)
    folded = first.join(checked(_folded(maps, "a"), FOLDS_HELD), "a").join(checked(_folded(maps, "b"), FOLDS_HELD), "b")
    near = save(folded.where(_maps_agree(F.col("na"), F.col("nb"), [F.col(f"a{k}") for k in folds], [F.col(f"b{k}") for k in folds], share)).select(*pair), "folded")
    mapped = near.join(maps.select(F.col("doc_id").alias("a"), F.col("map").alias("x")), "a").join(maps.select(F.col("doc_id").alias("b"), F.col("map").alias("y")), "b")
    near = save(mapped.where(_maps_agree(F.col("na"), F.col("nb"), longs("x"), longs("y"), share)).select(*pair), "near")
    groups = save(connected_components(_links(docs, near, share, n)), "groups")

    # what the leaders did not settle: lists that still hold several components, each row with its map, in blocks
    mine = posts.select("token", "doc_id", "n", "place").join(groups, posts["doc_id"] == groups["node"], "left").select("token", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("component"))
    open_ = mine.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high").select("token", "blocks")
    mine = mine.join(checked(save(open_, "lists")), "token").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    mine = save(mine.join(maps, "doc_id"), "open")
    # a list of k blocks is compared k times, each time with one of its blocks on the one side
    x, y = (mine.select("token", side.alias("block"), *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "place", "component", "map"))) for s, side in (("x", F.col("block")), ("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))))
    may = (F.col("component_x") < F.col("component_y")) & _may_link(share) & _maps_agree(F.col("n_x"), F.col("n_y"), longs("map_x"), longs("map_y"), share)
    rest = x.withColumnsRenamed({"token": "token_x", "block": "block_x"}).join(y, (F.col("token_x") == F.col("token")) & (F.col("block_x") == F.col("block")) & may)
    rest = save(_pairs(rest).join(first.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        more = _links(docs, rest, share, n)
        groups = save(connected_components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))), "groups")
    classes = classes.join(groups, classes["rep"] == groups["node"], "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    out = own.join(classes, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out


def keep_one(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component; columns as they came. A row with a null doc_id stays."""
    found = similarity_components(docs, n, share)
    drop = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(checked(save(drop, "drop")), "doc_id", "left_anti").select(docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE_SQL = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS root FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
}
