"""Line dedup: take out lines that stand on many different sites (boilerplate).

How many distinct sites a line stands on is estimated by one HyperLogLog sketch per line hash, merged by aggregation.
Lines whose estimate is near the threshold get an exact distinct count of their sites; far ones are decided by the sketch.

A line is what stands between line feeds, without white space at its ends; blank lines are never boilerplate. All
occurrences of a boilerplate line go, with the line feed, however many of a document's lines they are. A text of which
only white space would be left becomes empty. So that a text which is copied as a whole is not lost with all of its
copies, the one with the least doc_id of two documents or more with an equal such text keeps it as it is.

Lines are known by their MD5: among 10**12 lines, two different ones are taken for one with a probability of 10**-15.

Defined results: a null text has no lines and stays null; a null source counts as no site; repeated rows are counted
once per site and each give a row (rows that repeat the id and the text of a text's keeper keep it all); a row with a
null doc_id never keeps such a text; extra columns are kept by `dedup_lines`. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import BROADCAST_ROWS, save, table
from vigilake.llm.words import slices

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers, and the relative distance from the threshold within which the count is made exact
#: (over five standard errors of 1.04 / sqrt(4096)).
LG_K, NEAR = 12, 0.1
#: A task holds at most so many keys of boilerplate lines (16 bytes each); more are joined by a shuffle.
HELD_KEYS = 500_000

_EDGES = " \t\r\x0b\x0c"


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(_EDGES))


def _key(x: Column) -> Column:
    """128 bits of the line: equal keys are taken for equal lines."""
    return F.unhex(F.md5(x))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of the lines that stand on min_sites distinct sources or more: line_key, estimate."""
    lines = docs.select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", _line(F.col("line")).alias("line")).where("line <> '' and source is not null")
    lines = lines.select(_key(F.col("line")).alias("line_key"), "source")
    sketch = lines.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LG_K)).alias("estimate"))
    sketch = save(sketch.where(F.col("estimate") >= min_sites * (1 - NEAR) - 1), "sketches")
    near = F.col("estimate") <= min_sites * (1 + NEAR) + 1
    exact = lines.join(sketch.where(near), "line_key", "left_semi").distinct().groupBy("line_key").agg(F.count("*").alias("sites"))
    exact = exact.where(F.col("sites") >= min_sites).select("line_key", F.col("sites").alias("estimate"))
    return sketch.where(~near).select("line_key", "estimate").unionByName(exact)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, held: int = HELD_KEYS, few: int = BROADCAST_ROWS) -> DataFrame:
    """docs (doc_id, text, source, ...) with the boilerplate lines cut from text, and the columns __lines and __removed (numbers of lines)."""
    common = save(boilerplate_lines(docs.select("text", "source"), min_sites).select("line_key"), "boilerplate")
    keys = common.limit(held + 1).collect()
    if len(keys) <= held:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.line_key) for r in keys))
        cut = lambda df: df.mapInArrow(_cut(known), T.StructType([*df.schema.fields, *T.StructType.fromDDL("__lines long, __removed long, __whole binary").fields]))
    else:
        cut = lambda df: _cut_by_join(df, common)
    # texts that would be empty, and of those with copies the document that keeps the text
    bare = cut(docs.select("doc_id", "text")).where("__whole is not null").select("doc_id", "__whole")
    kept = save(bare.groupBy("__whole").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("last")).where("__first < last").drop("last"), "kept")
    out = cut(docs)
    if kept.limit(few + 1).count() <= few:
        out = out.join(F.broadcast(kept), "__whole", "left")
    else:  # only the texts that would be empty are shuffled
        out = out.where("__whole is null").withColumn("__first", F.lit(None).cast(kept.schema["__first"].dataType)).unionByName(out.where("__whole is not null").join(kept, "__whole", "left"))
    stays = F.coalesce(F.col("__first") == F.col("doc_id"), F.lit(False))
    new = {"text": F.when(F.col("__whole").isNotNull() & ~stays, "").otherwise(F.col("text")), "__removed": F.when(stays, 0).otherwise(F.col("__removed")).cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in [*docs.columns, "__lines", "__removed"]))


def _without(text: str | None, hit) -> tuple[str | None, int, int, bytes | None]:
    """(text, lines, removed, whole): the text without the lines that hit (of the list of lines: True where one goes) names; if only white space is left, the text as it was, and its key."""
    parts = [] if text is None else text.split("\n")
    gone = hit(parts)
    hits = sum(gone)
    kept = "\n".join(x for x, y in zip(parts, gone, strict=True) if not y) if hits else text
    bare = hits > 0 and not kept.strip(_EDGES + "\n")
    return text if bare else kept, len(parts), hits, md5(text.encode()).digest() if bare else None


def _with_cut(part: pa.RecordBatch, rows: list[tuple], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    new, lines, removed, whole = zip(*rows, strict=True)
    columns = {name: pa.array(new, pa.string()) if name == "text" else part.column(k) for k, name in enumerate(part.schema.names) if name not in drop}
    return pa.record_batch([*columns.values(), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(whole, pa.binary())], [*columns, "__lines", "__removed", "__whole"])


def _cut(known):
    """The text without boilerplate lines, with __lines, __removed and __whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        hit = lambda parts: [bool(x := line.strip(_EDGES)) and md5(x.encode()).digest() in keys for line in parts]
        for part, _, _ in slices(batches, "text"):
            yield _with_cut(part, [_without(text, hit) for text in part.column(part.schema.get_field_index("text")).to_pylist()])

    return run


def _cut_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _cut, where __hit has the places of a text's boilerplate lines (null: none): once through its lines."""
    for part, _, _ in slices(batches, "text"):
        rows = []
        for text, spots in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "__hit")), strict=True):
            gone = set(spots or ())
            rows.append(_without(text, lambda parts: [i in gone for i in range(len(parts))]))  # noqa: B023
        yield _with_cut(part, rows, ("__hit",))


def _cut_by_join(docs: DataFrame, common: DataFrame) -> DataFrame:
    """As _cut, for more boilerplate lines than a task may hold: their places are found by a join and brought back to each text."""
    # which lines of which text: texts are keyed by their digest, so that copies are looked up once
    texts = docs.select("text").where("text is not null").withColumn("text_key", _key(F.col("text")))
    spots = texts.select("text_key", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("text_key", "at", _key(_line(F.col("line"))).alias("line_key")).distinct()
    # distinct above is per text: a line that a text repeats keeps all its places
    hit = spots.join(common, "line_key", "left_semi").groupBy("text_key").agg(F.collect_list("at").alias("__hit"))
    met = docs.withColumn("__key", _key(F.col("text"))).join(hit.withColumnRenamed("text_key", "__key"), "__key", "left").select(*docs.columns, "__hit")
    return met.mapInArrow(_cut_spots, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("__lines long, __removed long, __whole binary").fields]))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH t AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT doc_id, source, i, trim(parts[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM t)),
c AS (SELECT line FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
g AS (
  SELECT e.doc_id, count(c.line) AS hits, string_agg(t.parts[e.i], chr(10) ORDER BY e.i) FILTER (WHERE c.line IS NULL) AS kept
  FROM e JOIN t ON t.doc_id = e.doc_id LEFT JOIN c ON c.line = e.line GROUP BY e.doc_id),
k AS (
  SELECT t.doc_id, len(t.parts) AS n_lines, hits, text, coalesce(kept, '') AS kept,
         hits > 0 AND trim(coalesce(kept, ''), chr(32) || chr(9) || chr(13) || chr(11) || chr(12) || chr(10)) = '' AS bare
  FROM t JOIN g ON g.doc_id = t.doc_id),
w AS (SELECT *, bare AND doc_id = min(doc_id) OVER (PARTITION BY text) AND doc_id < max(doc_id) OVER (PARTITION BY text) AS whole FROM k),
r AS (SELECT doc_id, n_lines, CASE WHEN whole THEN 0 ELSE hits END AS n_removed, CASE WHEN whole THEN text WHEN bare THEN '' ELSE kept END AS kept FROM w)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256, length(kept) AS kept_chars FROM r
UNION ALL SELECT doc_id, 0, 0, sha256(''), 0 FROM t WHERE text IS NULL
""",
}
