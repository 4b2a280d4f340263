"""Quality classifier: perplexity under an n-gram model of trusted text, against a quantile of each language.

The model is an interpolated modified Kneser-Ney model of UTF-8 bytes, one for each language, trained on all trusted
documents but a held-out part. Its counts are grouped and joined as tables: n-grams, their contexts and the discounts
from the counts of counts, order by order. The n-grams of the corpus are gathered from all documents, and the count
tables are joined to them shard by shard, so that each gets its probability by backing off through the orders.
Scored n-grams are held by each task if there are few enough (HELD_GRAMS); else every document's n-grams are joined with them.
A document is rejected if its perplexity per byte exceeds the threshold of its language: the QUANTILE of the held-out trusted
documents, in every language in the same way (see `thresholds`). Repetition looks like good text to a model of a few bytes: a
document is rejected as well if of its word pairs a larger share has stood in it before than trusted documents have; that
decision has a column of its own.

Defined results: a null or empty text has a null perplexity and is rejected; a null language counts as one of its own;
a language without trusted text has no threshold, and its documents are only held against the share of repeated pairs (one
with trusted text of which none was held out gets the quantile of all languages);
a document with contradicting labels is not trusted; rows with null ids are scored but not trusted; repeated rows each
give a row; extra columns are kept by `keep_good`. Empty tables give empty results, and without labels all text is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import checked, save, table
from vigilake.llm.words import NOT_SPACE, slices, windows, words

ORDER, QUANTILE = 5, 0.98
#: One in HELD_OUT trusted documents sets the threshold and does not train; so many held-out texts weigh as much as all languages' spread.
HELD_OUT, DRAWN = 5, 200
#: Texts with at most this share of repeated word pairs are never rejected for them; none are where nothing is trusted.
REPEATED = 0.3
#: No byte is less probable than this.
LEAST_P = 1e-12
#: Scored n-grams (12 bytes each, 36 MB) that the driver collects and a task may hold.
HELD_GRAMS = 3_000_000
#: Tasks that write a table with a row for each language.
FEW = 8
#: Distinct n-grams that a task gathers before it passes them on.
GATHERED = 400_000


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows): for every byte the ORDER bytes that end there, as a number; line feeds stand before each text."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    wide = np.full(len(data) + (ORDER - 1) * len(size), 10, np.int64)
    place = np.arange(len(data)) + (ORDER - 1) * (row + 1)
    wide[place] = data
    code = np.zeros(len(wide), np.int64)
    for j in range(ORDER):
        code[ORDER - 1 :] = (code[ORDER - 1 :] << 8) | wide[j : len(wide) - ORDER + 1 + j]
    return code[place], row


def _langs(part: pa.RecordBatch) -> list[str]:
    return [x or "" for x in part.column(part.schema.get_field_index("lang")).to_pylist()]


def _gather(counts: bool):
    """(lang, gram, count) of the texts, added up for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            gram, at = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            return gram, np.bincount(at, np.concatenate([c for _, c in held[lang]]), len(gram)).astype(np.int64)

        def flush(lang: str) -> pa.RecordBatch:
            gram, count = merged(lang)
            del held[lang]
            return pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count)], ["lang", "gram", "count"])

        for part, data, offsets in slices(batches, "text", 1 << 20):
            code, row = _grams(data, offsets)
            langs = np.array(_langs(part), object)
            for lang in set(langs):
                own = code[(langs == lang)[row]]
                if len(own):
                    held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                    if sum(len(g) for g, _ in held[lang]) > GATHERED:
                        held[lang] = [merged(lang)]
                        if len(held[lang][0][0]) > GATHERED // 2:
                            yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    found = lambda docs: docs.select("lang", "text").mapInArrow(run, "lang string, gram long, count long")
    return lambda docs: found(docs).groupBy("lang", "gram").agg(F.sum("count").alias("c")) if counts else found(docs).select("lang", "gram").distinct()


def _suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def train(docs: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model from docs (text, lang): for each order from 1 to ORDER its n-grams (lang, gram, alpha) and contexts (lang, context, gamma).

    Below the highest order an n-gram counts as often as there are distinct bytes before it.
    """
    counts, orders = save(_gather(True)(docs), "grams"), []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            counts = save(counts.groupBy("lang", _suffix(F.col("gram"), n).alias("gram")).agg(F.count("*").alias("c")), "grams")
        of = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        discount = lambda i: F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.0), i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"))).otherwise(i * 0.5).alias(f"d{i}")  # noqa: E731,B023
        # a row for each language, found once for all that is joined with it, and in few tasks
        discounts = save(counts.groupBy("lang").agg(*of).select("lang", *(discount(i) for i in (1, 2, 3))).coalesce(FEW), "discounts")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = counts.join(checked(discounts), "lang").select("lang", "gram", F.shiftright("gram", 8).alias("context"), "c", d.alias("d"))
        contexts = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        grams = cut.join(contexts, ["lang", "context"]).select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
        orders.append((save(grams, "alpha"), save(contexts.select("lang", "context", "gamma"), "gamma")))
    return orders[::-1]


def score(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """grams (lang, gram) of ORDER bytes with logp, the natural logarithm of the last byte's probability after the others."""
    out = grams.select("lang", "gram", F.lit(1 / 256).alias("p"))
    for n, (alpha, gamma) in enumerate(model, 1):
        out = out.withColumns({"__gram": _suffix(F.col("gram"), n), "__context": F.shiftright(_suffix(F.col("gram"), n), 8)})
        out = out.join(alpha.withColumnRenamed("gram", "__gram"), ["lang", "__gram"], "left").join(gamma.withColumnRenamed("context", "__context"), ["lang", "__context"], "left")
        out = out.select("lang", "gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    # where discounts are zero, nothing may be left for a byte that was never seen there
    return out.select("lang", "gram", F.log(F.greatest("p", F.lit(LEAST_P))).alias("logp"))


def _repeated(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the share of its word pairs that have stood in it before."""
    h, _, _, rows = words(data, offsets, NOT_SPACE)
    pairs, out = windows(h, 2), np.zeros(len(offsets) - 1)
    for r, (a, b) in enumerate(zip(rows[:-1], rows[1:] - 1, strict=True)):
        if b > a:
            out[r] = 1 - len(np.unique(pairs[a:b])) / (b - a)
    return out


def _with_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        yield pa.record_batch([*part.columns, pa.array(_repeated(data, offsets))], [*part.schema.names, "__repeated"])


def _perplexity(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value
        for part, data, offsets in slices(batches, "text", 1 << 20):
            code, row = _grams(data, offsets)
            langs, logp = np.array(_langs(part), object), np.zeros(len(code))
            for lang in set(langs):
                own = (langs == lang)[row]
                gram, value = tables.get(lang, (np.zeros(1, np.int64), np.full(1, -np.log(256), np.float32)))
                logp[own] = value[np.minimum(np.searchsorted(gram, code[own]), len(gram) - 1)]
            total = np.concatenate(([0.0], np.cumsum(logp)))[offsets]
            size = np.diff(offsets)
            mean = np.diff(total) / np.maximum(size, 1)
            yield pa.record_batch([*part.columns, pa.array(_repeated(data, offsets)), pa.array(np.exp(-mean), mask=size == 0)], [*part.schema.names, "__repeated", "__perplexity"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, lang, gram, count) of every text by itself."""
    for part, data, offsets in slices(batches, "text", 1 << 18):
        code, row = _grams(data, offsets)
        for r, lang in enumerate(_langs(part)):
            gram, count = np.unique(code[offsets[r] : offsets[r + 1]], return_counts=True)
            yield pa.record_batch([pa.array([part.column(0)[r].as_py()] * len(gram), pa.int64()), pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count.astype(np.int64))], ["uid", "lang", "gram", "count"])


def _tables(scores: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each language the n-grams, sorted, with their logp: scores has HELD_GRAMS rows at most, and so few bytes are collected for each that the driver holds them."""
    langs = [r.lang for r in scores.select("lang").distinct().collect()]
    if not langs:
        return {}
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("short").alias("code")
    got = scores.select(code, "gram", F.col("logp").cast("float").alias("logp")).toArrow()
    code, gram, logp = (got.column(c).to_numpy() for c in ("code", "gram", "logp"))
    del got
    order = np.lexsort((gram, code))
    ends = np.searchsorted(code[order], np.arange(1, len(langs) + 2))
    return {x: (gram[order[a:b]], logp[order[a:b]]) for x, a, b in zip(langs, ends[:-1], ends[1:], strict=True)}


class Scorer:
    """Adds the columns __repeated and __perplexity to documents whose n-grams have been scored."""

    def __init__(self, docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], held: int = HELD_GRAMS):
        self.scores = save(score(_gather(False)(docs), model), "scores")
        self.held = None
        if self.scores.limit(held + 1).count() <= held:
            self.held = docs.sparkSession.sparkContext.broadcast(_tables(self.scores))

    def __call__(self, docs: DataFrame) -> DataFrame:
        repeated = T.StructType([*docs.schema.fields, T.StructField("__repeated", T.DoubleType())])
        if self.held:
            return docs.mapInArrow(_perplexity(self.held), T.StructType([*repeated.fields, T.StructField("__perplexity", T.DoubleType())]))
        docs = save(docs.mapInArrow(_with_repeated, repeated).withColumn("__uid", F.monotonically_increasing_id()), "numbered")
        grams = docs.select(F.col("__uid").alias("uid"), "lang", "text").mapInArrow(_each, "uid long, lang string, gram long, count long")
        mean = grams.join(self.scores, ["lang", "gram"]).groupBy("uid").agg(F.exp(-F.sum(F.col("logp") * F.col("count")) / F.sum("count")).alias("__perplexity"))
        return docs.join(mean.withColumnRenamed("uid", "__uid"), "__uid", "left").drop("__uid")


def thresholds(scored: DataFrame, languages: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(__lang, __threshold) for each of languages (__lang) from held-out perplexities scored (__lang, __perplexity, not null).

    The language's own quantile, drawn towards what its median and the spread of all languages say: of n held-out texts the
    weight is n / (n + DRAWN). So a language of three texts has a threshold that is not its worst one, and one of thousands its own.
    A language without held-out texts gets the quantile of all.
    """
    own = scored.groupBy("__lang").agg(F.percentile("__perplexity", F.lit(quantile)).alias("own"), F.percentile("__perplexity", F.lit(0.5)).alias("middle"), F.count("*").alias("n"))
    spread = scored.join(checked(own.select("__lang", "middle")), "__lang").agg(F.percentile(F.round(F.col("__perplexity") / F.col("middle"), 4), F.lit(quantile)).alias("spread"), F.percentile("__perplexity", F.lit(quantile)).alias("all"))
    weight = F.col("n") / (F.col("n") + DRAWN)
    value = F.coalesce(weight * F.col("own") + (1 - weight) * F.col("middle") * F.col("spread"), F.col("all"))
    return languages.join(own, "__lang", "left").crossJoin(F.broadcast(spread)).select("__lang", F.round(value, 4).alias("__threshold"))  # spread: one row


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, held: int = HELD_GRAMS) -> DataFrame:
    """docs (doc_id, text, lang, ...) with __perplexity, __threshold, __repetitive and __keep. Trusted: labels' quality 1 and toxic not 1."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    good = checked(save(good, "trusted"))
    slim = docs.select("doc_id", "lang", "text")
    trusted = slim.join(good, "doc_id", "left_semi").withColumn("__lang", F.coalesce("lang", F.lit("")))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT))
    scorer = Scorer(slim, train(trusted.where(part > 0)), held)
    scored = scorer(trusted.where(part == 0)).select("__lang", "__repeated", "__perplexity")
    # rounded, so that the exact quantile counts a bounded number of distinct values
    scored = save(scored.where("__perplexity is not null").select("__lang", F.round("__repeated", 4).alias("__repeated"), F.round("__perplexity", 4).alias("__perplexity")), "held_out")
    languages = save(trusted.where("text <> ''").select("__lang").distinct(), "languages")
    bound = thresholds(scored, languages, quantile)
    most = scored.agg(F.percentile("__repeated", F.lit(quantile))).first()[0]
    repetitive = F.col("__repeated") > max(most or 0, REPEATED) if languages.take(1) else F.lit(False)
    out = scorer(docs).withColumn("__lang", F.coalesce("lang", F.lit(""))).join(checked(save(bound, "bounds")), "__lang", "left")
    keep = F.col("__perplexity").isNotNull() & (F.col("__threshold").isNull() | (F.round("__perplexity", 4) <= F.col("__threshold")))
    return out.select(*docs.columns, "__perplexity", "__threshold", repetitive.alias("__repetitive"), (keep & ~repetitive).alias("__keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without those that the classifier rejects; columns as they came."""
    return judged(docs, labels, quantile).where("__keep").select(docs.columns)


def op9_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "lang", F.round("__perplexity", 4).alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__repetitive").alias("repetitive"), F.col("__keep").alias("keep"))


QUERIES = {"op9_quality_lm": op9_quality_lm}
ORACLE_SQL: dict[str, str] = {}
