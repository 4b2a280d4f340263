"""The stages of the pipeline: what each keeps, and that its decisions take effect."""

import corpus_pipeline as P
import pytest
from conftest import DATA
from test_operators import ITEMS, check_packing, components, cut_lines, scan  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "benchmarks", "packing"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages]
    for before, after in zip(ids[:-1], ids[1:]):
        assert after <= before and after


def test_near_duplicates_and_benchmarks(spark, stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {d for d, _, c in components(before) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert all(hit == 0 for _, _, hit, _ in scan([(r.doc_id, r.text) for r in stages[4].collect()], items))
    clean = {d for d, _, hit, _ in scan([(r.doc_id, r.text) for r in stages[3].collect()], items) if not hit}
    assert clean <= {r.doc_id for r in stages[4].collect()}


def test_packing(stages):
    used, least = check_packing(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()], 4096)
    assert used <= least + 1


def test_run(spark, stages):
    assert sorted(map(tuple, P.run(spark, DATA).drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


def test_lines(stages):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in stages[1].collect()]
    want = {(i, t) for i, t, _, removed in cut_lines(rows, 10) if t != "" or not removed}
    assert {(r.doc_id, r.text) for r in stages[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows and an extra column; then empty tables."""
    text = "The text of a document that is long enough for shingles of five words, and for a model to be trained on it."
    docs = [(1, text, "en", "a", 3, "x"), (1, text, "en", "a", 3, "x"), (2, None, "en", "a", None, None), (3, "", None, None, 0, "y"), (None, text + " Null.", None, "b", 1, "z"), (4, text.upper(), "en", "c", 4, "w"), (5, "word " * 30_000, "en", "d", 5, "v")]
    schema, label, item = "doc_id long, text string, lang string, source string, n_chars long, token string", "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, n in (("some", None), ("none", 0)):
        d = tmp_path / name
        for table, rows, of in (("documents", docs, schema), ("labels", [(1, 1, 0), (4, None, None), (None, 1, 0), (2, 1, 0)], label), ("benchmark", [(1, None), (None, text), (2, "nothing of the kind")], item)):
            spark.createDataFrame(rows[:n], of).write.parquet(str(d / f"{table}.parquet"))
        out = P.run(spark, str(d)).collect()
        assert (len(out) > 0) == (n is None)
    ids = {r.doc_id for r in P.run(spark, str(tmp_path / "some")).collect()}
    assert 1 in ids and not ids & {2, 3, 5}
