"""Repeated rows and ids with several texts in the n-gram join, against brute force."""

from test_operators import SCHEMA, components

from vigilake.llm import jaccard_join


def test_repeated_ids(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # 100 shingles each, 50 in common; then an id whose second text is a near copy of another document, and one without words
    texts = [(1, words(0, 104)), (1, words(0, 104)), (2, words(50, 154)), (5, words(500, 604)), (6, words(500, 604)), (6, words(700, 804)), (7, words(702, 806)), (8, ""), (8, words(900, 950)), (None, words(0, 104))]
    texts = [(i, t, "s", "en") for i, t in texts]
    df = spark.createDataFrame(texts, SCHEMA)
    got = [tuple(r) for r in jaccard_join.similarity_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, components(texts)))
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_one(df).collect()) == [0, 1, 1, 2, 5, 8, 8]
