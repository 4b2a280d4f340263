"""The n-gram join gives the same result however many n-grams are ranked, and however often long lists make it rank anew."""

import numpy as np
import pytest
from test_operators import SCHEMA, components

from vigilake.llm import jaccard_join

TEXTS = [(i, " ".join([*(f"w{i % 7}_{k}" for k in range(40 + i % 3)), *(f"c{k}" for k in range(8)), f"own{i // 14}"]), "s", "en") for i in range(60)]


@pytest.mark.parametrize(("held", "load"), [(1_000_000, 3), (20, 3)])
def test_any_table_gives_the_same_groups(spark, monkeypatch, held, load):
    monkeypatch.setattr(jaccard_join, "NGRAMS_HELD", held)
    monkeypatch.setattr(jaccard_join, "LEADER_LOAD", load)
    got = [tuple(r) for r in jaccard_join.similarity_components(spark.createDataFrame(TEXTS, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(components(TEXTS))


def test_long_lists_are_ranked(spark, monkeypatch):
    """n-grams of which nothing was counted beforehand are ranked by the lengths of their lists."""
    monkeypatch.setattr(jaccard_join, "LEADER_LOAD", 20)
    docs = spark.createDataFrame([(i, "a b c d e " + " ".join(f"x{i}_{k}" for k in range(20)), "s", "en") for i in range(100)], SCHEMA).select("doc_id", "text")
    nothing = spark.createDataFrame([], "token long, level short")
    with_ranks = jaccard_join._posts(docs, nothing, 5, (75, 100)).count()
    monkeypatch.setattr(jaccard_join, "RANKINGS", 1)
    without = jaccard_join._posts(docs, nothing, 5, (75, 100)).count()
    assert with_ranks == 0 and without in (0, 100)  # the shared n-gram is in every prefix, or its hash keeps it out of all of them


def test_table_of_ranks(spark):
    counts = spark.createDataFrame([(k, 100 if k < 10 else 50 if k < 1000 else 8) for k in range(3000)], "token long, level short")
    tokens, levels = jaccard_join._most_frequent(counts, 505)
    assert set(range(10)) <= set(tokens.tolist()) and 400 < len(tokens) < 600 and set(levels.tolist()) == {50, 100}
    ranks = jaccard_join._Ranks(tokens, levels)
    asked = np.array([5, 999_999_999, int(tokens[20]), 5 + (1 << jaccard_join.SIEVE_BITS)], np.uint64)
    assert ranks.of(asked).tolist() == [100, 0, 50, 0]
