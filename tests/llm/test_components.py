"""Components of a small graph: right for any shape, in few tasks and files whatever the number of shuffle partitions."""

import random

from vigilake.llm import common, quality_lm


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_any_shape(spark):
    rng = random.Random(3)
    shapes = {
        "none": [], "loops": [(1, 1), (None, 2), (3, None)], "stars": [(9, 1), (8, 1), (7, 2)], "chain": [(k, k + 1) for k in range(40)], "crossed": [(k, 100 - k) for k in range(45)] + [(k, k + 7) for k in range(0, 90, 9)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(250)], "hub": [(500, k) for k in range(200)] + [(k, k + 1000) for k in range(200)],
    }
    for name, edges in shapes.items():
        got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and dict(rows) == by_hand(edges), name


def test_small_rounds_take_few_tasks(spark, monkeypatch):
    """A round's tables have as many files as their edges need, not one for every shuffle partition."""
    files = {}

    def kept(df, name, *args, **kw):
        out = save(df, name, *args, **kw)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    save = common.save
    monkeypatch.setattr(common, "save", kept)
    monkeypatch.setattr(quality_lm, "save", kept)
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        common.connected_components(spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long"))
        quality_lm.train(spark.createDataFrame([(f"l{k}", f"text {k} of some words") for k in range(40)], "lang string, text string"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files["low"] + files["edges"][1:]) <= 2 and max(files["discounts"]) <= quality_lm.FEW
