"""The manifest, the clusters and MinHash near-dedup against brute force, on tables with nulls, ties, repeated rows and odd columns."""

import math
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, TEXTS, components

from vigilake.llm import ball_tree, merkle_manifest, minhash_dedup
from vigilake.llm.common import save

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# the manifest

ROWS = [*((i, f"Text {i} ÄB" * (i % 3), "en" if i % 7 else None, "a", i) for i in range(300)), *((i, "X", "de", "b", None) for i in range(1000, 1017)), (5000, None, None, "lone", 1), (5001, "Up", "en", None, 2), (None, "Nil", "en", "b", 3), (1003, "X", "de", "b", None), (1003, "Other", "de", "b", None), (7, "Ö" * 50_000, "en", "ä", 4)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tree(nodes):
    """The top of nodes (16 to a run) and every node's siblings, level by level."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            steps[k].append((run[: i % 16], run[i % 16 + 1 :]))
        at = [i // 16 for i in at]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def proven(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, source, n: H(*map(field, (i, source, lang, n, t)))
    by = {}
    for r in rows:
        by.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    order = sorted(by)
    done = {s: tree([leaf(*r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for s in order}
    root, upper = tree([done[s][0] for s in order])
    for k, s in enumerate(order):
        for r, steps in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))), done[s][1]):
            steps = steps + upper[k]
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            f = leaf(r[0], r[1].translate(ASCII), *r[2:]) if forged else leaf(*r)
            for left, right in steps:
                f = H(*left, f, *right)
            yield (r[0], leaf(*r), done[s][0], root, H(*(x for a, b in steps for x in (*a, *b))), f, f == root)


def manifest(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"grp": F.lit("g"), "idx": F.lit(1), "n": F.lit(2), "children": F.lit(None).cast("string"), "tie": F.lit(0)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return merkle_manifest.op11_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:16], ROWS[:17], [(i, "t", None, f"s{i}", None) for i in range(40)]])
def test_manifest(spark, tmp_path, rows):
    out = manifest(spark, tmp_path, rows)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, proven(rows)))


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest(spark, tmp_path, []).collect() == []


def test_a_manifest_finds_what_was_changed(spark):
    """Proofs of the old rows against rows of which one field was changed: just those fail."""
    docs = spark.createDataFrame(ROWS, DOCS)
    changed = merkle_manifest.leaf(n_chars=F.when(F.col("doc_id") % 50 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    m = merkle_manifest.manifest(docs, changed)
    bad = m.where(merkle_manifest.folded(F.col("forged"), F.col("steps")) != F.lower(F.hex("root"))).select("doc_id").collect()
    assert sorted(r.doc_id for r in bad) == [1, 51, 101, 151, 201, 251, 5001]


# clusters


def lloyd(vectors, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**20 for x in v)]
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (H(f"1:{r[0]}"), r[1]))[:k]]
    if not centroids:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda j: far(v, centroids[j]))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    found = [(i, j := near(v), far(v, centroids[j])) for i, v in kept]
    return [(i, j, d, sum(x for _, y, x in found if y == j), sum(x for *_, x in found), H(",".join(map(str, centroids[j])))) for i, j, d in found]


def balls(n=700):
    """Vectors near few places, so that whole balls go to one centroid, with ties, copies and vectors that are left out."""
    rng = np.random.default_rng(5)
    places = rng.normal(0, 3, (9, 64))
    out = [(i, [float(np.float32(x)) for x in places[i % 9] + rng.normal(0, 0.02, 64)]) for i in range(n)]
    bad = [math.nan, math.inf, -math.inf, None, 2.0**20]
    out += [(n + i, [x, *[0.5] * 63]) for i, x in enumerate(bad)] + [(n + 10, None), (n + 11, []), (n + 12, [0.0] * 63), (n + 13, [0.0] * 65), (None, [-1.5] * 64), *[(3, v) for _, v in out[4:5]] * 2, (n + 14, [2.0**20 - 1] * 64), (n + 15, [-(2.0**20) + 1] * 64)]
    return out


@pytest.mark.parametrize("vectors", [balls(), balls(0), balls(12), [(i, [i / 64] * 64) for i in range(10)], [(i, [1.0] * 64) for i in range(40)], [(None, [1.0] * 64)], [(1, None)]])
def test_clusters(spark, tmp_path, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit(1), "distance": F.lit("x"), "n": F.lit(0)})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = ball_tree.op12_centroid_clustering(spark, str(tmp_path))
    got = [tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, lloyd(vectors)))


def test_whole_balls_are_taken_unseen(spark):
    import pyarrow as pa

    vectors = [v for v in balls(2000) if v[1] and len(v[1]) == 64 and None not in v[1] and max(map(abs, v[1])) < 100]
    tree = ball_tree._tree(pa.array(range(len(vectors))), np.floor(np.array([v for _, v in vectors]) * 64).astype(np.int64))
    points, sums = (np.frombuffer(tree[k], kind).reshape(-1, 64).astype(np.int64) for k, kind in ((1, np.int32), (4, np.int64)))
    starts, ends = np.array(tree[2]), np.array(tree[3])
    centroids = points[:: len(points) // 9][:9]
    whole, owner, leaves = ball_tree.descended(starts, ends, sums, np.array(tree[5]), centroids)
    assert (ends - starts)[whole].sum() > 0.5 * len(points) and (ends - starts)[whole].sum() + (ends - starts)[leaves].sum() == len(points)
    for k, o in zip(whole, owner):
        assert (ball_tree._squares(points[starts[k] : ends[k]], centroids).argmin(1) == o).all() and (points[starts[k] : ends[k]].sum(0) == sums[k]).all()


def test_many_trees(spark, monkeypatch):
    """More vectors to a task than a tree holds, and values beyond exact floats."""
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.normal(0, 1, 64) * (1e5 if i % 2 else 1)).tolist()) for i in range(9000)]
    df = save(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1), "vectors")
    found, centroids = ball_tree.clustered(df)
    x = np.floor(np.array([v for _, v in vectors]) * 64).astype(np.int64)
    far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    assert {(r.vec_id, r.cluster, r.distance) for r in found.collect()} == {(i, int(d.argmin()), int(d.min())) for i, d in enumerate(far)}


# MinHash near-dedup


def near_texts():
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(3000)}"
    out = [*TEXTS]
    for family in range(12):
        base = [word() for _ in range(int(rng.integers(3, 400)))]
        for k in range(8):
            own = list(base)
            for _ in range(int(len(base) * 0.02 * k) + (k > 0)):
                own[int(rng.integers(len(own)))] = word()
            out.append((100 + 10 * family + k, " ".join(own), "s", "en"))
    # chains of links, exactly at the threshold and just below: 9 shingles, of which 8 are shared (8 of 10), or 7 (7 of 11)
    out += [(300 + i, " ".join(f"c{j}" for j in range(i, i + 10)), "s", "en") for i in range(6)] + [(320 + 2 * i, " ".join(f"d{j}" for j in range(2 * i, 2 * i + 10)), "s", "en") for i in range(4)]
    # an id with two texts, and one of which a row has no words
    return out + [(400, out[-1][1], "s", "en"), (400, "some other text of few words", "s", "en"), (401, "some other text of few words", "s", "en"), (402, "", "s", "en"), (402, "e f g h", "s", "en"), (399, "e f g h", "s", "en")]


@pytest.mark.parametrize("block", [minhash_dedup.BLOCK, 1])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = near_texts()
    df = spark.createDataFrame(texts, SCHEMA).withColumns({"n": F.lit(1), "node": F.lit(2), "rep": F.lit("r"), "keys": F.lit(0), "h1": F.lit(3)})
    got = [tuple(r) for r in minhash_dedup.similarity_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, components(texts, 2, 80)))
    kept = minhash_dedup.dedup(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in components(texts, 2, 80) if i == c or i is None}


def test_minhash_of_nothing(spark):
    assert minhash_dedup.similarity_components(spark.createDataFrame([], SCHEMA)).collect() == []
    none = [tuple(r) for r in minhash_dedup.similarity_components(spark.createDataFrame([(1, None, "a", "b"), (2, " ", "a", "b")], SCHEMA)).collect()]
    assert sorted(none) == [(1, 0, 1), (2, 0, 2)]


def test_signatures_estimate_similarity():
    """Bins agree as often as sets are similar, also where most bins are empty; pairs at the threshold pass the sketch."""
    rng, place = np.random.default_rng(8), minhash_dedup._orders(minhash_dedup.BINS)
    for both, own in ((4, 1), (40, 5), (400, 50), (4000, 500)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 2**64, both + own, dtype=np.uint64)
            y = np.concatenate((x[:both], rng.integers(0, 2**64, own, dtype=np.uint64)))
            s, t = (minhash_dedup.signature(np.unique(v), place) for v in (x, y))
            agree.append((s == t).mean())
        assert abs(np.mean(agree) - both / (both + 2 * own)) < 0.06
    one = minhash_dedup.signature(np.array([5], np.uint64), place)
    assert (one == 5).all()
