import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import flatgraph, mtree

NAN, INF = float("nan"), float("inf")


def vectors(n=500, seed=0, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:150] = (x[0] + 0.05 * rng.normal(size=(100, dim)))[: len(x[50:150])]  # one dense group
    for i in range(200, min(260, n)):
        x[i] = x[i - 60] * 2 + 0.02 * rng.normal(size=dim)
    if n > 310:
        x[300:310] = x[310]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], int(i % 3) if i % 50 else None, "s") for i in range(n)]
    extra = [None, [], [0.0] * dim, [NAN] * dim, [INF] + [0.0] * (dim - 1), [1.0, None] + [0.0] * (dim - 2), rows[60][1], rows[60][1]]
    return rows + [(n + i, v, 0, "s") for i, v in enumerate(extra)] + [(n + 20, rows[60][1][:6], 0, "s")]


def brute(rows, threshold=0.98):
    ok = {i: (np.array(v, float), lab) for i, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    n, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    dim = max(len(v) for v, _ in ok.values())
    ids = sorted(ok)
    x = np.zeros((len(ids), dim))
    for k, i in enumerate(ids):
        x[k, : len(ok[i][0])] = ok[i][0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if ok[ids[a]][1] == ok[ids[b]][1] and s[a, b] >= threshold:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = sorted((root(ids[a]), root(ids[b])))
                parent[q] = p
    return n, {i: root(i) for i in parent}


@pytest.mark.parametrize("shard_size", [3000, 60])
def test_flat_graph(spark, shard_size):
    rows = vectors()
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, shard string")
    got = flatgraph.near_duplicates(d, per_shard=60, shard_size=shard_size).collect()
    n, comp = brute(rows)
    assert len(got) == len(rows)
    assert {r.id: r.n_links for r in got} == n and {r.id: r.component_id for r in got} == comp
    assert got[0].audit_recall >= 0.9 and got[0].audit_recall_linked >= 0.9


def clustered(n=1200, groups=150, dim=16, seed=2):
    """One label holds all: groups of near-duplicates around centres of their own."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + 0.03 * rng.normal(size=(n, dim))
    return [(i, [float(v) for v in x[i]], 1, "s") for i in range(n)]


def test_shards_of_one_label_stay_small(spark):
    """All vectors under one label, far more than a shard holds: shards are clustered further, none stays large, and links are found."""
    rows = clustered()
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, shard string")
    start = d.select(F.col("vec_id").alias("node"), "label", F.lit(1).cast("bigint").alias("mult"), F.col("embedding").alias("e"), F.lit("0").alias("shard"))
    from graphloom.llm.common import materialize

    placed, sizes = flatgraph.shards_of(materialize(start), 0.98, 50, 150, 16)
    most = sizes.agg(F.max("n")).first()[0]
    assert most <= 150 and placed.select("node").distinct().count() == len(rows)
    n, comp = brute(rows)
    got = flatgraph.near_duplicates(d, per_shard=50, shard_size=150, centroids=1).collect()
    found, true = sum(r.n_links for r in got), sum(n.values())
    assert true > 3000 and found >= 0.99 * true and all(r.n_links <= n[r.id] for r in got)
    assert sum(comp[r.id] == r.component_id for r in got) >= 0.99 * len(rows)


def test_less_recall_is_never_returned(spark, monkeypatch):
    """A search that finds nothing is seen by the audit, and the exact comparison takes its place."""
    rows = clustered(400, 40)
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, shard string")
    beams, whole = [], flatgraph._searched

    def blind(placed, sizes, threshold, width, shard_size, beam):
        beams.append(beam)
        return whole(placed, sizes, threshold if beam is None else 2.0, width, shard_size, beam)

    monkeypatch.setattr(flatgraph, "_searched", blind)
    got = flatgraph.near_duplicates(d, shard_size=100).collect()
    n, comp = brute(rows)
    assert beams == [32, 256, None] and {r.id: r.n_links for r in got} == n and {r.id: r.component_id for r in got} == comp and got[0].audit_recall == 1.0


def test_two_vectors_of_one_hash(spark, monkeypatch):
    """Where hashes of vectors meet, nodes are numbered; nothing is merged."""
    whole, seen = flatgraph.materialize, []

    def meet(df, name="cut"):
        if name == "nodes" and not seen:
            seen.append(1)
            return whole(df.withColumn("node", F.lit(5).cast("bigint")), name)
        return whole(df, name)

    monkeypatch.setattr(flatgraph, "materialize", meet)
    rows = vectors(120)
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, shard string")
    n, comp = brute(rows)
    got = flatgraph.near_duplicates(d).collect()
    assert {r.id: r.n_links for r in got} == n and {r.id: r.component_id for r in got} == comp


def test_flat_graph_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert flatgraph.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = flatgraph.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], kind)).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]


def large(seed):
    """Vectors of mixed size: usual ones, whole numbers beyond what doubles' products hold, near ties among them, and the ends of what a float is."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, "s") for i in range(120)]
    for i in range(0, 120, 3):
        rows[i] = (i, [float(np.float32(x)) for x in rng.integers(-(10**9), 10**9, 6)], 0, "s")
    rows[0] = (0, [5000.0, 1.0], 0, "s")
    rows[50] = (50, [float(np.float32(3e38))] * 6, 0, "s")
    rows[51] = (51, [float(np.float32(-3e38))] * 6, 0, "s")
    for i in range(60, 66):
        rows[i] = (i, [2.0**30, 2.0**30, 1.0 + i / 256, 0.0, 0.0, 0.0], 0, "s")
    return rows


@pytest.mark.parametrize("block,shard,page,tasks,made", [(2048, 4096, 512, 64, vectors), (4, 70, 8, 2, vectors), (8, 30, 4, 1, lambda: large(1)), (100, 4096, 64, 64, lambda: large(2))])
def test_top_k(spark, block, shard, page, tasks, made):
    rows = made()
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, shard string")
    got = {}
    for r in mtree.top_k(d, F.col("id") % 50 == 0, block=block, shard_rows=shard, page=page, trees_a_task=tasks).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, *_ in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q in ok:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=False)), i) for i in ok if i != q)
            want[q] = [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scores[:5]]
    assert got == want


def test_top_k_of_few(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (3, [2.0]), (None, [1.0])], kind)
    assert [tuple(r) for r in mtree.top_k(two, F.col("id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 3, 131072), (0, 2, 3, 131072)]


def test_tree_passes_over_pages():
    """In clustered points, a search computes scores for few pages."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 8)).repeat(100, axis=0) + 0.01 * rng.normal(size=(4000, 8))))
    t = mtree.MTree(np.arange(4000), x, page=64)
    seen = []
    points = t.points

    class Watch:
        def __getitem__(self, rows):
            seen.append(len(points[rows]))
            return points[rows]

    t.points = Watch()
    best = t.search(x[5], 5, 5, [])
    s = x @ x[5]
    want = sorted(((-int(s[i]), i) for i in range(4000) if i != 5))[:5]
    assert sorted((-a, -b) for a, b in best) == want
    assert sum(seen) < 2500


def test_trees_of_huge_doubles():
    """Components up to the end of doubles: squares would overflow, so points are scaled for the tree, and scores are Python's integers."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 4)) * 10.0 ** rng.integers(0, 300, size=(300, 1)))
    t = mtree.MTree(np.arange(300), x, page=8)
    for q in (*x[:20], np.array([1.0, -2.0, 3.0, 0.0])):
        whole = [sum(int(a) * int(b) for a, b in zip(q, p, strict=True)) for p in x]
        want = sorted((-s, i) for i, s in enumerate(whole) if i != 7)[:5]
        assert sorted((-a, -b) for a, b in t.search(q, 7, 5, [])) == want


def test_order_of_scores_beyond_a_bigint():
    scores = [-(10**40), -(10**39) - 1, -(2**63) - 1, -(2**63), 0, 2**63 - 1, 2**63, 10**39, 10**40]
    keys = [(max(-(2**63), min(2**63 - 1, s)), mtree.beyond(s)) for s in scores]
    assert keys == sorted(keys)
