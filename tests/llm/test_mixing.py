import re

from graphloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Plain re-sharing: whoever is above its cap stops there, what is left goes round by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(w[s] for s in open_)
        rest = left - sum(cap * sizes[s] for s in full)
        over = [s for s in open_ if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else rest * w[s] / total for s in order}
        full |= set(over)


def run(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    return mixing.mix(d).collect()


def check(rows, got):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = {}, {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert sorted((str(r.id), r.size) for r in got) == sorted((str(i), count(t)) for i, t, _, _ in rows)
    return taken, want, largest


def test_mix(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 400), f"s{i % 5}" if i % 3 else "s0", "x") for i in range(600)]
    rows += [(None, "a b", None, "x"), (7, None, "s1", "x"), (7, None, "s1", "x"), (8, "  ", "é", "x"), (9, "x" * 50_000, "😀", "x"), (9, "x" * 50_000, "😀", "x")]
    got = run(spark, rows)
    taken, want, largest = check(rows, got)
    for s in ("s0", "s1", "s2", "s3", "s4"):
        assert abs(taken[s] - want[s]) <= 0.01 * want[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, run(spark, rows[::-1])), key=str)


def test_copies_only(spark):
    rows = [(i, "the same words here", "a" if i % 3 else "b", "x") for i in range(300)]
    taken, want, _ = check(rows, run(spark, rows))
    assert all(abs(taken[s] - want[s]) <= 4 for s in want)


def test_whole_numbers_and_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    one = run(spark, [(1, None, "a", "x")])
    assert [(r.size, r.copies) for r in one] == [(0, 1)]
    three = run(spark, [(1, "a b c", "only", "x")])
    assert [(r.copies, r.target) for r in three] == [(1, 3.0)]


def test_dual_and_copies_against_plain_python(spark):
    """Multipliers by bisection, one source at a time; copies sum up near the target even where one document is far longer than all others."""
    import math
    import random

    rng = random.Random(3)
    hist = [(s, n, rng.randrange(1, 40)) for s in ("a", "b", None, "c") for n in sorted({rng.randrange(1, 300) for _ in range(60)})] + [("a", 50_000, 1), ("b", 0, 5), ("d", 7, 3)]
    d = spark.createDataFrame(hist, "source string, size bigint, n bigint")
    h = d.withColumnRenamed("source", "h_source")
    goal = mixing.source_targets(d)
    duals = mixing.multipliers(h, goal)
    copies = {(r.source, r.size): r.copies for r in mixing.planned_copies(h, duals, goal).collect()}
    lam = {r.source: r.lam for r in duals.collect()}
    for r in goal.collect():
        mine = [(size, n) for s, size, n in hist if s == r.source]
        mean = r.source_size / r.documents
        words = lambda x, mine=mine, mean=mean: sum(n * size * min(3.0, math.exp(min(700, x * size / mean))) for size, n in mine)
        assert all(0 <= copies[r.source, size] <= 3 * n for size, n in mine)
        if r.target < 3 * r.source_size:
            low, high = -200.0, 200.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if words(mid) < r.target else (low, mid)
            assert abs(lam[r.source] - low) < 1e-5 * (1 + abs(low)) or abs(words(lam[r.source]) - r.target) < 1e-6 * r.target
        taken = sum(copies[r.source, size] * size for size, _ in mine)
        assert abs(taken - r.target) <= max(10, min(s for s, _ in mine if s))
    assert copies["b", 0] == 5


def test_many_sources(spark):
    """More sources than ranges of the sort: ranks and running sums agree with plain Python."""
    rows = [(f"site{i:05d}" if i else None, 1 + i % 97, 1) for i in range(3000)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint, n bigint").repartition(7)).collect()}
    want = targets({s: n for s, n, _ in rows})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * want[s] for s in want)


def test_query_against_plain_python(spark):
    from graphloom.llm.queries import op7_mix

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()
    count = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source, sizes = {d.doc_id: d.source for d in docs}, {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + count[d.doc_id]
    want, taken = targets(sizes), {}
    for r in op7_mix(spark, "/root/testdata/sf0.001").collect():
        s = source[r.doc_id]
        assert r.size == count[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    # A source of a few documents can't come nearer than its documents' sizes allow.
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + max(n for d, n in count.items() if source[d] == s) / 2 for s in want)
