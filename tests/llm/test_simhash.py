import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=4):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b C", "a b c d", "É É ß X y z\x0bq", "w " * 70_000 + "end", "x" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_tree_finds_all():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for v in base for _ in range(6)})
    t = simhash.BKTree()
    for v in values:
        t.add(v)
    for v in values:
        assert sorted(t.within(v, 4)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 4]


@pytest.mark.parametrize("shard,blocks", [(1024, 5), (8, 5), (1024, 6)])
def test_links_against_all_pairs(spark, shard, blocks):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(60)} | {centre ^ (1 << i) ^ (1 << (i * 7) % 64) for i in range(50)}
    values = {v - (1 << 64) if v >> 63 else v for v in values}
    d = spark.createDataFrame([(v,) for v in values], "fp bigint")
    from graphloom.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(d, 4, blocks, shard)).collect()}
    want = groups({v: v % (1 << 64) for v in values})
    assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(400)]
    long = [" ".join(rng.choices(words, k=300)) for _ in range(6)]
    texts = [*long, *[t + " tail" for t in long[:3]], long[0], long[0].upper(), None, "", "  ", "one", "one"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, long[1], "c"), (2, long[2], "c")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")).collect()
    assert len(got) == len(rows)
    want = groups({i: brute(t) for i, t, _ in rows if i is not None})
    for r in got:
        assert r.component_id == (want[r.id] if r.id is not None else want[1])
    assert want[11] == want[12] == want[13] and want[9] == 0 == want[10]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
