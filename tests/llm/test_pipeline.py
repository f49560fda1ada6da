import random

import corpus_pipeline
from graphloom.llm import simhash


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    clean = [" ".join(rng.choices(words, k=rng.randrange(60, 300))) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t)) for i, t in enumerate(clean)]
    bad = [(200 + i, " ".join(rng.choices(words, k=80)) + " loser moron loser", "en", "s1", 1) for i in range(40)]
    copies = [(300 + i, clean[i // 3], "en", "s0", 1) for i in range(30)]
    docs = spark.createDataFrame(rows + bad + copies + [(400, None, None, None, None), (401, "", "en", "s0", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in (rows + bad)[::2]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "mixing", "best-fit packing"]
    kept = docs
    steps = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(f(spark, kept, str(tmp_path)).collect(), docs.schema)
        steps.append(kept)
    tox = {r.doc_id for r in steps[0].collect()}
    assert tox == {r[0] for r in rows + copies} | {400, 401}
    groups = {r.id: r.component_id for r in simhash.near_duplicates(steps[0]).collect()}
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(set(groups.values()))
    assert not {r.doc_id for r in steps[1].collect()} & {r[0] for r in copies}
    counts = {}
    for r in steps[2].collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= set(groups.values())
    assert steps[2].columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[2], str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == sum(counts.values())
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, packed))


def test_one_row_of_each_group(spark):
    """Groups that share a doc_id, and rows without one: a row of each group stays."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400))
    a, b, c, d = (text() for _ in range(4))
    near = next(x for i in range(400) if 0 < (simhash.fingerprint(x := " ".join((w := d.split())[:i] + ["zz"] + w[i + 1 :])) ^ simhash.fingerprint(d)).bit_count() <= 4)
    rows = [(7, a), (7, b), (7, b), (3, c), (8, c), (8, c + " "), (None, d), (None, near), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.one_per_group(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text not in (d, near)) == sorted([(7, a), (7, b), (3, c)])
    assert len(got) == 4


def test_clashing_names_and_empty_tables(spark, tmp_path):
    """Extra columns come through every stage as they were, whatever their names; no documents give no sequences."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, _copy string, _fp string, _h string, _g string, nth string, size string, is_toxic string, _toxic string, _chain string, _source string"
    names = [c.split()[0] for c in kind.split(", ")][5:]
    rows = [(i, f"text number {i} with words of its own {i * 7} and {i * 13}", "en", f"s{i % 2}", 1, *[f"{n}-{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame([*rows, (5, None, None, None, None, *[None] * len(names)), (None, rows[0][1], *rows[0][2:])], kind)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(f(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.columns == docs.columns
        for r in kept.collect():
            if r.doc_id is not None and r.text is not None:
                assert tuple(r) == rows[r.doc_id]
    assert {r.doc_id for r in kept.collect()} <= set(range(12)) and kept.count() >= 10
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).where("piece = 0").count() == kept.count()
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
