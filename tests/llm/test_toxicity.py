import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity


def corpus(n, seed, words):
    rng, out = random.Random(seed), []
    for i in range(n):
        text = rng.choices(words, k=rng.choice([30, 200, 3000]))
        toxic, poor = i % 5 == 0, i % 3 == 0
        if poor:
            text += rng.choices(["zzjunk", "qqspam"], k=3)
        if toxic:
            for w in rng.sample(["idiot", "scumly", "trashing", "moronic"], 2):
                text.insert(rng.randrange(len(text)), w.upper() if rng.random() < 0.3 else w + "!")
        out.append((i, " ".join(text), int(poor), int(toxic)))
    return out


def test_held_out(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(800)]
    rows = corpus(500, 1, words)
    docs = spark.createDataFrame([(i, t, "p", True) for i, t, _, _ in rows], "doc_id bigint, text string, source string, p_extra boolean")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows[:300]] + [(None, 1, 1), (3, None, 1), (999_999, 1, 0)], "doc_id bigint, low_quality int, toxic int")
    model = toxicity.train(docs, labels, per_class=200)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, _, _, b in rows[300:] if got[i].is_toxic != bool(b)]
    assert len(got) == 500 and not wrong and got[0].p_extra is True
    poor = sum((got[i].p_low_quality >= 0.5) == bool(a) for i, _, a, _ in rows[300:])
    assert poor >= 190
    again = toxicity.train(docs, labels, per_class=200)
    assert again == model


def test_chain_sees_earlier_categories():
    """The second category is the first one, seen through noise words: its model leans on the first one's out-of-fold probability."""
    rng = np.random.default_rng(0)
    rows = [([int(x) for x in rng.integers(10, 400, 20)] + [1] * int(y), [int(y), int(y)]) for y in rng.integers(0, 2, 300)]
    model = toxicity.fit_chain(rows, ("first", "second"), features=3)
    assert len(model.chain[1]) == 1 and model.chain[1][0] > 0
    p = model.score(np.array([[sum(w.get(f, 0) for f in set(fs)) for w in model.words] for fs, _ in rows], float))
    assert ((p[:, 1] > 0.5) == np.array([y[1] for _, y in rows], bool)).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a " * 50_000)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, low_quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and not any(r.is_toxic for r in got)
    assert toxicity.score(docs.where("false"), toxicity.train(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 0, 1)], "doc_id bigint, low_quality int, toxic int")
    assert all(r.is_toxic for r in toxicity.score(docs, toxicity.train(docs, one)).collect())


def test_same_threshold_at_every_size(spark):
    """One document in ten is toxic, and half of the toxic ones say a word that one clean one in six says too: no evidence for 0.5, whether or not labels are cut per class."""
    rows = [(i, f"word{i % 7} other{i % 11} " + ("doubtful" if i % 20 == 0 or (i % 10 and i % 6 == 0) else "plain"), int(i % 10 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), t) for i, _, t in rows], "doc_id bigint, low_quality int, toxic int")
    whole, cut = (toxicity.score(docs, toxicity.train(docs, labels, per_class=n)).collect() for n in (5000, 100))
    assert not any(r.is_toxic for r in whole) and not any(r.is_toxic for r in cut)
    for name, share in (("p_toxic", 0.1), ("p_low_quality", 1 / 3)):
        for rs in (whole, cut):
            assert abs(sum(r[name] for r in rs) / len(rs) - share) < 0.07


def test_words_within_tokens():
    """A word is seen behind markup, punctuation and other scripts, and anywhere in a run without spaces, however long."""
    one = lambda w: set(toxicity.word_features(w))
    for token in ("<p>idiot</p>", "you/idiot", "foo.Idiot", "a_idiot", "(you,idiot!)", "你idiot", "x" * 500 + "idiot" + "y" * 500, "i.d-i.o.t"):
        assert toxicity.zlib.crc32(b"=idiot") in one(token), token
    assert one("天气" * 300 + "笨蛋" + "天气" * 300) - one("天气" * 300) & one("笨蛋")
    assert one("อากาศดี" * 50 + "โง่" + "อากาศดี" * 50) >= {f for f in one("โง่") if f in one("กโง่ก")} != set()
    assert len(one("q" * 20_000)) < 50
    assert one("idiot!") == one("idiot") and one("123") == one("") == set()


def test_unspaced_texts(spark):
    rng = random.Random(2)
    fill = lambda n: "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", k=n))
    rows = [(i, fill(200) + ("笨蛋" if i % 4 == 0 else "") + fill(200)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, low_quality int, toxic int")
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(160, 240))


def plain_score(model, text):
    """The chain in plain Python: distinct features of the whole text, categories one after the other."""
    import math

    seen = {f for w in (text or "").split() for f in toxicity.word_features(w)}
    p = []
    for words, chain, bias in zip(model.words, model.chain, model.bias, strict=True):
        z = bias + sum(words.get(f, 0) for f in seen) + sum(c * x for c, x in zip(chain, p, strict=True))
        p.append(round(1 / (1 + math.exp(-max(-30, min(30, z / toxicity.UNIT)))), 6))
    return p


def test_query_against_plain_chain(spark):
    from graphloom.llm.queries import op6_toxicity

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(docs, toxicity.with_low_quality(spark.read.parquet(f"{at}/labels.parquet")))
    got = {r.doc_id: r for r in op6_toxicity(spark, at).collect()}
    for d in docs.collect():
        low, bad = plain_score(model, d.text)
        r = got.pop(d.doc_id)
        assert abs(r.p_low_quality - low) < 2e-6 and abs(r.p_toxic - bad) < 2e-6 and r.is_toxic == (r.p_toxic >= 0.5)
    assert not got


def test_names_that_clash(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a b", "mine", "too")], "doc_id bigint, text string, _chain string, chain string")
    model = toxicity.fit_chain([], ("low_quality", "toxic"))
    got = toxicity.score(docs, model).collect()[0]
    assert (got["_chain"], got["chain"], got["is_toxic"]) == ("mine", "too", False)
    for name in ("is_toxic", "P_toxic"):
        with pytest.raises(ValueError):
            toxicity.score(docs.withColumn(name, F.lit("text")), model)


def test_repeated_ids_are_one_row_of_the_sample(spark, monkeypatch):
    rows = [(1, "bad words"), (1, "bad words"), *[(1, f"text {i}") for i in range(50)], (2, "fine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 0, 1), (2, 0, 0)], "doc_id bigint, low_quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, *a, **k: seen.append(rows))
    toxicity.train(docs, labels)
    assert sorted(y for _, y in seen[0]) == [[0, 0], [0, 1]]


def test_two_models_in_one_worker(spark):
    """Weights are kept in a worker by what they are, not by where they were."""
    docs = spark.createDataFrame([(1, "good"), (2, "evil")], "doc_id bigint, text string").coalesce(1)
    for word, other in (("good", "evil"), ("evil", "good")):
        model = toxicity.ChainModel(("toxic",), [{toxicity._hash(f"={word}"): 5 * toxicity.UNIT}], [[]], [-2 * toxicity.UNIT])
        got = {r.text: r.is_toxic for r in toxicity.score(docs, model).collect()}
        assert got == {word: True, other: False}


def test_no_word_is_cut():
    a, b = (set(toxicity.word_features("q" * 64 + w)) for w in ("evil", "good"))
    assert a != b and toxicity._hash("=evil") in a - b
