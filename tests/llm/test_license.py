import random
import re

import pytest

from graphloom.llm import license as scans

TEXTS = [
    "Released under the MIT License.",
    "under the mit license under the MIT-license: Apache License, Version 2.0 -- CC BY-NC 4.0",
    None,
    "",
    "cc by",
    "cc by nc cc by nc by nc",
    "under the mit licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "This fine work is hereby licensed under the old GNU General Public License version 3",
    "é ß apache licenseé version 2 apache license version 2",
    "x " * 60_000 + "under the mit license " + "y" * 60_000,
]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(t.label, i) for t in scans.PHRASES for i in range(len(w)) if w[i : i + len(t.text.split())] == t.text.split()]
    return len(w), sorted(hits)


@pytest.mark.parametrize("listed", [20_000, 0])
def test_places_against_every_position(spark, monkeypatch, listed):
    monkeypatch.setattr(scans, "LISTED", listed)
    rng = random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc other".split()
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randrange(200))) for _ in range(40)]
    rows = [(i, t, "l") for i, t in enumerate(texts)] + [(1, texts[1], "l"), (1, texts[1], "l"), (None, texts[0], "l")]
    got = scans.scan(spark.createDataFrame(rows, "doc_id bigint, text string, template string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, base(t))) for i, t, _ in rows)
    assert sorted((str(r.id), str(r.n_words), str(sorted((p.label, p.start) for p in r.places))) for r in got) == want


def test_notices_and_edits(spark):
    got = {r.id: r for r in scans.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")).collect()}
    assert [s.label for s in got[7].spans] == ["gpl"] and got[7].spans[0].coverage == 1.0 and (got[7].spans[0].start, got[7].spans[0].end) == (0, 12)
    assert not got[4].spans and not got[2].spans and got[8].best > 0.3
    assert scans.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


REPEATS = ["this work is " * 8, "provided that the " * 30, "this work is licensed " * 20 + "nothing else", "public license version " * 40, "of the gnu general public license of the gnu general public license " * 5]


def test_words_repeated_make_no_notice(spark):
    """The same k-gram over and over votes on many diagonals, and is one template position all the same."""
    got = scans.scan(spark.createDataFrame(list(enumerate(REPEATS)), "doc_id bigint, text string")).collect()
    assert len(got) == len(REPEATS) and not any(r.spans for r in got) and all(r.best < 0.6 for r in got)


def longest(votes, shift):
    """Most votes in a chain, by trying every earlier vote."""
    votes = sorted(votes)
    n = []
    for i, (p, a) in enumerate(votes):
        n.append(1 + max((n[j] for j in range(i) if votes[j][0] < p and votes[j][1] < a and p - votes[j][0] - a + votes[j][1] <= shift), default=0))
    return max(n, default=0)


@pytest.mark.parametrize("seed", range(6))
def test_chains_against_all_earlier_votes(seed):
    rng = random.Random(seed)
    for _ in range(60):
        grams, shift = rng.randrange(2, 14), rng.randrange(0, 5)
        votes = list({(rng.randrange(60), rng.randrange(grams)) for _ in range(rng.randrange(50))})
        got = scans.chains(votes, grams, shift, 0.0)
        assert max((c for c, _, _ in got), default=0) * grams == pytest.approx(longest(votes, shift))
        at = sorted((a, b) for _, a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(at, at[1:], strict=False))


def test_spans_against_every_position(spark):
    """Random texts out of the templates' words, cut, shuffled and with words put in: coverage by plain Python over all pairs of positions."""
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(scans.NOTICES).text.split()
            a = rng.randrange(len(t))
            piece = t[a:] + t[:a] if rng.random() < 0.3 else t[: rng.randrange(1, len(t) + 1)] if rng.random() < 0.5 else list(t)
            for _ in range(rng.randrange(3)):
                piece.insert(rng.randrange(len(piece) + 1), rng.choice(["fine", "the", "license", "other"]))
            words += piece + ["x"] * rng.randrange(4)
        texts.append(" ".join(words))
    got = {r.id: r for r in scans.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        w, want = text.split(), set()
        for t in scans.NOTICES:
            u = t.text.split()
            votes = [(p, a) for p in range(len(w) - 2) for a in range(len(u) - 2) if w[p : p + 3] == u[a : a + 3]]
            n = longest(votes, 4)
            if n >= 0.6 * (len(u) - 2):
                want.add((t.label, round(n / (len(u) - 2), 9)))
        best = {}
        for s in got[i].spans:
            best[s.label] = max(best.get(s.label, 0), round(s.coverage, 9))
        most = {}
        for label, c in want:
            most[label] = max(most.get(label, 0), c)
        assert best == most
        for s in got[i].spans:
            assert 0 <= s.start < s.end <= len(w)


def test_query_against_plain_python(spark):
    from graphloom.llm.queries import op10_license

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op10_license(spark, "/root/testdata/sf0.001").collect():
        n, places = base(docs[r.doc_id])
        starts = [i for _, i in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
