import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import packing
from graphloom.llm.queries import tokenizer_path


def best_fit(lengths, capacity):
    """One item after the other, longest first, into the fullest sequence that has room."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(0.05)) + 1) for _ in range(rng.choice([0, 1, 5, 300, 900]))]
    rows = packing.plan(dict(Counter(lengths)), 64)
    spots, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in rows:
        for k in range(n):
            spots[first + k].append((offset, length))
            ranks[length].append(rank + k)
    for s in spots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    assert len(spots) == best_fit(lengths, 64)


ODD = ["", "  ", "it's Don'T we'LL 'S", "İstanbul ΣΑΣ straße x̸ é", "<|endoftext|>a b <|ENDOFTEXT|>", "a\x1cb\x85d e　g", "日本語 12345 a1b2 🤦🏼‍♂️", "t\tn\nr\r\x0b\x0c end", "À'S 're're 'vex x.y,z"]


def test_tokenizer_by_word_equals_whole_text():
    w = packing.WordTokenizer(tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in w.tok.encode_batch(ODD, add_special_tokens=False)]
    assert w.encode(ODD) == want == w.encode(ODD)


@pytest.mark.parametrize("rows_broadcast,rank_range", [(200_000, 1024), (0, 2)])
def test_pack(spark, monkeypatch, rows_broadcast, rank_range):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", rows_broadcast)
    monkeypatch.setattr(packing, "RANGE", rank_range)
    texts = [*ODD, None, "the same", "the same", "long " * 9000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, "again", 1), (3, "again", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, length int"), tokenizer_path()).collect()
    tok = packing.WordTokenizer(tokenizer_path()).tok
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)) for p in [ids[a : a + 4096]]]
    assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096
    assert len(by) == best_fit([r.length for r in got], 4096)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0


def test_query_against_plain_python(spark):
    from graphloom.llm.queries import op9_pack

    tok = packing.WordTokenizer(tokenizer_path()).tok
    want = Counter()
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[d.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = op9_pack(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(s)[:i]) for s in spots.values() for i, (o, _) in enumerate(sorted(s)))
    assert len(spots) == best_fit([r.length for r in got], 4096)


def test_tokenizer_keeps_few_words(monkeypatch):
    """Words of one text go, words of many texts stay, ids are the same; a task of another operator forgets them all."""
    from graphloom.llm import common

    rng = random.Random(3)
    monkeypatch.setattr(packing, "_ENTRIES", 500)
    odd = lambda: "".join(rng.choices("abcdefghijklmnop", k=9)) + rng.choice(["", ",", "-x", "ü"])
    texts = [" ".join(["often", "seen,", *[odd() for _ in range(60)]]) for _ in range(100)]
    monkeypatch.setattr(packing, "_STATE", {})
    tok = packing.tokenizer(tokenizer_path())
    learned = []
    monkeypatch.setattr(tok, "_learn", lambda parts, f=tok._learn: (learned.extend(parts), f(parts)))
    got = [tok.encode([t])[0] for t in texts]
    assert got == [np.array(e, "<u4").tobytes() for e in tok._encode(texts)]
    assert len(tok.known) <= 800 and len(tok.before) <= 800
    assert learned.count("often") == 1
    common.takes_over("packing", packing._STATE.clear)
    assert packing._STATE
    common.takes_over("simhash")
    assert not packing._STATE
