"""Best-fit packing by length histogram: the plan is made over counts per length, then pieces take planned slots by rank within length.

Tokenising runs once, its result is written to the shared folder. A piece's rank within its length is its number
among the task's pieces of that length plus those of the tasks before; so no length, however common, meets in one task.
The plan sees at most `capacity` counts, whatever the corpus.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialize, ship, takes_over

_STATE: dict = {}
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of letters that ends at an ASCII character or the word's end, or else all that is left of the word.
_PART = re.compile(rf"[{_L}]+(?![^\x00-\x40\x5B-\x60\x7B-\x7F])|\S+", re.ASCII)
#: Entries kept per worker: twice so many at most, beside those of one text, about 200 bytes each.
_ENTRIES = 400_000
#: Texts that are encoded at once.
_TEXTS = 256


def byte_table() -> dict[int, int]:
    """Byte -> character as byte-level vocabularies write it: printable Latin-1 stays, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_BYTES = byte_table()
_PROBE = ("a", "in", "word", "über", "niño", "çà", "straße", "thatthing", "ÿ")


class WordTokenizer:
    """Ids of a tokenizer that drops white space and never joins across it nor across the end of a run of letters before an
    ASCII character: each part of a word is then encoded once and kept. `exact` names what this relies on; other tokenizers encode whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Ids of words and of their parts (a part that stands alone is a word of the same ids): those in use, and those in use before them.
        # What is asked for again moves back, so words of many texts stay and those of one text go.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.by_word = bool(self.ends.any())
        model = self.tok.model
        direct = lambda w: [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_BYTES))]
        # The model alone does for a run of lower-case letters, if normaliser and pre-tokenizer turn out to add nothing to it.
        self.direct = direct if [direct(w) for w in _PROBE] == self._encode(list(_PROBE)) else None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if _PLAIN.fullmatch(p)]
        if self.direct:
            for p in plain:
                self.known[p] = struct.pack(f"<{len(ids := self.direct(p))}I", *ids)
            plain_left = []
        else:
            plain_left = plain
        for i in range(0, len(plain_left), 64):
            few = plain_left[i : i + 64]
            ids = np.array(self._encode([" ".join(few)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(few):  # each run of letters is one token word
                for p, a, b in zip(few, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    self.known[p] = ids[a:b].tobytes()
            else:
                for p, e in zip(few, self._encode(few), strict=True):
                    self.known[p] = np.array(e, "<u4").tobytes()
        rest = [p for p in parts if not _PLAIN.fullmatch(p)]
        for p, e in zip(rest, self._encode(rest), strict=True):
            self.known[p] = np.array(e, "<u4").tobytes()

    def _again(self, names: set[str]) -> set[str]:
        """Of names, those that were in use before; they are in use again."""
        found = {n: self.before[n] for n in names if n in self.before}
        self.known |= found
        return found.keys()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            return [np.array(e, "<u4").tobytes() for e in self._encode(texts)]
        out = []
        for t in texts:
            # What split() takes for white space beyond the tokenizer's own.
            b = re.split(r"[\x20\x09-\x0D]+", t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split()
            new = {w for w in b if w not in self.known}
            if new:
                if len(self.known) > _ENTRIES:
                    self.known, self.before = {}, self.known
                    new = set(b)
                new -= self._again(new)
                cut = {w: [low if _PLAIN.fullmatch(p) and (low := p.lower()) != p else p for p in _PART.findall(w)] for w in new}
                unknown = {p for ps in cut.values() for p in ps if p not in self.known}
                unknown -= self._again(unknown)
                if unknown:
                    self._learn(sorted(unknown))
                for w, ps in cut.items():
                    self.known[w] = b"".join([self.known[p] for p in ps])
            out.append(b"".join([self.known[w] for w in b]))
        return out


_PLAIN = re.compile(rf"[{_L}]+")


def tokenizer(path: str) -> WordTokenizer:
    if _STATE.get("path") != path:
        _STATE.update(path=path, tok=WordTokenizer(path))
    return _STATE["tok"]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth[, ids]): each document's ids and end_id, cut after every `capacity` ids.
    nth counts the task's earlier pieces of that length. Null text: empty, so end_id alone."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids

    def run(batches):
        takes_over("packing", _STATE.clear)
        tok, task, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = int(end_id).to_bytes(4, "little")
        for pdf in batches:
            rows = []
            encoded = (ids for a in range(0, len(pdf), _TEXTS) for ids in tok.encode([t or "" for t in pdf["text"].iloc[a : a + _TEXTS]]))
            for i, ids in zip(pdf["id"].tolist() if not pdf["id"].isna().any() else [None if pd.isna(x) else x for x in pdf["id"]], encoded, strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    n = len(part) // 4
                    rows.append((i, k, a // 4, n, zlib.crc32(part), task, seen[n]) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=names)
            if kind in ("bigint", "int"):
                out["id"] = out["id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids array<bigint>" * with_ids)


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, n, first_sequence, offset). The pieces of that length with ranks
    first_rank .. first_rank + n - 1 stand at `offset` of the sequences first_sequence .. first_sequence + n - 1. Offsets leave no gap."""
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences (first, n)
    rooms: list[int] = []
    out, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
                free[room] = []
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, have = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
                m = min(n, have)
                put(room, first + m, have - m)
                out.append((length, rank, m, first, capacity - room))
                put(room - length, first, m)
                n, rank = n - m, rank + m
                continue
            # As best fit would: a new sequence takes this length until it is full, then the next is opened.
            each = capacity // length
            m, last = divmod(n, each)
            for k in range(each if m else 0):
                out.append((length, rank, m, sequences, k * length))
                rank += m
            put(capacity - each * length, sequences, m)
            sequences += m
            for k in range(last):
                out.append((length, rank, 1, sequences, k * length))
                rank += 1
            if last:
                put(capacity - last * length, sequences, 1)
                sequences += 1
            n = 0
    return out


#: Tables of up to so many rows are broadcast (48 bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Ranks of a length are looked up by ranges of so many, each of which knows the rows of the plan that reach into it.
RANGE = 1024
_PLAN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("p_length", "first_rank", "n", "first_sequence", "p_offset")])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Every row of docs is packed: repeated rows and equal or null ids are documents of their own. Null and empty texts are one piece of one id.
    Very long texts become full pieces and a rest. Ties in length are placed by the order of the scan. Other columns are not read. An empty table gives an empty result.

    The driver holds a count per length and the plan. Counts per length and task are joined by shuffle, never broadcast: (length, task) deals the pieces of a common length to all tasks.
    """
    spark = docs.sparkSession
    got = materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    per_task = materialize(got.groupBy("length", "task").agg(F.count("*").alias("here")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("here").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("nth")
    ranked = got.join(before.hint("merge"), ["length", "task"]).withColumn("rank", rank).withColumn("range", F.floor(rank / RANGE))
    spans = F.sequence(F.floor(F.col("first_rank") / RANGE), F.floor((F.col("first_rank") + F.col("n") - 1) / RANGE))
    table = spark.createDataFrame(rows, _PLAN).withColumn("p_range", F.explode(spans))
    small = 2 * len(rows) + sum(counts.values()) // RANGE <= BROADCAST_ROWS
    table = F.broadcast(table) if small else table.hint("merge")
    on = (F.col("length") == F.col("p_length")) & (F.col("range") == F.col("p_range"))
    placed = ranked.join(table, on & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    cols = ["id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("p_offset").alias("offset")]
    return placed.select(*cols, *(["ids"] if with_ids else []))
