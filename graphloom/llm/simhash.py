"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees.

A BK-tree over 64-bit fingerprints prunes little by itself, so the fingerprints are first dealt into shards that every
pair within the radius must share: the bits are cut into `blocks` blocks, and two fingerprints that differ in at most
`radius` bits agree on at least blocks - radius whole blocks. A shard is a choice of that many blocks and their bits.
Each shard's tree (children keyed by integer Hamming distance to the parent) is built where the shard is, and
only edges within the radius of the query's distance are followed. A shard with more than `shard_size` fingerprints is
cut into parts by hash; each pair of parts is a task of its own, so no link is lost and no task grows without bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, materialize, ship, takes_over

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one whole text as an unsigned 64-bit number: A-Z lower-cased, words between ASCII white space,
    every shingle of `shingle` words counted as often as it stands there; fewer words: the whole sequence; none: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], at + 1))
    ends = np.append(at, len(line))
    n = max(1, len(words) - shingle + 1)
    xx = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), n
    step = 1 << 16
    for i in range(0, n, step):
        s, e = starts[i : min(n, i + step)].tolist(), ends[min(shingle, len(words)) - 1 :][i : min(n, i + step)].tolist()
        h = np.array([xx(line[a:b], SEED) for a, b in zip(s, e, strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the columns `keep`: fp is the fingerprint as a signed bigint. One row per row of docs; a null text counts as empty."""

    def run(batches):
        takes_over("simhash")
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fp, **{c: pdf[c] for c in keep}})

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).mapInPandas(run, ", ".join([f"id {kind}, fp bigint", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]]))


class BKTree:
    """Burkhard-Keller tree of integers under Hamming distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.value)
        self.value.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.value[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Positions (in order of insertion) of all members at `radius` or less."""
        found, stack = [], [0] if self.value else []
        while stack:
            at = stack.pop()
            d = (self.value[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            stack += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def _link(values: list[int], part: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one shard (or pair of its parts): (position, smaller position in its component)."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, members = BKTree(), []
    one = part.min() == part.max()
    for i, v in enumerate(values):
        if one:  # a tree that grows: each member meets those before it
            for j in tree.within(v, radius):
                a, b = sorted((root(i), root(members[j])))
                parent[b] = a
        if one or part[i] == part.min():
            tree.add(v)
            members.append(i)
    if not one:
        for i in np.flatnonzero(part != part.min()):
            for j in tree.within(values[i], radius):
                a, b = sorted((root(int(i)), root(members[j])))
                parent[b] = a
    return [(i, r) for i in range(len(values)) if (r := root(i)) != i]


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius of the blocks, the mask of their bits."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    one = [sum(1 << b for b in range(cut[i], cut[i + 1])) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def blocks_for(count: int, radius: int, per_shard: int = 64) -> int:
    """Fewest blocks with which evenly spread fingerprints fill a shard with at most `per_shard`."""
    blocks = radius + 1
    while blocks < 16 and count > per_shard * 2.0 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, shard_size: int = 1024) -> DataFrame:
    """(src, dst): links of distinct fingerprints (column fp) that join exactly those groups that links within the
    radius join. distinct should be a written table: it is read more than once."""
    ship(distinct.sparkSession)
    blocks = blocks or blocks_for(distinct.count(), radius)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    hot = keys.groupBy("choice", "bits").count().where(F.col("count") > shard_size)
    hot = materialize(hot.select("choice", "bits", F.ceil(F.col("count") * 2 / shard_size).cast("int").alias("parts")), "hot")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keys.join(hot, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("choice", "bits", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")
    group = ["choice", "bits", "a", "b"]

    def run(batches):
        takes_over("simhash")
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            k = pdf[group].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            yield shard(pdf.iloc[:last], np.concatenate(([0], cuts)))
            rest = pdf.iloc[last:]
        if rest is not None and len(rest):
            yield shard(rest, np.array([0, len(rest)]))

    def shard(pdf, cuts):
        fps, parts, out = pdf["fp"].to_numpy(), pdf["part"].to_numpy(), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                mine = fps[a:b]
                out += [(mine[i], mine[r]) for i, r in _link(mine.view(np.uint64).tolist(), parts[a:b], radius)]
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return dealt.repartition(*group).sortWithinPartitions(*group, "part", "fp").mapInPandas(run, "src bigint, dst bigint").distinct()


def grouped(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes (a written table whose fp are distinct) with component: one fingerprint of those that links within the radius join."""
    linked = components(links(nodes.select("fp"), radius))
    return materialize(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fp (signed bigint), component_id: the smallest id reachable over links of at most
    `radius` differing bits.

    Null or empty text: fingerprint 0, linked like any other. Equal rows and equal ids: each row is returned. A null id
    takes part, and is nobody's component_id unless no member has another (then null). Columns beside the two are
    not read. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labelled = grouped(nodes, radius)
    least = materialize(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "components")
    final = materialize(labelled.join(least, "component").select("fp", "component_id"), "membership")
    return fps.join(final, "fp").select("id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
