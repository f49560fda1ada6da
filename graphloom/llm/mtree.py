"""Exact top-k search by inner product with M-trees.

Vectors become whole numbers, floor(scale * x). Within a shard, v is read as the point (v, sqrt(M^2 - |v|^2)) with M the shard's largest norm, and a query q as
(q, 0): their squared distance is |q|^2 + M^2 - 2 q.v, a metric in which the nearest points have the highest inner products. A shard's M-tree is bulk-loaded:
nodes are pages of routing entries (point, covering radius, distance to the parent's point, child), leaves pages of points with their distance to the parent.
A query visits nodes best first by the least distance any member can have; entries whose stored parent distance already rules them out by the triangle
inequality are passed over without computing a distance. Scores themselves are exact integers: sums of doubles as long as those are exact, and else Python's integers for
the points that a bound on the doubles' error leaves.

Trees and blocks of queries are files in the shared folder, written by tasks, with an index row each. A task's rows are (block, range of trees) pairs: it holds one block and one tree at a
time and carries each query's k-th best score from tree to tree; the k best of the ranges are merged by an aggregate. Nothing but the number of rows passes through the driver.
"""

from __future__ import annotations

import heapq
import pickle
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_path, per_bucket, ship

#: Whole numbers up to this are exact in doubles.
EXACT = 1 << 53
#: Trees are built on points scaled by a power of two so that their squares don't overflow.
SMALL = 400


def _shift(x: np.ndarray) -> int:
    """The power of two to divide by so that nothing exceeds 2^SMALL; 0 for usual numbers."""
    return max(0, int(np.frexp(np.abs(x).max(initial=0.0))[1]) - SMALL)


class MTree:
    """Bulk-loaded M-tree of one shard. ids and points (whole numbers as doubles) are kept in page order, so a leaf is a slice of them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, page: int = 64, fanout: int = 16) -> None:
        self.shift, self.most = _shift(points), float(np.abs(points).max(initial=0.0))
        scaled = np.ldexp(points, -self.shift) if self.shift else points
        norms = (scaled * scaled).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        lifted = np.column_stack([scaled, np.sqrt(np.maximum(self.top - norms, 0))])
        self.page, self.fanout = page, fanout
        self.order: list[np.ndarray] = []
        #: per node: for a leaf (True, first, last, parent distances), else (False, points, radii, parent distances, children)
        self.nodes: list[tuple] = []
        self.at = 0
        self.root = self._load(lifted, np.arange(len(ids)), None) if len(ids) else None
        order = np.concatenate(self.order) if self.order else np.zeros(0, int)
        self.ids, self.points = ids[order], points[order]
        del self.order

    def _load(self, lifted: np.ndarray, rows: np.ndarray, parent: np.ndarray | None) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.page:
            first = self.at
            self.at += len(rows)
            self.order.append(rows)
            d = np.linalg.norm(lifted[rows] - parent, axis=1) if parent is not None else np.zeros(len(rows))
            self.nodes[me] = (True, first, self.at, d)
            return me
        # Pivots far from one another, starting at the point nearest to the mean.
        x = lifted[rows]
        d = np.linalg.norm(x - x.mean(axis=0), axis=1)
        pivots = [int(d.argmin())]
        near = np.linalg.norm(x - x[pivots[0]], axis=1)
        owner = np.zeros(len(rows), int)
        while len(pivots) < min(self.fanout, -(-len(rows) // self.page)):
            far = int(near.argmax())
            if near[far] == 0:
                break
            pivots.append(far)
            d = np.linalg.norm(x - x[far], axis=1)
            owner[d < near] = len(pivots) - 1
            near = np.minimum(near, d)
        groups = [rows[owner == i] for i in range(len(pivots))]
        if len(groups) == 1 or max(map(len, groups)) == len(rows):  # all alike: cut evenly
            groups = np.array_split(rows, min(self.fanout, -(-len(rows) // self.page)))
            routing = [lifted[g[0]] for g in groups]
        else:
            routing = [x[p] for p in pivots]
        kept = [(r, g) for r, g in zip(routing, groups, strict=True) if len(g)]
        radii = np.array([np.linalg.norm(lifted[g] - r, axis=1).max() for r, g in kept])
        to_parent = np.array([np.linalg.norm(r - parent) if parent is not None else 0.0 for r, _ in kept])
        children = [self._load(lifted, g, r) for r, g in kept]
        self.nodes[me] = (False, np.array([r for r, _ in kept]), radii, to_parent, children)
        return me

    def search(self, query: np.ndarray, own: int, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """found: the best so far as a heap of (score, -id), at most k; the row with id `own` is left out."""
        if self.root is None:
            return found
        q_shift = _shift(query)
        q, down = np.ldexp(query, -q_shift), self.shift + q_shift
        # All partial sums are whole numbers that doubles hold: the doubles' scores are exact.
        exact = len(query) * self.most * float(np.abs(query).max(initial=0.0)) < EXACT
        q2 = float((q * q).sum()) + self.top
        lifted = np.append(q, 0.0)
        # Each product's and sum's rounding, and the roots', stay far below these.
        loose, far = 1e-12 * q2, 1e-6 * np.sqrt(q2)

        def bound() -> float:
            """Points farther than this score less than the k-th best; ties stay in."""
            return np.sqrt(max(q2 - 2 * float(found[0][0] >> down), 0.0) + loose) + far if len(found) == k else np.inf

        queue = [(0.0, self.root, 0.0, False)]
        while queue:
            least, node, to_routing, has_parent = heapq.heappop(queue)
            limit = bound()
            if least > limit:
                break
            n = self.nodes[node]
            if n[0]:
                _, a, b, d = n
                near = np.flatnonzero(np.abs(to_routing - d) <= limit) if has_parent else np.arange(b - a)
                if len(near):
                    rows = slice(a, b) if len(near) == b - a else a + near
                    self._scan(self.points[rows], self.ids[rows], query, q, down, exact, own, k, found)
                continue
            _, points, radii, to_parent, children = n
            near = np.flatnonzero(np.abs(to_routing - to_parent) - radii <= limit) if has_parent else np.arange(len(children))
            if len(near):
                d = np.linalg.norm(points[near] - lifted, axis=1)
                low = np.maximum(d - radii[near], 0)
                for j in np.flatnonzero(low <= limit):
                    heapq.heappush(queue, (float(low[j]), children[near[j]], float(d[j]), True))
        return found

    def _scan(self, points: np.ndarray, ids: np.ndarray, query, q, down: int, exact: bool, own: int, k: int, found: list) -> None:
        if exact:
            s = points @ query
            near = np.flatnonzero((s >= (found[0][0] if len(found) == k else -np.inf)) & (ids != own))
        else:
            p = np.ldexp(points, -self.shift) if self.shift else points
            s, err = p @ q, (len(q) + 8) * 2.3e-16 * (np.abs(p) @ np.abs(q))
            low = float(found[0][0] >> down) if len(found) == k else -np.inf
            near = np.flatnonzero((s + err >= (low - 1e-15 * abs(low) - 1 if len(found) == k else low)) & (ids != own))
            whole = [int(x) for x in query]
        for j in near:
            score = int(s[j]) if exact else sum(int(x) * y for x, y in zip(points[j], whole, strict=True))
            x = (score, -int(ids[j]))
            if len(found) < k:
                heapq.heappush(found, x)
            elif x > found[0]:
                heapq.heapreplace(found, x)


LONG = (1 << 63) - 1


def beyond(score: int) -> str:
    """Text in the order of the scores that come out as the same bigint."""
    if -LONG - 1 <= score <= LONG:
        return "1"
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    return f"2{digits}" if score > 0 else "0" + "".join(str(9 - int(c)) for c in digits)


def vectors_of(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v: array<double>) of the rows that take part: id and vector not null, every component finite (after scaling, too)."""
    ok = F.col("e").isNotNull() & F.col("id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where(F.coalesce(ok, F.lit(False))).select("id", F.col("e").alias("v"))


def whole_numbers(values, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; beyond 2^53 the product is a whole number already."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _save(folder: str, what) -> str:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(pickle.dumps(what, protocol=5))
    return f"{folder}/{name}"


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return pickle.loads(f.read())


def build(vectors: DataFrame, width: int, shards: int, scale: int = 256, page: int = 512) -> DataFrame:
    """One row (shard, path) per shard, dealt by a hash of id and vector; the trees are files of the shared folder, named anew by each attempt of a task."""
    folder = new_path(vectors.sparkSession, "mtrees")

    def load(pdf):
        tree = MTree(pdf["id"].to_numpy(np.int64), whole_numbers(pdf["v"], width, scale), page)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "path": [_save(folder, tree)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInPandas(load, "shard int, path string"), "trees")


def top_k(vectors: DataFrame, queries, k: int = 5, scale: int = 256, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, page: int = 512, trees_a_task: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition `queries` (a Column over `id`) picks, the k rows with the highest inner product of whole numbers,
    ties to the smaller id; fewer if there are fewer.

    Rows with a null id or vector, or null or non-finite components, take no part; shorter vectors count as filled with zeros. Rows that share the query's id are
    its own. Repeated rows are candidates each; repeated queries are one. Components may be of any size: scores beyond a bigint are compared as the whole numbers they are and come out as the nearest bigint.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = materialize(vectors_of(vectors, scale, id_col, vector_col), "vectors")
    rows, asked, width = v.agg(F.count("*"), F.count_if(queries), F.max(F.size("v"))).first()
    width = width or 0
    trees_n, blocks_n = per_bucket(rows, shard_rows), per_bucket(asked, block)
    trees = build(v, width, trees_n, scale, page)
    folder = new_path(spark, "queries")

    def hold(pdf):
        pdf = pdf.sort_values("id", ignore_index=True)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "block_path": [_save(folder, (pdf["id"].to_numpy(np.int64), whole_numbers(pdf["v"], width, scale)))]})

    dealt = v.where(queries).dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks_n)).cast("int"))
    blocks = materialize(dealt.groupBy("block").applyInPandas(hold, "block int, block_path string"), "blocks")
    # Ranges as long as they may be, but enough of them for all cores.
    ranges = max(-(-trees_n // trees_a_task), min(trees_n, -(-2 * spark.sparkContext.defaultParallelism // blocks_n)))
    listed = trees.groupBy((F.col("shard") % ranges).alias("range")).agg(F.sort_array(F.collect_list("path")).alias("paths"))  # at most trees_a_task, or those of few shards
    pairs = blocks.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).join(listed, "range")

    def run(batches):
        at, held = None, None
        for pdf in batches:
            for block_path, paths in zip(pdf["block_path"], pdf["paths"], strict=True):
                if block_path != at:
                    at, held = block_path, _open(block_path)
                ids, q = held
                found: list[list] = [[] for _ in ids]
                for path in paths:
                    tree = _open(path)
                    for i in range(len(ids)):
                        found[i] = tree.search(q[i], int(ids[i]), k, found[i])
                out = [(int(ids[i]), -x[1], max(-LONG - 1, min(LONG, x[0])), beyond(x[0])) for i in range(len(ids)) for x in found[i]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    # Numbered, so that the few pairs aren't put together by their size in bytes, and round robin, so that they are spread evenly.
    tasks = min(blocks_n * ranges, 32 * spark.sparkContext.defaultParallelism)
    spread = materialize(pairs.select("block_path", "paths"), "pairs").repartition(tasks)
    every = spread.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
