"""Embedding near-duplicates by a robust-pruned flat graph built on overlapping cluster shards.

Equal vectors of a label are one node. Centroids per label are fitted on a bounded sample; every node goes to the shards of its two nearest. A shard with more than `shard_size` nodes
is clustered further on a sample of its own, its nodes going to their nearest child and to the second if it is about as near, until shards have that size, or are so dense that a good part of their
pairs are links, or don't come apart. Each shard builds a graph: a node's candidates are its nearest in the shard, a few drawn by hash and the medoid, pruned so that an edge stays only if no kept neighbour
is `alpha` times nearer to its end; reverse edges are added, and nodes that can't be reached from the medoid are tied to their nearest reached node. A node's lists from all its
shards are united. Every node is then searched for in its shards: beam search from the medoid, then the range is expanded over neighbours while they stay
near the threshold. Found pairs are verified by cosine in double precision. A pair that meets in two shards is counted in the smaller.

A dense shard with more than `shard_size` nodes is cut into parts, and each pair of parts is a task, so no pair is lost and no task grows with the data; the tasks grow with the links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, materialize, ship

DEGREE, CANDIDATES, BEAM, ALPHA, SLACK = 24, 40, 32, 1.2, 0.03


def _unit(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def robust_prune(sims: np.ndarray, between: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Positions of the candidates kept, nearest first. sims: cosine to the node; between: among the candidates (unit vectors, distance^2 = 2 - 2 cos)."""
    d, left, kept = 2 - 2 * sims, np.ones(len(sims), bool), []
    for i in np.argsort(-sims, kind="stable"):
        if left[i]:
            kept.append(int(i))
            if len(kept) == degree:
                break
            left &= alpha**2 * (2 - 2 * between[i]) > d
    return kept


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build_graph(x: np.ndarray, seed: int = 0, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbour positions of each unit vector."""
    n, start, rng = len(x), medoid(x), np.random.default_rng(seed)
    lists: list[set[int]] = [set() for _ in range(n)]
    x32 = x.astype(np.float32)
    for a in range(0, n, 512):
        s = x32[a : a + 512] @ x32.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        few = min(CANDIDATES, n - 1)
        near = np.argpartition(-s, few - 1, axis=1)[:, :few] if few else np.zeros((len(s), 0), int)
        for i in range(len(s)):
            c = np.unique(np.concatenate([near[i], rng.integers(0, n, 8), [start]]))
            c = c[c != a + i]
            lists[a + i].update(c[robust_prune(s[i, c], x32[c] @ x32[c].T, degree)].tolist())
    for i in range(n):
        for j in list(lists[i]):
            lists[j].add(i)
    for i in range(n):
        if len(lists[i]) > 2 * degree:
            c = np.array(sorted(lists[i]))
            lists[i] = set(c[robust_prune(x32[c] @ x32[i], x32[c] @ x32[c].T, degree)].tolist())
    reached = np.zeros(n, bool)
    _reach(lists, reached, start)
    for i in range(n):
        if not reached[i]:
            old = np.flatnonzero(reached)
            j = int(old[(x32[old] @ x32[i]).argmax()])
            lists[j].add(i)
            lists[i].add(j)
            _reach(lists, reached, i)
    return [np.array(sorted(s), int) for s in lists]


def _reach(lists, reached: np.ndarray, start: int) -> None:
    stack = [start]
    reached[start] = True
    while stack:
        for j in lists[stack.pop()]:
            if not reached[j]:
                reached[j] = True
                stack.append(j)


def range_search(x: np.ndarray, graph: list[np.ndarray], query: np.ndarray, start: int, threshold: float, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Positions with cosine >= threshold that the search meets: a beam search, then expansion of all that is within threshold - slack."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    ids, sims = np.array([start]), np.array([x[start] @ query])
    done = np.array([False])
    near_ids, near_sims = [ids], [sims]
    while not done.all():
        i = np.flatnonzero(~done)[:4]
        done[i] = True
        new = np.unique(np.concatenate([graph[j] for j in ids[i]]))
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            s = x[new] @ query
            near_ids.append(new)
            near_sims.append(s)
            ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, s]), np.concatenate([done, np.zeros(len(new), bool)])
            order = np.argsort(-sims, kind="stable")[:beam]
            ids, sims, done = ids[order], sims[order], done[order]
    all_ids, all_sims = np.concatenate(near_ids), np.concatenate(near_sims)
    inside = all_sims >= threshold - slack
    found, front = [all_ids[all_sims >= threshold]], all_ids[inside]
    while len(front):
        new = np.unique(np.concatenate([graph[j] for j in front]))
        new = new[~seen[new]]
        seen[new] = True
        s = x[new] @ query
        found.append(new[s >= threshold])
        front = new[s >= threshold - slack]
    return np.concatenate(found)


def fit_centroids(sample: dict[object, np.ndarray], counts: dict[object, int], per_shard: int, most: int, rounds: int = 6) -> dict[object, np.ndarray]:
    """Spherical k-means per label on its sampled unit vectors; a label without a sample has one shard."""
    out = {}
    for label, x in sample.items():
        k = max(1, min(len(x) // 8, most, -(-counts.get(label, 0) // per_shard)))
        c = x[:: max(1, len(x) // k)][:k].copy()
        for _ in range(rounds if k > 1 else 0):
            owner = (x @ c.T).argmax(axis=1)
            for i in range(k):
                if (owner == i).any():
                    m = x[owner == i].mean(axis=0)
                    c[i] = m / (np.linalg.norm(m) or 1.0)
        out[label] = c
    return out


#: A shard is dense if more than this share of its sampled pairs are links.
DENSE = 0.1
#: Vectors that a large shard is clustered on, and its children at most.
SHARD_SAMPLE, CHILDREN = 1024, 32


def refine(placed: DataFrame, sizes: DataFrame, threshold: float, per_shard: int, width: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(rows, dense): the rows of the large shards `sizes` (label, shard, n) under their children's names, and the names of those that stay as they are for being dense.

    Children's centroids are fitted in a task per shard on SHARD_SAMPLE of its vectors or so; vectors are assigned in tasks of a few thousand, so nothing grows with a shard."""
    kind = placed.schema["label"].dataType.simpleString()
    near = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    large = placed.join(sizes, ["label", "shard"])
    # Points that far apart or less share a child if each goes to all children that are no farther than its nearest one and this.
    some = large.where(F.pmod(F.xxhash64("node", F.lit(100 + level)), F.ceil(F.col("n") / SHARD_SAMPLE)) == 0)

    def fit(pdf):
        x = _unit(pdf.sort_values("node")["e"], width)
        s = x @ x.T
        dense = len(x) < 32 or (s >= threshold).sum() - len(x) > DENSE * len(x) * (len(x) - 1)
        k = int(min(max(8, -(-int(pdf["n"].iloc[0]) // per_shard)), CHILDREN, len(x) // 4))
        c = np.zeros((0, width)) if dense else fit_centroids({0: x}, {0: k * per_shard}, per_shard, k)[0]
        if len(c) > 1 and np.bincount(children(x, c)[1]).max() > len(x) / 2:  # it doesn't come apart
            c = c[:0]
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "c": [c.tolist()]})

    def children(x, c):
        """(position, child): each one's nearest, and the second if it is about as near."""
        d = np.sqrt(np.maximum(0, 1 + (c * c).sum(axis=1) - 2 * x @ c.T))
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        ranked = np.take_along_axis(d, order, axis=1)
        i, j = np.nonzero(ranked <= ranked[:, :1] + near)
        return i, order[i, j]

    cents = materialize(some.groupBy("label", "shard").applyInPandas(fit, f"label {kind}, shard string, c array<array<double>>"), "centroids")
    split = sizes.join(cents.where(F.size("c") > 1), ["label", "shard"]).withColumn("chunks", F.ceil(F.col("n") / 4096).cast("int"))
    to_chunks = split.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("label", "shard", "chunk", "c")
    rows = placed.join(split.select("label", "shard", "chunks"), ["label", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(13)), F.col("chunks")).cast("int"))

    def assign(pdf, cent):
        if not len(pdf) or not len(cent):
            return pd.DataFrame({"node": [], "label": [], "mult": [], "e": [], "shard": []})
        i, child = children(_unit(pdf["e"], width), np.array([list(v) for v in cent["c"].iloc[0]]))
        out = pdf.iloc[i][["node", "label", "mult", "e", "shard"]].reset_index(drop=True)
        return out.assign(shard=out["shard"] + "." + pd.Series(child).astype(str))

    out = rows.groupBy("label", "shard", "chunk").cogroup(to_chunks.groupBy("label", "shard", "chunk")).applyInPandas(assign, f"node bigint, label {kind}, mult bigint, e array<double>, shard string")
    dense = sizes.join(split.select("label", "shard"), ["label", "shard"], "left_anti").select("label", "shard")
    return out, dense


def shards_of(placed: DataFrame, threshold: float, per_shard: int, shard_size: int, width: int, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """(placed, sizes): (node, label, mult, e, shard) with large shards taken apart, and (label, shard, n). What is still large after `levels` levels is treated like a dense shard: a node has at most 2^levels copies for each of its first shards."""
    spark = placed.sparkSession
    settled = spark.createDataFrame([], f"label {placed.schema['label'].dataType.simpleString()}, shard string")
    for level in range(levels):
        sizes = placed.groupBy("label", "shard").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > shard_size).join(settled, ["label", "shard"], "left_anti"), "large")
        if large.isEmpty():
            break
        rows, dense = refine(placed, large, threshold, per_shard, width, level)
        settled = materialize(settled.unionByName(dense), "settled")
        rest = placed.join(large.join(dense, ["label", "shard"], "left_anti").select("label", "shard"), ["label", "shard"], "left_anti").select(*placed.columns)
        placed = materialize(rest.unionByName(rows.select(*placed.columns)), "placed")
    return placed, materialize(placed.groupBy("label", "shard").agg(F.count("*").alias("n")), "sizes")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", per_shard: int = 1000, shard_size: int = 3000, sample: int = 20_000, centroids: int = 512, audit: int = 512, least_recall: float = 0.9, beam: int = BEAM) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows found with cosine >= threshold under the same label), component_id (smallest id reachable), audit_recall, audit_recall_linked.

    Null labels, and vectors that are null, zero, or hold null or non-finite components link with nothing: n_links 0, component_id the row's own id.
    Shorter vectors count as filled with zeros. Equal vectors are linked with each other; repeated rows are rows of their own. A null id takes part and is nobody's component_id
    if another member has one. Other columns are not read. An empty table gives an empty result.

    Recall is audited on every run against brute force over all rows: audit_recall on `audit` nodes drawn by hash whatever was found for them, audit_recall_linked on as many of those with links found; both count
    pairs of different vectors. If either is below `least_recall`, the search is run again with a beam eight times as wide, and if that doesn't do, all nodes of a label are compared exactly, a pair
    of parts a task: less recall is never returned. `sample` and `centroids` (per label) bound what the driver fits and broadcasts.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = materialize(rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("e").isNotNull() & finite, F.lit(False))), "vectors")
    good = rows.where("ok")
    grouped = good.groupBy("label", "e").agg(F.min("id").alias("first"), F.count("*").alias("mult"))
    # A node's number is a hash of label and vector: the same wherever and whenever it is computed.
    nodes = materialize(grouped.withColumn("node", F.xxhash64("label", "e")), "nodes")
    width, total, different = nodes.agg(F.max(F.size("e")), F.count("*"), F.countDistinct("node")).first()
    if different != total:  # two vectors have one hash: number them as they were written, which is settled once they are read again
        nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    width = width or 0
    picked = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(sample).select("label", "e").collect()
    by_label: dict = {}
    for r in picked:
        by_label.setdefault(r["label"], []).append(r["e"])
    units = {k: _unit(v, width) for k, v in by_label.items()}
    share = {k: len(v) / max(1, len(picked)) for k, v in units.items()}
    cents = spark.sparkContext.broadcast(fit_centroids(units, {k: int(s * total) for k, s in share.items()}, per_shard, centroids))

    def assign(batches):
        for pdf in batches:
            x = _unit(pdf["e"], width) if len(pdf) else np.zeros((0, width))
            out: list = [None] * len(pdf)
            for label, at in pdf.groupby("label").indices.items():
                c = cents.value.get(label)
                best = np.zeros((len(at), 1), int) if c is None or len(c) == 1 else np.argpartition(-(x[at] @ c.T), 1, axis=1)[:, :2]
                for i, b in zip(at, best.tolist(), strict=True):
                    out[i] = [str(j) for j in b]
            yield pdf.assign(shards=out)

    label_kind = nodes.schema["label"].dataType.simpleString()
    cols = ["node", "label", "mult", "e"]
    first = nodes.select(*cols).mapInPandas(assign, f"node bigint, label {label_kind}, mult bigint, e array<double>, shards array<string>")
    placed, sizes = shards_of(materialize(first.select(*cols, F.explode("shards").alias("shard")), "placed"), threshold, per_shard, shard_size, width)
    found = _searched(placed, sizes, threshold, width, shard_size, beam)
    recall = audit_recall(nodes, found, audit, threshold, width)
    if min(recall) < least_recall:
        found = _searched(placed, sizes, threshold, width, shard_size, 8 * beam)
        recall = audit_recall(nodes, found, audit, threshold, width)
    if min(recall) < least_recall:
        whole = nodes.select(*cols, F.lit("").alias("shard"))
        found = _searched(whole, whole.groupBy("label", "shard").agg(F.count("*").alias("n")), threshold, width, shard_size, None)
        recall = audit_recall(nodes, found, audit, threshold, width)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = materialize(nodes.select("node", "label", "e", "first", "mult").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(least, "component").join(counts, "node").select(F.xxhash64("label", "e").alias("k"), F.col("label").alias("k_label"), F.col("e").alias("k_e"), "mult", "links", "component_id")
    known = materialize(known, "known")
    hit = good.withColumn("h", F.xxhash64("label", "e")).join(known, (F.col("h") == F.col("k")) & (F.col("label") == F.col("k_label")) & (F.col("e") == F.col("k_e")))
    linked = hit.select("id", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumns({"audit_recall": F.lit(float(recall[0])), "audit_recall_linked": F.lit(float(recall[1]))})


def _searched(placed: DataFrame, sizes: DataFrame, threshold: float, width: int, shard_size: int, beam: int | None) -> DataFrame:
    """(node, links, pairs, root) per node and group: rows linked, different vectors linked, and the smallest node that the group's links join it to. beam None: every pair of a group is compared."""
    sizes = sizes.withColumn("parts", F.when(F.col("n") > shard_size, F.ceil(F.col("n") * 2 / shard_size)).otherwise(1).cast("int")).select("label", "shard", "parts")
    mine = placed.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # a node has a few shards
    dealt = placed.join(mine, "node").join(sizes, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")).cast("int"))
    # A part meets itself and every other; a shard in one part is one group.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "shard", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node", "mult", "e", "shards")
    group = ["label", "shard", "a", "b"]
    out = "node bigint, links bigint, pairs bigint, root bigint"

    def result(pdf, pairs) -> pd.DataFrame:
        """pairs: (i, j) positions of links, each once."""
        ids, mult, part = pdf["node"].to_numpy(), pdf["mult"].to_numpy(), pdf["part"].to_numpy()
        shard, a, b = pdf["shard"].iloc[0], pdf["a"].iloc[0], pdf["b"].iloc[0]
        n = len(ids)
        i, j = (np.array([p[k] for p in pairs], int) for k in (0, 1)) if isinstance(pairs, set) else pairs
        least = np.arange(n)  # positions are in the order of the nodes' numbers
        while len(i):
            low = np.minimum(least[i], least[j])
            new = least.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == least).all():
                break
            least = new
        several = pdf["shards"].map(len).to_numpy() > 1
        counted = np.ones(len(i), bool) if a == b else part[i] != part[j]
        sets = [set(v) for v in pdf["shards"]] if several.any() else []
        for k in np.flatnonzero(counted & several[i] & several[j]) if len(i) else ():
            counted[k] = min(sets[i[k]] & sets[j[k]]) == shard
        i, j = i[counted], j[counted]
        links = np.bincount(i, weights=mult[j], minlength=n) + np.bincount(j, weights=mult[i], minlength=n)
        return pd.DataFrame({"node": ids, "links": links.astype(np.int64), "pairs": np.bincount(i, minlength=n) + np.bincount(j, minlength=n), "root": ids[least]})

    if beam is None:

        def compare(pdf):
            pdf = pdf.sort_values("node", ignore_index=True)
            x = _unit(pdf["e"], width)
            return result(pdf, np.nonzero(np.triu(x @ x.T >= threshold, 1)))

        return materialize(dealt.groupBy(*group).applyInPandas(compare, out), "links")

    def build(pdf):
        pdf = pdf.sort_values("node", ignore_index=True)
        g = build_graph(_unit(pdf["e"], width))
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "next": [ids[a] for a in g]})

    graph = dealt.groupBy(*group).applyInPandas(build, "node bigint, next array<bigint>")
    # Union of a node's lists; each has at most a few dozen entries.
    graph = materialize(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "graph")

    def run(pdf):
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, x = pdf["node"].to_numpy(), _unit(pdf["e"], width)
        place = pd.Series(np.arange(len(ids)), index=ids)
        near = [a[a >= 0] for a in (place.reindex(v).fillna(-1).to_numpy(int) for v in pdf["next"])]
        # What other shards pruned may have been this shard's way to a node.
        lists = [set(v.tolist()) for v in near]
        reached, start = np.zeros(len(ids), bool), medoid(x)
        _reach(lists, reached, start)
        for i in np.flatnonzero(~reached):
            if not reached[i]:
                old = np.flatnonzero(reached)
                j = int(old[(x[old] @ x[i]).argmax()])
                lists[j].add(int(i))
                _reach(lists, reached, int(i))
        near = [np.array(sorted(s), int) for s in lists]
        pairs = {(min(i, j), max(i, j)) for i in range(len(ids)) for j in range_search(x, near, x[i], start, threshold, beam).tolist() if j != i}
        return result(pdf, pairs)

    return materialize(dealt.join(graph, "node").groupBy(*group).applyInPandas(run, out), "links")


def audit_recall(nodes: DataFrame, found: DataFrame, queries: int, threshold: float, width: int) -> tuple[float, float]:
    """Share of the true links (pairs of different vectors, by brute force over all nodes) that were found: of `queries` nodes drawn by hash from all, and of as many drawn from those with links found. 1 without any."""
    pairs = found.groupBy("node").agg(F.sum("pairs").alias("pairs"))
    order = F.xxhash64("node", F.lit(17))
    drawn = [pairs.where(c).orderBy(order, "node").limit(queries).select("node", "pairs", F.lit(i).alias("draw")) for i, c in enumerate((F.lit(True), F.col("pairs") > 0))]
    asked = nodes.join(F.broadcast(drawn[0].unionByName(drawn[1])), "node").select("node", "label", "e", "pairs", "draw").collect()
    if not asked:
        return 1.0, 1.0
    held = nodes.sparkSession.sparkContext.broadcast(([r["node"] for r in asked], [r["label"] for r in asked], _unit([r["e"] for r in asked], width)))

    def run(batches):
        ids, labels, q = held.value
        ids, labels = np.array(ids), np.array(labels)
        total = np.zeros(len(ids), np.int64)
        for pdf in batches:
            if len(pdf):
                x, l, n = _unit(pdf["e"], width), pdf["label"].to_numpy(), pdf["node"].to_numpy()
                for a in range(0, len(x), 2048):
                    hit = (q @ x[a : a + 2048].T >= threshold) & (labels[:, None] == l[None, a : a + 2048]) & (ids[:, None] != n[None, a : a + 2048])
                    total += hit.sum(axis=1)
        yield pd.DataFrame({"at": np.arange(len(ids)), "true": total})

    true = nodes.select("node", "label", "e").mapInPandas(run, "at bigint, true bigint").groupBy("at").agg(F.sum("true").alias("true")).collect()
    want = {r["at"]: r["true"] for r in true}
    out = []
    for draw in (0, 1):
        mine = [(r["pairs"], want.get(i, 0)) for i, r in enumerate(asked) if r["draw"] == draw]
        every = sum(t for _, t in mine)
        out.append(1.0 if not every else sum(min(n, t) for n, t in mine) / every)
    return out[0], out[1]
