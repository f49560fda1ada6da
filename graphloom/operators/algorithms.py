"""Graph algorithms over edges (src, dst, ...) as DataFrames: rank, distance, paths, components, degrees, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import dealt, materialize, release, spread
from graphloom.operators.pregel import Memory, VertexProgram, run_program


class PageRank(VertexProgram):
    """rank = (1 - damping) / n + damping * sum(rank / out-degree); vertices without out-edges pass nothing on. The first of `iterations` supersteps counts
    out-degrees and the next gives every vertex 1 / n, so iterations - 1 of them update ranks."""

    def __init__(self, damping: float = 0.85, iterations: int = 10) -> None:
        self.damping, self.updates = damping, iterations - 1
        self.n = 0

    def setup(self, vertices: DataFrame, edges: DataFrame) -> DataFrame:
        self.n = vertices.count()
        degree = edges.groupBy("src").agg(F.sum("weight").alias("degree"))
        return vertices.select("id").join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / max(1, self.n)).alias("rank"))

    def message(self, memory: Memory) -> Column:
        return F.col("rank") * F.col("weight") / F.col("degree")

    def update(self, memory: Memory) -> dict[str, Column]:
        return {"rank": self.damping * F.coalesce("inbox", F.lit(0.0)) + (1 - self.damping) / max(1, self.n)}

    def terminate(self, memory: Memory) -> bool:
        return memory.iteration + 1 >= self.updates


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(id, rank). Parallel edges are summed into weights once, before the iterations."""
    with spread(edges, vertices):
        weighted = materialize(edges.groupBy("src", "dst").agg(F.count("*").alias("weight")), "weights")
        return run_program(PageRank(damping, iterations), vertices, weighted)[0].select("id", "rank")


class ShortestDistance(VertexProgram):
    """Least sum of an edge column from one vertex, over at most max_depth edges."""

    def __init__(self, source: int, weight: str = "distance", max_depth: int = 10, scope: str = "out") -> None:
        self.source, self.weight, self.max_depth, self.scope = source, weight, max_depth, scope

    def setup(self, vertices: DataFrame, edges: DataFrame) -> DataFrame:
        first = F.when(F.col("id") == self.source, F.lit(0.0))
        return vertices.select("id", first.alias("distance_to"), (F.col("id") == self.source).alias("changed"))

    def sends(self, memory: Memory) -> Column:
        return F.col("changed")

    def message(self, memory: Memory) -> Column:
        return F.col("distance_to") + F.col(self.weight)

    def combine(self, message: Column) -> Column:
        return F.min(message)

    def update(self, memory: Memory) -> dict[str, Column]:
        better = F.coalesce(F.col("inbox") < F.coalesce("distance_to", F.lit(float("inf"))), F.lit(False))
        return {"changed": better, "distance_to": F.when(better, F.col("inbox")).otherwise(F.col("distance_to"))}

    def aggregates(self) -> dict[str, Column]:
        return {"moving": F.coalesce(F.max(F.col("changed").cast("int")), F.lit(0))}

    def terminate(self, memory: Memory) -> bool:
        return not memory.values["moving"] or memory.iteration + 1 >= self.max_depth


def shortest_distance(vertices: DataFrame, edges: DataFrame, source: int, weight: str = "distance", max_depth: int = 10, scope: str = "out") -> DataFrame:
    """(id, distance_to): reachable vertices only. Parallel edges count with their least weight."""
    with spread(edges, vertices):
        least = materialize(edges.groupBy("src", "dst").agg(F.min(weight).alias(weight)), "weights")
        return run_program(ShortestDistance(source, weight, max_depth, scope), vertices, least)[0].where("distance_to is not null").select("id", "distance_to")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge (src, dst: bigint), edges taken both ways: component is the smallest node reachable. Null ends, loops and repeated edges are ignored.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) on the edges alone, each an aggregate and a join of written tables: the number of rounds grows with the
    logarithm of the size, not with the diameter; hubs are pre-aggregated before the shuffle and their joins can be split at run time. A round's tables go once the next has been written.
    """
    u, v = F.greatest("src", "dst"), F.least("src", "dst")
    e = materialize(edges.where("src is not null and dst is not null and src != dst").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        moved = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(moved.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _mark(nxt)
        release(e, least, large, below)
        e = nxt
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all vertices: component is the smallest id reachable, edges taken both ways."""
    named = components(edges).select(F.col("node").alias("id"), "component")
    return vertices.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); a loop counts once in, once out. One shuffle of pre-aggregated counts."""
    one = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = one.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    d = vertices.select("id").join(n, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def k_step_degree(vertices: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """(id, walks): number of directed walks of k edges from each vertex. Counts are passed back along edges, which are dealt by their end once, so no walk is ever a row."""
    with spread(edges, vertices):
        weighted = dealt(edges.groupBy("src", "dst").agg(F.count("*").alias("w")), "dst", "weights")
        n = vertices.select("id", F.lit(1).cast("bigint").alias("walks"))
        for _ in range(k):
            step = weighted.join(n, F.col("dst") == F.col("id")).groupBy("src").agg(F.sum(F.col("w") * F.col("walks")).alias("walks"))
            n = materialize(vertices.select("id").join(step, F.col("id") == F.col("src"), "left").select("id", F.coalesce("walks", F.lit(0)).cast("bigint").alias("walks")), "walks")
    return n


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int, target: Column | None = None, max_distance: int = 10) -> DataFrame:
    """(id, hops, path): one fewest-edges path from source to each vertex (each target: a condition on id), the one with the smallest predecessors."""
    with spread(edges, vertices):
        pairs = dealt(edges.select("src", "dst").distinct(), "src", "pairs")
        seen = materialize(vertices.where(F.col("id") == source).select("id", F.lit(0).alias("hops"), F.array("id").alias("path")), "paths")
        front = seen
        for hop in range(1, max_distance + 1):
            nxt = front.join(pairs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("path").alias("via"))
            nxt = nxt.join(seen.select(F.col("id").alias("to")), "to", "left_anti")
            front = materialize(nxt.select(F.col("to").alias("id"), F.lit(hop).alias("hops"), F.concat("via", F.array("to")).alias("path")), "front")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    return seen.where(target) if target is not None else seen


def peer_pressure(vertices: DataFrame, edges: DataFrame, iterations: int = 30) -> DataFrame:
    """(id, cluster): every vertex takes the cluster most voted for by its in-neighbours (each voting 1 / out-degree), ties to the smallest, until none changes, for at most `iterations` rounds:
    clusters of some graphs swap for ever, so the limit is part of the result's definition."""
    with spread(edges, vertices):
        weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
        degree = edges.groupBy("src").agg(F.count("*").alias("d"))
        votes = dealt(weighted.join(degree, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("vote")), "src", "votes")
        state = dealt(vertices.select("id", F.col("id").alias("cluster")), "id", "clusters")
        for _ in range(iterations):
            cast = votes.join(state, F.col("src") == F.col("id")).groupBy("dst", "cluster").agg(F.round(F.sum("vote"), 9).alias("votes"))
            best = cast.groupBy("dst").agg(F.max_by("cluster", F.struct("votes", -F.col("cluster"))).alias("best"))
            new = state.join(best, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("best", "cluster").alias("cluster"), (F.coalesce("best", "cluster") != F.col("cluster")).alias("moved"))
            old, new = state, dealt(new, "id", "clusters")
            release(old)
            state = new.select("id", "cluster")
            if new.where("moved").isEmpty():
                break
    return state
