"""Condition queries: graph-centric (vertices, edges or properties by conditions) and vertex-centric (incident relations of many vertices at once)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.predicates import P, as_predicate
from graphloom.graph import PropertyGraph


@dataclass(frozen=True)
class GraphQuery:
    """Conditions on one element; an unknown key is absent everywhere. or_ branches may have their own order and limit and are merged without repeats."""

    graph: PropertyGraph
    conditions: tuple = ()
    branches: tuple = ()
    orders: tuple = ()
    count_limit: int | None = None
    start: int = 0
    labels: tuple = ()

    def has(self, key: str, *value) -> GraphQuery:
        """has(key), has(key, value or P), has(key, P-factory, value)."""
        p = P.neq(None) if not value else as_predicate(value[0]) if len(value) == 1 else value[0](value[1])
        return replace(self, conditions=(*self.conditions, (key, p)))

    def has_not(self, key: str, *value) -> GraphQuery:
        p = P.eq(None) if not value else P.neq(value[0])
        return replace(self, conditions=(*self.conditions, (key, p)))

    def has_label(self, *labels: str) -> GraphQuery:
        return replace(self, labels=labels)

    def interval(self, key: str, low, high) -> GraphQuery:
        return self.has(key, P.between(low, high))

    def or_(self, *queries: GraphQuery) -> GraphQuery:
        return replace(self, branches=(*self.branches, queries))

    def order_by(self, key: str, order: str = "asc") -> GraphQuery:
        return replace(self, orders=(*self.orders, (key, order)))

    def limit(self, n: int) -> GraphQuery:
        if n < 0:
            raise ValueError("a limit is 0 or more")
        return replace(self, count_limit=n)

    def offset(self, n: int) -> GraphQuery:
        return replace(self, start=n)

    def _condition(self, df: DataFrame) -> Column:
        kinds = dict(df.dtypes)
        atoms = [p.column(F.col(k), kinds[k]) if k in kinds else p.column(F.lit(None).cast("string"), "string") for k, p in self.conditions]
        if self.labels:
            atoms.append(F.col("label").isin(list(self.labels)))
        for qs in self.branches:
            if all(not q.orders and q.count_limit is None for q in qs):
                atoms.append(reduce(Column.__or__, [q._condition(df) for q in qs]))
        return reduce(Column.__and__, atoms, F.lit(True))

    def _cut(self, df: DataFrame, key: str) -> DataFrame:
        if self.orders:
            by = [F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in self.orders]
            df = df.orderBy(*by, key)
        elif self.count_limit is not None or self.start:
            df = df.orderBy(key)
        df = df.offset(self.start) if self.start else df
        return df.limit(self.count_limit) if self.count_limit is not None else df

    def _run(self, df: DataFrame, key: str) -> DataFrame:
        out = df.where(self._condition(df))
        for qs in self.branches:
            if any(q.orders or q.count_limit is not None for q in qs):
                parts = [q._cut(out.where(q._condition(out)), key) for q in qs]
                out = reduce(DataFrame.unionByName, parts).dropDuplicates([key])
        return self._cut(out, key)

    def vertices(self) -> DataFrame:
        return self._run(self.graph.vertex_frame(self.labels or None), "id")

    def edges(self) -> DataFrame:
        return self._run(self.graph.edge_frame(self.labels or None), "eid")

    def properties(self) -> DataFrame:
        """Property elements (id, label, key, value); conditions are on these names."""
        return self._run(self.graph.property_frame(self.labels or None), "id")

    def count(self) -> int:
        return self.vertices().count()

    def explain(self) -> str:
        return f"conditions on {[k for k, _ in self.conditions]}, labels {list(self.labels)}, order {list(self.orders)}, limit {self.count_limit}"


@dataclass(frozen=True)
class VertexList:
    """A bag of vertex ids with the order that was asked for last: rows (id, at), at a number that sets it. Lists stay distributed."""

    df: DataFrame
    ordered: bool = False

    def ids(self) -> DataFrame:
        return self.df.select("id")

    def add_all(self, other: VertexList) -> VertexList:
        """Both bags; the order is lost, as that of an unsorted list is."""
        return VertexList(self.ids().unionByName(other.ids()))

    def sort(self) -> VertexList:
        return VertexList(self.ids(), True)

    def sub_list(self, start: int, length: int) -> VertexList:
        """Of a sorted list, the ids from position start on, at most length of them."""
        if not self.ordered:
            raise ValueError("only a sorted list has positions")
        return VertexList(self.ids().orderBy("id").offset(start).limit(length), True)

    def size(self) -> int:
        return self.df.count()


@dataclass(frozen=True)
class VertexQuery:
    """Relations of the vertices in seeds (a DataFrame with a column id): for one vertex or for many, in one plan."""

    graph: PropertyGraph
    seeds: DataFrame
    way: str = "both"
    names: tuple = ()
    other: tuple = ()
    conditions: tuple = ()
    orders: tuple = ()
    most: int | None = None

    def direction(self, way: str) -> VertexQuery:
        return replace(self, way=way.lower())

    def labels(self, *names: str) -> VertexQuery:
        return replace(self, names=names)

    types = keys = labels

    def adjacent(self, *ids: int) -> VertexQuery:
        return replace(self, other=ids)

    def has(self, key: str, *value) -> VertexQuery:
        p = P.neq(None) if not value else as_predicate(value[0])
        return replace(self, conditions=(*self.conditions, (key, p)))

    def has_not(self, key: str) -> VertexQuery:
        return replace(self, conditions=(*self.conditions, (key, P.eq(None))))

    def interval(self, key: str, low, high) -> VertexQuery:
        return self.has(key, P.between(low, high))

    def order_by(self, key: str, order: str = "asc") -> VertexQuery:
        return replace(self, orders=(*self.orders, (key, order)))

    def limit(self, n: int) -> VertexQuery:
        return replace(self, most=n)

    def edges(self) -> DataFrame:
        """(seed, adjacent, direction, eid, label, properties...): a loop comes once out and once in."""
        e = self.graph.edge_frame(self.names or None)
        kinds = dict(e.dtypes)
        for k, p in self.conditions:
            e = e.where(p.column(F.col(k), kinds[k]) if k in kinds else p.column(F.lit(None).cast("string"), "string"))
        rest = [c for c in e.columns if c not in ("src", "dst")]
        sides = []
        for way, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
            if self.way in (way, "both"):
                sides.append(e.select(F.col(here).alias("seed"), F.col(there).alias("adjacent"), F.lit(way).alias("direction"), *rest))
        df = reduce(DataFrame.unionByName, sides)
        if self.other:
            df = df.where(F.col("adjacent").isin(list(self.other)))
        df = df.join(self.seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
        if self.most is not None:
            by = [F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in self.orders]
            nth = F.row_number().over(Window.partitionBy("seed").orderBy(*by, "eid", "direction"))
            df = df.withColumn("_nth", nth).where(F.col("_nth") <= self.most).drop("_nth")
        return df

    def vertex_ids(self) -> DataFrame:
        return self.edges().select("seed", "adjacent")

    def vertices(self) -> DataFrame:
        v = self.graph.vertex_frame()
        return self.vertex_ids().join(v, F.col("adjacent") == F.col("id")).drop("adjacent")

    def properties(self) -> DataFrame:
        """(seed, key, value) of the seeds' own properties."""
        p = self.graph.property_frame(keys=self.names or None).withColumnRenamed("id", "seed")
        return p.join(self.seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")

    def relations(self) -> DataFrame:
        """Edges and properties as (seed, kind, type, value)."""
        e = self.edges().select("seed", F.lit("edge").alias("kind"), F.col("label").alias("type"), F.col("adjacent").cast("string").alias("value"))
        return e.unionByName(self.properties().select("seed", F.lit("property").alias("kind"), F.col("key").alias("type"), "value"))

    def vertex_list(self) -> VertexList:
        return VertexList(self.vertex_ids().select(F.col("adjacent").alias("id")))

    def drop(self) -> PropertyGraph:
        """The graph without the edges found."""
        e = self.edges()
        out = F.col("direction") == "out"
        ends = [F.when(out, F.col("seed")).otherwise(F.col("adjacent")).alias("src"), F.when(out, F.col("adjacent")).otherwise(F.col("seed")).alias("dst")]
        return self.graph.with_changes(remove_edges=e.select("eid", "label", *ends))

    def collected(self) -> DataFrame:
        """(seed, relations: array): one row per seed that has any."""
        return self.edges().groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("label", "adjacent", "eid"))).alias("relations"))

    def edge_count(self) -> DataFrame:
        """(seed, n), 0 for seeds without."""
        n = self.edges().groupBy("seed").agg(F.count("*").alias("n"))
        return self.seeds.select(F.col("id").alias("seed")).distinct().join(n, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    count = edge_count

    def property_count(self) -> DataFrame:
        n = self.properties().groupBy("seed").agg(F.count("*").alias("n"))
        return self.seeds.select(F.col("id").alias("seed")).distinct().join(n, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
