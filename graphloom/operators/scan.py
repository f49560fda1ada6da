"""Scan jobs: every vertex with what it declares to need of its relations, a callback over batches of them, and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


@dataclass(frozen=True)
class VertexScan:
    """A job over all vertices of some labels (or those that a condition keeps). Declared queries come as columns, so a callback never asks the graph."""

    graph: PropertyGraph
    labels: tuple[str, ...]
    condition: Column | None = None
    declared: tuple = ()

    def where(self, condition: Column) -> VertexScan:
        return replace(self, condition=condition)

    def totals(self, direction: str, *labels: str, **columns: Column) -> VertexScan:
        """Aggregates over each vertex's incident edges of these labels, combined before they are shuffled; null for vertices without such edges."""
        return replace(self, declared=(*self.declared, (direction, labels, columns, None)))

    def relations(self, name: str, direction: str, *labels: str, limit: int, keys: tuple[str, ...] = ()) -> VertexScan:
        """A list (adjacent, eid, keys...) of up to `limit` incident edges, as column `name`; a hub has no more than that."""
        return replace(self, declared=(*self.declared, (direction, labels, {name: keys}, limit)))

    def frame(self) -> DataFrame:
        """(id, label, properties, declared columns)."""
        v = self.graph.vertex_frame(self.labels)
        v = v.where(self.condition) if self.condition is not None else v
        for direction, labels, columns, limit in self.declared:
            q = self.graph.multi_query(v).direction(direction).labels(*labels)
            if limit is None:
                got = q.edges().groupBy("seed").agg(*[c.alias(n) for n, c in columns.items()])
            else:
                ((name, keys),) = columns.items()
                got = q.limit(limit).edges().groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("adjacent", "eid", *keys))).alias(name))
            v = v.join(got, F.col("id") == F.col("seed"), "left").drop("seed")
        return v

    def process(self, callback: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """What the callback makes of batches of the frame."""
        return self.frame().mapInPandas(callback, schema)

    def counters(self, **columns: Column) -> DataFrame:
        """One row: the sums of these columns over the frame, and `vertices`, their number."""
        return self.frame().agg(F.count("*").alias("vertices"), *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for n, c in columns.items()])
