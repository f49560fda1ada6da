"""Transactions: changes that their own queries see, taken back or made for good, and written to a change log if the transaction has an identifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.streaming.changes import ADDED, REMOVED, append_changes

LOG = "tx bigint, ts timestamp, kind string, change string, vertex bigint, type string, other bigint, value string"


class Transaction:
    """Made by begin(graph, ...). read_only: changes are refused. log_path: where commit() appends the changes, as rows of LOG under the number `tx`. check: as in with_changes()."""

    def __init__(self, graph: PropertyGraph, read_only: bool = False, log_path: str | None = None, tx: int = 0, check: bool | None = None) -> None:
        self.before, self.graph = graph, graph
        self.read_only, self.log_path, self.tx, self.check = read_only, log_path, tx, check
        self._log: list[DataFrame] = []
        self.open = True

    def change(self, **changes) -> Transaction:
        """The changes of with_changes(); queries on `graph` see them from now on."""
        if self.read_only or not self.open:
            raise ValueError("the transaction is read-only or closed")
        self._log += self._rows(changes) if self.log_path else []
        self.graph = self.graph.with_changes(check=self.check, **changes)
        return self

    def _rows(self, changes: dict) -> list[DataFrame]:
        null = F.lit(None)

        def rows(df: DataFrame, kind: str, change: str, vertex: Column, type_: Column, other: Column = null, value: Column = null) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), F.lit(change).alias("change"), vertex.cast("bigint").alias("vertex"), type_.cast("string").alias("type"), other.cast("bigint").alias("other"), value.cast("string").alias("value"))

        out = []
        for label, df in (changes.get("add_vertices") or {}).items():
            out.append(rows(df, "vertex", ADDED, F.col("id"), F.lit(label)))
            for c in df.columns:
                if c != "id":
                    out.append(rows(df.where(F.col(c).isNotNull()), "property", ADDED, F.col("id"), F.lit(c), value=F.col(c)))
        for label, df in (changes.get("add_edges") or {}).items():
            out.append(rows(df, "edge", ADDED, F.col("src"), F.lit(label), F.col("dst"), F.col("eid")))
        for _, (key, df) in (changes.get("set_properties") or {}).items():
            out.append(rows(df, "property", ADDED, F.col("id"), F.lit(key), value=F.col("value")))
        gone = changes.get("remove_vertices")
        if gone is not None:
            out.append(rows(gone, "vertex", REMOVED, F.col("id"), null))
            ids = gone.select(F.col("id").alias("gone")).distinct()
            for label, t in self.graph.edge_tables():  # their edges go with them, each once
                ends = t.df.select("eid", "src", "dst")
                hit = ends.join(ids, F.col("src") == F.col("gone"), "left_semi").unionByName(ends.join(ids, F.col("dst") == F.col("gone"), "left_semi").join(ids, F.col("src") == F.col("gone"), "left_anti"))
                out.append(rows(hit, "edge", REMOVED, F.col("src"), F.lit(label), F.col("dst"), F.col("eid")))
        if changes.get("remove_edges") is not None:
            df = changes["remove_edges"]
            known = lambda c: F.col(c) if c in df.columns else null
            out.append(rows(df, "edge", REMOVED, known("src"), known("label"), known("dst"), F.col("eid")))
        return out

    def commit(self) -> PropertyGraph:
        """The changed graph; the log is appended to first, so what is seen has been logged."""
        if self._log and self.open:
            append_changes(reduce(DataFrame.unionByName, self._log).select(F.lit(self.tx).cast("bigint").alias("tx"), F.current_timestamp().alias("ts"), "kind", "change", "vertex", "type", "other", "value"), self.log_path)
        self.open = False
        return self.graph

    def rollback(self) -> PropertyGraph:
        """The graph as it was; nothing is logged."""
        self.open, self.graph = False, self.before
        return self.before


def begin(graph: PropertyGraph, **switches) -> Transaction:
    return Transaction(graph, **switches)
