"""Change logs on Structured Streaming: processors with identifiers, start times and retries, and the state of changes they are given.

A change row has: tx (transaction), ts, kind (vertex, edge, property), change (ADDED, REMOVED), vertex, type, other, value.
A processor's identifier names its checkpoint, so it goes on where it stopped, and each micro-batch is handed over once it succeeds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.lineage import shared_dir

ADDED, REMOVED, ANY = "ADDED", "REMOVED", "ANY"


@dataclass(frozen=True)
class ChangeState:
    """What a batch of changes did: views of its rows."""

    rows: DataFrame

    def _of(self, change: str) -> DataFrame:
        return self.rows if change == ANY else self.rows.where(F.col("change") == change)

    def vertices(self, change: str = ANY) -> DataFrame:
        """Distinct vertices that were added or removed; with ANY also those whose relations changed."""
        d = self._of(change) if change == ANY else self._of(change).where("kind = 'vertex'")
        return d.select("vertex").distinct()

    def relations(self, change: str = ANY, *types: str) -> DataFrame:
        d = self._of(change).where("kind in ('edge', 'property')")
        return d.where(F.col("type").isin(list(types))) if types else d

    def edges(self, change: str = ANY, vertex=None, direction: str = "both", *labels: str) -> DataFrame:
        d = self._of(change).where("kind = 'edge'")
        d = d.where(F.col("type").isin(list(labels))) if labels else d
        if vertex is not None:
            out, in_ = F.col("vertex") == vertex, F.col("other") == vertex
            d = d.where({"out": out, "in": in_, "both": out | in_}[direction])
        return d

    def properties(self, change: str = ANY, vertex=None, *keys: str) -> DataFrame:
        d = self._of(change).where("kind = 'property'")
        d = d.where(F.col("type").isin(list(keys))) if keys else d
        return d.where(F.col("vertex") == vertex) if vertex is not None else d


@dataclass
class LogProcessor:
    """Built by ChangeLog.processor(identifier)."""

    log: ChangeLog
    identifier: str
    start_time: str | None = None
    retries: int = 1
    processors: list[Callable[[DataFrame, ChangeState], None]] = field(default_factory=list)

    def set_start_time(self, ts: str) -> LogProcessor:
        """Changes before it are not read; without it, an identifier's first run reads all."""
        self.start_time = ts
        return self

    def set_retry_attempts(self, n: int) -> LogProcessor:
        self.retries = n
        return self

    def add_processor(self, f: Callable[[DataFrame, ChangeState], None]) -> LogProcessor:
        self.processors.append(f)
        return self

    def run(self, once: bool = True):
        """Process what there is (once) or keep going; returns the query."""
        changes = self.log.stream()
        if self.start_time:
            changes = changes.where(F.col("ts") >= F.lit(self.start_time).cast("timestamp"))

        def batch(df: DataFrame, number: int) -> None:
            for p in self.processors:
                for attempt in range(max(1, self.retries)):
                    try:
                        p(df, ChangeState(df))
                        break
                    except Exception:
                        if attempt + 1 >= max(1, self.retries):
                            raise

        place = f"{shared_dir(self.log.spark)}/graphloom/log-{self.log.name}/{self.identifier}"
        w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", place)
        q = (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()
        if once:
            q.awaitTermination()
        return q


@dataclass
class ChangeLog:
    """A log read from files: path, their schema, and a function from file rows to change rows."""

    spark: SparkSession
    name: str
    path: str
    schema: StructType
    to_changes: Callable[[DataFrame], DataFrame]
    glob: str | None = None
    format: str = "parquet"

    def stream(self) -> DataFrame:
        r = self.spark.readStream.format(self.format).schema(self.schema)
        r = r.option("pathGlobFilter", self.glob) if self.glob else r
        return self.to_changes(r.load(self.path))

    def batch(self) -> DataFrame:
        r = self.spark.read.format(self.format).schema(self.schema)
        r = r.option("pathGlobFilter", self.glob) if self.glob else r
        return self.to_changes(r.load(self.path))

    def processor(self, identifier: str) -> LogProcessor:
        return LogProcessor(self, identifier)


def time_at_rank(times: DataFrame, rank: Callable[[int], int], buckets: int = 1024) -> str | None:
    """The time in place rank(n) (from 0) of the n times that aren't null in the only column, as text of the session's zone; None if there is none. Exact: counts over ever narrower intervals, so the
    driver has `buckets` counts at once, whatever the size."""
    t = times.select(F.unix_micros(F.col(times.columns[0]).cast("timestamp")).alias("t")).where("t is not null")
    low, high, n = t.agg(F.min("t"), F.max("t"), F.count("*")).first()
    if not n:
        return None
    left = rank(n)
    if not 0 <= left < n:
        raise ValueError(f"no such place: {left} of {n}")
    while low < high:
        width = (high - low) // buckets + 1
        nth = F.expr(f"(t - {low}L) div {width}L").alias("nth")
        for i, c in sorted(t.where((F.col("t") >= low) & (F.col("t") <= high)).groupBy(nth).agg(F.count("*")).collect()):
            if left < c:
                low, high = low + i * width, min(high, low + (i + 1) * width - 1)
                break
            left -= c
    return times.sparkSession.range(1).select(F.timestamp_micros(F.lit(low)).cast("string")).first()[0]


def append_changes(changes: DataFrame, path: str) -> None:
    """The log's writing side: one file set per transaction batch."""
    changes.write.mode("append").parquet(path)


def counts_by_window(changes: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes per window of their time and type; rows later than the watermark allows are left out of a stream."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "change", "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "change", "type", "n")
