"""Bulk-synchronous vertex programs and map-reduce over their results.

A superstep is one plan: state joined with edges gives messages, messages to a vertex are combined by an aggregate (partial before the shuffle), and the state is updated by a left join.
Edges are dealt by their sender once, with the columns that messages name, and state by vertex, both in equal buckets: only messages are shuffled. State is written after every superstep, so the plan never grows and a lost
executor repeats one superstep's tasks; the state before the last is deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.lineage import dealt, materialize, release, spread
from graphloom.schema import PropertyKey


@dataclass
class Memory:
    """Global values of a run: `iteration`, and what aggregates() gave after the last superstep."""

    iteration: int = 0
    values: dict = field(default_factory=dict)


class VertexProgram:
    """Subclass and override. State columns are those that setup() adds to (id)."""

    #: Edges are walked against their direction if "in", both ways if "both".
    scope = "out"
    max_iterations = 100

    def setup(self, vertices: DataFrame, edges: DataFrame) -> DataFrame:
        return vertices

    def message(self, memory: Memory) -> Column | None:
        """Local scope. Sent along each edge, from state columns (of the sender) and edge columns; null: nothing is sent."""
        return None

    def send_to(self, memory: Memory) -> tuple[Column, Column] | None:
        """Global scope: (vertex id, message) from state columns, to any vertex whether or not an edge leads there; null: nothing is sent."""
        return None

    def sends(self, memory: Memory) -> Column:
        """Which vertices send."""
        return F.lit(True)

    def combine(self, message: Column) -> Column:
        """Aggregate over the messages to one vertex."""
        return F.sum(message)

    def update(self, memory: Memory) -> dict[str, Column]:
        """New values of state columns from the old ones and `inbox` (null: no message)."""
        raise NotImplementedError

    def aggregates(self) -> dict[str, Column]:
        """Aggregates over the state, kept in memory.values after each superstep."""
        return {}

    def terminate(self, memory: Memory) -> bool:
        """Asked after each superstep, before the iteration is counted."""
        return memory.iteration >= self.max_iterations


@dataclass
class MapReduce:
    """map: (key, value) Columns over the result's state; reduce: an aggregate of value per key, or none; sort: by key."""

    map: tuple[Column, Column]
    reduce: Callable[[Column], Column] | None = None
    sort: bool = False

    def run(self, state: DataFrame) -> DataFrame:
        out = state.select(self.map[0].alias("key"), self.map[1].alias("value")).where(F.col("key").isNotNull())
        if self.reduce:
            out = out.groupBy("key").agg(self.reduce(F.col("value")).alias("value"))
        return out.orderBy("key") if self.sort else out


@dataclass
class Result:
    state: DataFrame
    memory: Memory
    reduced: dict[str, DataFrame]
    graph: PropertyGraph | None = None


class GraphComputer:
    """compute(graph).vertices(filter).edges(filter).program(p).map_reduce(name, mr).submit()."""

    def __init__(self, graph: PropertyGraph, vertex_labels=None, edge_labels=None) -> None:
        self.graph, self.vertex_labels, self.edge_labels = graph, vertex_labels, edge_labels
        self._vertices = self._edges = None
        self._program: VertexProgram | None = None
        self._jobs: dict[str, MapReduce] = {}
        self._mode, self._workers = "NONE", None

    def vertices(self, condition: Column) -> GraphComputer:
        self._vertices = condition
        return self

    def edges(self, condition: Column) -> GraphComputer:
        self._edges = condition
        return self

    def program(self, p: VertexProgram) -> GraphComputer:
        self._program = p
        return self

    def map_reduce(self, name: str, job: MapReduce) -> GraphComputer:
        self._jobs[name] = job
        return self

    def workers(self, n: int) -> GraphComputer:
        """How many tasks work on the messages at once, while submit() runs."""
        if n < 1:
            raise ValueError("a computer needs a worker")
        self._workers = n
        return self

    def result(self, mode: str) -> GraphComputer:
        """NONE: state only. PERSIST: a new graph whose vertices have the state's columns as properties, written. LOCALTX: the same graph object sees them until its own `rollback()`; nothing is written
        beyond the state itself."""
        if mode not in ("NONE", "PERSIST", "LOCALTX"):
            raise ValueError(f"no such result mode: {mode}")
        self._mode = mode
        return self

    def submit(self) -> Result:
        v = self.graph.vertex_frame(self.vertex_labels)
        e = self.graph.edge_frame(self.edge_labels)
        v = v.where(self._vertices) if self._vertices is not None else v
        e = e.where(self._edges) if self._edges is not None else e
        ids = v.select("id")
        if self._vertices is not None:
            e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        conf, before = self.graph.spark.conf, self.graph.spark.conf.get("spark.sql.shuffle.partitions")
        try:
            if self._workers:
                conf.set("spark.sql.shuffle.partitions", str(self._workers))
            with nullcontext() if self._workers or not self._program else spread(e, v):
                state, memory = run_program(self._program, v, e) if self._program else (v, Memory())
        finally:
            conf.set("spark.sql.shuffle.partitions", before)
        reduced = {n: j.run(state) for n, j in self._jobs.items()}
        if self._mode == "NONE":
            return Result(state, memory, reduced)
        graph = self.graph.copy()
        new = [c for c in state.columns if c != "id"]
        for label in graph.vertices:
            if self.vertex_labels is None or label in self.vertex_labels:
                df = graph.vertices[label]
                df = df.drop(*new).join(state, "id", "left")
                graph.vertices[label] = materialize(df, "persisted") if self._mode == "PERSIST" else df
        for c, t in state.dtypes:
            if c != "id":
                graph.schema.keys.setdefault(c, PropertyKey(c, t))
        if self._mode == "LOCALTX":
            self.graph.begin(graph)
        return Result(state, memory, reduced, graph if self._mode == "PERSIST" else self.graph)


def run_program(p: VertexProgram, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, Memory]:
    if p.scope != "out":
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
        edges = turned if p.scope == "in" else edges.unionByName(turned)
    memory = Memory()
    setup = materialize(p.setup(vertices, edges), "setup")
    state = dealt(setup, "id", "state")
    whole, edges, have = edges, None, {"src", "dst"}
    for name, c in p.aggregates().items():
        memory.values[name] = state.agg(c).first()[0]
    while True:
        local, anywhere = p.message(memory), p.send_to(memory)
        sender = state.where(p.sends(memory))
        sent = []
        if local is not None:
            asked = have | _asked(sender.join(whole, F.col("id") == F.col("src")).select(local), whole)
            if edges is None or asked != have:
                old, edges, have = edges, dealt(whole.select(*[c for c in whole.columns if c in asked]), "src", "edges"), asked
                release(*filter(None, [old]))
            sent.append(sender.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), local.alias("msg")))
        if anywhere is not None:
            sent.append(sender.select(anywhere[0].cast("bigint").alias("to"), anywhere[1].alias("msg")))
        if sent:
            inbox = reduce(DataFrame.unionByName, sent).where("msg is not null and to is not null").groupBy("to").agg(p.combine(F.col("msg")).alias("inbox"))
            full = state.join(inbox, F.col("id") == F.col("to"), "left").drop("to")
        else:
            full = state.withColumn("inbox", F.lit(None).cast("double"))
        old, state = state, dealt(full.withColumns(p.update(memory)).select(*state.columns), "id", "state")
        release(old)
        if p.aggregates():
            row = state.agg(*[c.alias(n) for n, c in p.aggregates().items()]).first()
            memory.values |= row.asDict()
        if p.terminate(memory):
            release(*filter(None, [edges]), setup)
            return state, memory
        memory.iteration += 1


def _asked(messages: DataFrame, edges: DataFrame) -> set[str]:
    """Columns of the edges that the messages are made of."""
    names, found = set(), messages._jdf.queryExecution().analyzed().references().iterator()
    while found.hasNext():
        names.add(found.next().name().lower())
    return {c for c in edges.columns if c.lower() in names}
