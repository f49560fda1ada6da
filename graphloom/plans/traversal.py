"""Traversals: a fluent list of steps, compiled to one lazy DataFrame plan.

A frame is a DataFrame of traversers: the current object, and what must be carried along (bindings, path, loop counter, sack, and the origins of
enclosing local scopes). Expansion is an equi-join on ids, properties are joined when first asked for, and Catalyst prunes the rest.

A child traversal that must be answered per traverser (where, coalesce, project().by, local, ...) runs once over the distinct current objects, keyed by them, and is joined back:
no row numbers, so plans stay the same when tasks run again, and equal traversers share the work.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.predicates import P, as_predicate
from graphloom.graph import RESERVED, SHIFT, PropertyGraph
from graphloom.lineage import materialize, share

FILTERS = {"has", "has_not", "has_label", "has_id", "is_"}
REDUCERS = {"count", "sum_", "min_", "max_", "mean", "fold", "group", "group_count"}
LOCAL = REDUCERS | {"limit", "range_", "skip", "tail", "order", "dedup", "sample"}
PATHS = {"path", "simple_path", "cyclic_path", "tree"}


class T:
    id = "~id"
    label = "~label"
    #: Of an edge reached from a vertex: its other end's id.
    adjacent = "~adjacent"


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"{self.name}({', '.join([*map(repr, self.args), *(f'{k}={v!r}' for k, v in self.kwargs.items())])})"


class Traversal:
    """Steps in order; every method adds one. Made by Source (with a graph) or by `__` (anonymous, for children)."""

    def __init__(self, graph: PropertyGraph | None = None, steps: tuple[Step, ...] = (), options: dict | None = None) -> None:
        self.graph, self.steps, self.options = graph, steps, options or {}

    def _add(self, name: str, *args, **kwargs) -> Traversal:
        return Traversal(self.graph, (*self.steps, Step(name, args, kwargs)), self.options)

    def _amend(self, **kwargs) -> Traversal:
        last = self.steps[-1]
        return Traversal(self.graph, (*self.steps[:-1], Step(last.name, last.args, last.kwargs | kwargs)), self.options)

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in STEPS:
            raise AttributeError(name)
        return lambda *a, **k: self._add(name, *a, **k)

    def by(self, what=None, order: str = "asc") -> Traversal:
        return self._amend(by=(*self.steps[-1].kwargs.get("by", ()), (what, order)))

    def times(self, n: int) -> Traversal:
        return self._amend(times=n)

    def until(self, cond) -> Traversal:
        return self._amend(until=cond) if self.steps and self.steps[-1].name == "repeat" else self._add("pending", until=cond, until_first=True)

    def emit(self, cond=None) -> Traversal:
        return self._amend(emit=cond or True) if self.steps and self.steps[-1].name == "repeat" else self._add("pending", emit=cond or True, emit_first=True)

    def repeat(self, body: Traversal) -> Traversal:
        first = {}
        steps = self.steps
        while steps and steps[-1].name == "pending":
            first |= steps[-1].kwargs
            steps = steps[:-1]
        return Traversal(self.graph, (*steps, Step("repeat", (body,), first)), self.options)

    def option(self, value, branch: Traversal) -> Traversal:
        return self._amend(options=(*self.steps[-1].kwargs.get("options", ()), (value, branch)))

    def __repr__(self) -> str:
        return ".".join(map(repr, self.steps))

    # Results --------------------------------------------------------------------------------------------------------

    def frame(self) -> Frame:
        steps = optimize(self.steps)
        f = Frame(self.graph, None, "start", track=_mentions(steps, PATHS), options=self.options)
        return run(f, steps)

    def df(self) -> DataFrame:
        return self.frame().result()

    def explain(self) -> str:
        return f"{self!r}\n=> {optimize(self.steps)!r}\n" + self.df()._jdf.queryExecution().explainString(self.graph.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def profile(self) -> DataFrame:
        """(step, rows, seconds): each prefix of the steps, counted. Runs the traversal once per step."""
        import time

        rows, steps = [], optimize(self.steps)
        for i in range(1, len(steps) + 1):
            began = time.time()
            n = run(Frame(self.graph, None, "start", track=_mentions(steps, PATHS), options=self.options), steps[:i]).df.count()
            rows.append((repr(steps[i - 1]), n, time.time() - began))
        return self.graph.spark.createDataFrame(rows, "step string, rows bigint, seconds double")

    def drop_from_graph(self) -> PropertyGraph:
        """A new graph without the vertices (and their edges), or the edges, that the traversal reaches."""
        from graphloom.operators.mutate import drop

        return drop(self.graph, self.frame())


class _Anonymous:
    def __getattr__(self, name: str):
        return getattr(Traversal(), name)


__ = _Anonymous()


class Source:
    """graph.traversal(): V() and E() start a traversal."""

    def __init__(self, graph: PropertyGraph, options: dict | None = None) -> None:
        self.graph, self.options = graph, options or {}

    def with_sack(self, value) -> Source:
        return Source(self.graph, self.options | {"sack": value})

    def with_strict(self) -> Source:
        """Traversals whose start is a full scan are refused."""
        return Source(self.graph, self.options | {"strict": True})

    def with_computer(self) -> Source:
        """The same plan: every traversal is distributed already."""
        return self

    def V(self, *ids) -> Traversal:
        return Traversal(self.graph, (Step("V", ids),), self.options)

    def E(self, *ids) -> Traversal:
        return Traversal(self.graph, (Step("E", ids),), self.options)


def _mentions(steps, names: set[str]) -> bool:
    def inside(x) -> bool:
        return isinstance(x, Traversal) and _mentions(x.steps, names) or isinstance(x, (tuple, list)) and any(map(inside, x))

    return any(s.name in names or any(map(inside, s.args)) or any(map(inside, s.kwargs.values())) for s in steps)


def optimize(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Folds labels and ids that directly follow a start into it, drops steps without effect, joins limits, and pushes `has` before `order`."""
    out: list[Step] = []
    for s in steps:
        if s.name in ("identity", "barrier", "none_") and not s.kwargs:
            continue
        i = len(out) - 1
        while i > 0 and out[i].name in ("has", "has_not"):
            i -= 1
        if s.name in ("has_label", "has_id") and out and out[i].name in ("V", "E") and not any(isinstance(a, P) for a in s.args):
            key = "labels" if s.name == "has_label" else "ids"
            if key not in out[i].kwargs and not (key == "ids" and out[i].args):
                values = tuple(x for a in s.args for x in (a if isinstance(a, (list, tuple, set)) else (a,)))
                out[i] = Step(out[i].name, out[i].args, out[i].kwargs | {key: values})
                continue
        if s.name == "has" and out and out[-1].name == "order":
            out.insert(len(out) - 1, s)
            continue
        if s.name == "limit" and out and out[-1].name == "limit":
            out[-1] = Step("limit", (min(s.args[0], out[-1].args[0]),))
            continue
        out.append(s)
    return tuple(out)


@dataclass(frozen=True)
class Frame:
    graph: PropertyGraph
    df: DataFrame | None
    kind: str  # start, vertex, edge, value, property, map
    labels: tuple[str, ...] | None = None
    loaded: bool = False
    names: dict = field(default_factory=dict)  # binding -> (kind, labels)
    origins: tuple[str, ...] = ()
    starts: DataFrame | None = None  # the distinct origins of the innermost local scope
    track: bool = False
    order: tuple = ()
    effects: dict = field(default_factory=dict)  # side effects: name -> frame
    options: dict = field(default_factory=dict)

    # Columns --------------------------------------------------------------------------------------------------------

    @property
    def extras(self) -> list[str]:
        return [c for c in self.df.columns if c in self.origins or c.startswith("@") or c in ("_path", "_loops", "_sack", "_key")]

    @property
    def current(self) -> list[str]:
        return {"vertex": ["_id"], "edge": ["_id", "_src", "_dst", "_label", "_from"], "value": ["_val"], "property": ["_id", "_key_name", "_val"]}.get(self.kind, [])

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("p_") or c.startswith("m_")]

    @property
    def identity(self) -> list[str]:
        """What tells current objects apart."""
        return {"vertex": ["_id"], "edge": ["_id", "_src", "_dst", *self.props], "value": ["_val"], "property": ["_id", "_key_name", "_val"]}.get(self.kind, [c for c in self.df.columns if c not in self.extras])

    def this(self) -> Column:
        return F.col("_val" if self.kind in ("value", "property") else "_id")

    def with_df(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def walk(self, df: DataFrame, **changes) -> Frame:
        """A step to new objects: the path grows, an order is lost."""
        f = replace(self, df=df, order=(), **changes)
        if self.track and f.kind in ("vertex", "edge", "value", "property"):
            old = F.col("_path") if "_path" in df.columns else F.array().cast("array<string>")
            f = replace(f, df=f.df.withColumn("_path", F.concat(old, F.array(f.this().cast("string")))))
        return f

    def label(self) -> Column:
        if self.kind == "edge":
            return F.col("_label")
        if self.labels and len(self.labels) == 1:
            return F.lit(self.labels[0])
        known = [x for lbl, n in self.graph.numbers.items() for x in (F.lit(n), F.lit(lbl))]
        return F.element_at(F.create_map(*known), F.shiftright("_id", SHIFT).cast("int"))

    def load(self) -> Frame:
        """With the current vertex's properties as columns p_<key>."""
        if self.loaded or self.kind != "vertex":
            return self
        v = self.graph.vertex_frame(self.labels)
        v = v.select(F.col("id").alias("_vid"), *[F.col(c).alias(f"p_{c}") for c in v.columns if c not in (*RESERVED, "label")])
        return self.with_df(self.df.join(v, F.col("_id") == F.col("_vid")).drop("_vid"), loaded=True)

    def value(self, key: str) -> tuple[Column, str]:
        """The current element's property (or id, label) and its type; null if it has no such key. Load first."""
        if key == T.id:
            return F.col("_id"), "bigint"
        if key == T.label:
            return self.label(), "string"
        if key == T.adjacent and self.kind == "edge":
            return F.when(F.col("_from") == F.col("_src"), F.col("_dst")).otherwise(F.col("_src")), "bigint"
        kinds = dict(self.df.dtypes)
        for name in (f"p_{key}", f"m_{key}"):
            if name in kinds:
                return F.col(name), kinds[name]
        return F.lit(None).cast("string"), "string"

    # Results --------------------------------------------------------------------------------------------------------

    def result(self) -> DataFrame:
        f = self
        if f.order:
            f = f.with_df(f.df.orderBy(*f.order))
        if f.kind == "vertex":
            return f.df.select(F.col("_id").alias("id"), f.label().alias("label"))
        if f.kind == "edge":
            return f.df.select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[F.col(c).alias(c[2:]) for c in f.props if c[2:] not in ("id", "label", "src", "dst")])
        if f.kind == "value":
            return f.df.select(F.col("_val").alias("value"))
        if f.kind == "property":
            return f.df.select(F.col("_id").alias("id"), F.col("_key_name").alias("key"), F.col("_val").alias("value"), *[F.col(c).alias(c[2:]) for c in f.df.columns if c.startswith("m_")])
        return f.df.drop(*f.extras)


# Children --------------------------------------------------------------------------------------------------------------


def run(frame: Frame, steps) -> Frame:
    for s in steps:
        if s.name not in STEPS:
            raise ValueError(f"no such step: {s.name}")
        frame = STEPS[s.name](frame, *s.args, **s.kwargs)
    return frame


def child(frame: Frame, t: Traversal) -> tuple[Frame, list[tuple[str, str]]]:
    """The child's frame over the distinct current objects (and bindings), and the (column of frame, origin column of child) pairs to join on."""
    depth = len(frame.origins)
    seeds = [*frame.identity, *[f"@{n}" for n in frame.names]]
    if frame.kind == "edge":
        seeds = list(dict.fromkeys([*frame.current, *seeds]))
    pairs = [(c, f"_o{depth}_{i}") for i, c in enumerate(seeds)]
    start = frame.df.select(*seeds).distinct().select("*", *[F.col(c).alias(o) for c, o in pairs])
    origins = tuple(o for _, o in pairs)
    f = Frame(frame.graph, start, frame.kind, frame.labels, frame.kind == "edge", frame.names, origins, start.select(*origins), options=frame.options, effects=frame.effects)
    return run(f, optimize(t.steps)), pairs


def matches(frame: Frame, other: DataFrame, pairs, how: str) -> DataFrame:
    cond = reduce(Column.__and__, [frame.df[c].eqNullSafe(other[o]) if c in ("_val",) or c.startswith("p_") else frame.df[c] == other[o] for c, o in pairs])
    return frame.df.join(other, cond, how)


def exists(frame: Frame, t: Traversal, wanted: bool) -> Frame:
    """Rows whose child has (lacks) a result. Filters on the current object need no join."""
    simple = condition(frame, t)
    if simple is not None:
        f, c = simple
        return f.with_df(f.df.where(c if wanted else ~c))
    c, pairs = child(frame, t)
    return frame.with_df(matches(frame, c.df.select(*[o for _, o in pairs]).distinct(), pairs, "left_semi" if wanted else "left_anti"))


def condition(frame: Frame, t: Traversal) -> tuple[Frame, Column] | None:
    """A child of nothing but filters on the current object, as a Column."""
    cond = F.lit(True)
    for s in t.steps:
        if s.name in FILTERS:
            frame, c = _filter_column(frame, s)
        elif s.name in ("and_", "or_") and s.args:
            parts = []
            for x in s.args:
                got = condition(frame, x)
                if got is None:
                    return None
                frame = got[0]
                parts.append(got[1])
            c = reduce(Column.__and__ if s.name == "and_" else Column.__or__, parts)
        elif s.name == "not_":
            got = condition(frame, s.args[0])
            if got is None:
                return None
            frame, c = got[0], ~got[1]
        else:
            return None
        cond = cond & c
    return frame, cond


def attach(frame: Frame, t: Traversal, value_only: bool = False) -> Frame:
    """frame's traversers moved to their child's results (none: dropped)."""
    return _moved(frame, *child(frame, t))


def _moved(frame: Frame, c: Frame, pairs) -> Frame:
    keep = [frame.df[x] for x in frame.extras]
    new = [x for x in [*c.current, *(c.props if c.loaded or c.kind == "edge" else [])] if x in c.df.columns] or [x for x in c.df.columns if x not in c.extras]
    renamed = c.df.select(*[F.col(o) for _, o in pairs], *[F.col(x).alias(f"_n{i}") for i, x in enumerate(new)])
    joined = matches(frame, renamed, pairs, "inner").select(*keep, *[F.col(f"_n{i}").alias(x) for i, x in enumerate(new)])
    return frame.walk(joined, kind=c.kind, labels=c.labels, loaded=c.loaded)


def scalar(frame: Frame, what, name: str) -> tuple[Frame, Column]:
    """A modulator's value per traverser: a key, T.id, T.label, a function of Column, or a child's (smallest) result."""
    if what is None:
        return frame, frame.this()
    if isinstance(what, str):
        f = frame if what in (T.id, T.label) else frame.load()
        return f, f.value(what)[0]
    if callable(what) and not isinstance(what, Traversal):
        return frame, what(frame.this())
    c, pairs = child(frame, what)
    one = c.df.groupBy(*[o for _, o in pairs]).agg(F.min(c.this()).alias(name))
    return frame.with_df(matches(frame, one, pairs, "left").drop(*[o for _, o in pairs])), F.col(name)


def unite(frames: list[Frame]) -> Frame:
    """Bag union of frames of one scope."""
    kinds = {f.kind for f in frames}
    if len(kinds) > 1:  # objects of different kinds: as text
        frames = [f.with_df(f.df.select(*f.extras, f.this().cast("string").alias("_val")), kind="value", loaded=False) for f in frames]
    first = frames[0]
    if first.kind == "vertex":
        frames = [f.with_df(f.df.select(*f.extras, "_id"), loaded=False) for f in frames]
    elif first.kind == "value" and len({dict(f.df.dtypes)["_val"] for f in frames}) > 1:
        frames = [f.with_df(f.df.withColumn("_val", F.col("_val").cast("string"))) for f in frames]
    labels = tuple(dict.fromkeys(x for f in frames for x in (f.labels or f.graph.vertex_labels())))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in frames])
    return replace(frames[0], df=df, labels=labels if first.kind == "vertex" else None, loaded=first.kind == "edge", order=())


# Steps -----------------------------------------------------------------------------------------------------------------

STEPS: dict = {}


def step(f):
    STEPS[f.__name__] = f
    return f


@step
def V(f: Frame, *ids, labels=None, ids_=None, **kw) -> Frame:
    ids = [x for i in (*ids, *(kw.get("ids") or ())) for x in (i if isinstance(i, (list, tuple)) else (i,))]
    if f.options.get("strict") and not ids and labels is None:
        raise ValueError("a full scan, which the strict mode refuses")
    if ids and labels is None:  # an id tells its label
        by_number = {n: x for x, n in f.graph.numbers.items()}
        labels = tuple({by_number.get(i >> SHIFT, "") for i in ids})
    labels = tuple(x for x in f.graph.vertex_labels() if labels is None or x in labels)
    v = f.graph.vertex_frame(labels)
    v = v.select(F.col("id").alias("_id"), *[F.col(c).alias(f"p_{c}") for c in v.columns if c not in (*RESERVED, "label")])
    v = v.where(F.col("_id").isin(ids)) if ids else v
    if f.options.get("sack") is not None:
        v = v.withColumn("_sack", F.lit(f.options["sack"]))
    return f.walk(v, kind="vertex", labels=labels, loaded=True)


@step
def E(f: Frame, *ids, labels=None, **kw) -> Frame:
    ids = [x for i in (*ids, *(kw.get("ids") or ())) for x in (i if isinstance(i, (list, tuple)) else (i,))]
    e = f.graph.edge_frame(labels)
    e = _edge_columns(e).withColumn("_from", F.lit(None).cast("bigint"))
    e = e.where(F.col("_id").isin(ids)) if ids else e
    return f.walk(e, kind="edge", loaded=True)


def _edge_columns(e: DataFrame) -> DataFrame:
    return e.select(F.col("eid").cast("string").alias("_id"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("label").alias("_label"), *[F.col(c).alias(f"p_{c}") for c in e.columns if c not in ("id", "eid", "src", "dst", "label")])


def _expand(f: Frame, way: str, labels, to_edge: bool) -> Frame:
    if f.kind != "vertex":
        raise ValueError(f"{way} needs vertices")
    parts = []
    for here, there in (("src", "dst"), ("dst", "src")):
        if way in ("both", "out" if here == "src" else "in"):
            tables = f.graph.edge_tables(labels, f.labels if here == "src" else None, f.labels if here == "dst" else None)
            ends = tuple(dict.fromkeys(t.in_label if here == "src" else t.out_label for _, t in tables))
            parts.append((here, there, ends, f.graph.edge_frame(labels, f.labels if here == "src" else None, f.labels if here == "dst" else None)))
    frames = []
    left = f.df.select(*f.extras, F.col("_id").alias("_at"))
    for here, there, ends, e in parts:
        if to_edge:
            j = left.join(_edge_columns(e), F.col("_at") == F.col(f"_{here}")).withColumnRenamed("_at", "_from")
            frames.append(f.with_df(j, kind="edge", labels=None, loaded=True, order=()))
        else:
            j = left.join(e.select(F.col(here).alias("_here"), F.col(there).alias("_id")), F.col("_at") == F.col("_here")).drop("_at", "_here")
            frames.append(f.with_df(j, kind="vertex", labels=ends, loaded=False, order=()))
    u = frames[0] if len(frames) == 1 else unite(frames)
    return f.walk(u.df, kind=u.kind, labels=u.labels, loaded=u.loaded)


for _way in ("out", "in", "both"):
    STEPS[_way + "_" * (_way == "in")] = lambda f, *labels, _w=_way: _expand(f, _w, labels, False)
    STEPS[f"{_way}_e"] = lambda f, *labels, _w=_way: _expand(f, _w, labels, True)


def _to_vertex(f: Frame, col: Column) -> Frame:
    ends = tuple(dict.fromkeys(x for _, t in f.graph.edge_tables() for x in (t.out_label, t.in_label)))
    return f.walk(f.df.select(*f.extras, col.alias("_id")), kind="vertex", labels=ends, loaded=False)


@step
def in_v(f: Frame) -> Frame:
    return _to_vertex(f, F.col("_dst"))


@step
def out_v(f: Frame) -> Frame:
    return _to_vertex(f, F.col("_src"))


@step
def other_v(f: Frame) -> Frame:
    """The end that the traverser didn't come from; of a loop, the same vertex."""
    return _to_vertex(f, F.when(F.col("_from") == F.col("_src"), F.col("_dst")).otherwise(F.col("_src")))


@step
def both_v(f: Frame) -> Frame:
    return _to_vertex(f, F.explode(F.array("_src", "_dst")))


# Filters


def _filter_column(f: Frame, s: Step) -> tuple[Frame, Column]:
    if s.name == "has_label":
        p = s.args[0] if len(s.args) == 1 and isinstance(s.args[0], P) else P.within(list(s.args))
        return f, p.column(f.label(), "string")
    if s.name == "has_id":
        values = [x for a in s.args for x in (a if isinstance(a, (list, tuple, set)) else (a,))]
        return f, F.coalesce(F.col("_id").isin(values), F.lit(False))
    if s.name == "is_":
        return f, as_predicate(s.args[0]).column(f.this(), dict(f.df.dtypes).get("_val", "bigint"))
    if s.name == "has_not":
        f = f.load()
        return f, f.value(s.args[0])[0].isNull()
    args = s.args
    label = None
    if len(args) == 3:
        label, *args = args
    f = f.load()
    col, kind = f.value(args[0])
    p = P.neq(None) if len(args) == 1 else as_predicate(args[1])
    if kind.startswith("array"):  # a LIST or SET key: some item
        item = kind.removeprefix("array<").removesuffix(">")
        c = F.coalesce(F.exists(col, lambda x: p.column(x["value"] if item.startswith("struct") else x, item)), F.lit(False)) if len(args) > 1 else col.isNotNull() & (F.size(col) > 0)
    else:
        c = p.column(col, kind)
    return f, c & (f.label() == label) if label else c


for _name in FILTERS:
    def _do(f: Frame, *args, _n=_name) -> Frame:
        f, c = _filter_column(f, Step(_n, args))
        narrowed = {}
        if _n == "has_label" and f.kind == "vertex" and not isinstance(args[0], P):
            narrowed = {"labels": tuple(x for x in (f.labels or f.graph.vertex_labels()) if x in args)}
        return f.with_df(f.df.where(c), **narrowed)

    STEPS[_name] = _do


@step
def has_key(f: Frame, *keys) -> Frame:
    return f.with_df(f.df.where(F.col("_key_name").isin(list(keys))))


@step
def has_value(f: Frame, *values) -> Frame:
    return f.with_df(f.df.where(F.col("_val").isin([str(v) for v in values])))


@step
def where(f: Frame, *args) -> Frame:
    """where(traversal), where(P of a binding or side effect), where(binding, P of a binding)."""
    if isinstance(args[0], Traversal):
        return exists(f, args[0], True)
    left = F.col(f"@{args[0]}") if len(args) == 2 else f.this()
    op, name = args[-1]
    if name in f.effects:
        other = f.effects[name]
        other = other.df.select(other.this().alias("_seen")).distinct()
        return f.with_df(f.df.join(other, left == F.col("_seen"), "left_anti" if op in ("without", "neq") else "left_semi"))
    right = F.col(f"@{name}")
    cond = {"eq": left == right, "neq": left != right, "lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right, "within": left == right, "without": left != right}[op]
    return f.with_df(f.df.where(F.coalesce(cond, F.lit(False))))


def ref(op: str, name: str) -> tuple[str, str]:
    """A comparison with a binding or side effect, for where()."""
    return op, name


@step
def filter_(f: Frame, what) -> Frame:
    return exists(f, what, True) if isinstance(what, Traversal) else f.with_df(f.df.where(F.coalesce(what(f.this()), F.lit(False))))


@step
def not_(f: Frame, t: Traversal) -> Frame:
    return exists(f, t, False)


@step
def and_(f: Frame, *ts: Traversal) -> Frame:
    return reduce(lambda g, t: exists(g, t, True), ts, f)


@step
def or_(f: Frame, *ts: Traversal) -> Frame:
    simple = condition(f, Traversal(None, (Step("or_", ts),)))
    if simple:
        return simple[0].with_df(simple[0].df.where(simple[1]))
    keys, frames = None, []
    for t in ts:
        c, keys = child(f, t)
        frames.append(c.df.select(*[o for _, o in keys]))
    return f.with_df(matches(f, reduce(DataFrame.unionByName, frames).distinct(), keys, "left_semi"))


@step
def simple_path(f: Frame) -> Frame:
    return f.with_df(f.df.where(F.size("_path") == F.size(F.array_distinct("_path"))))


@step
def cyclic_path(f: Frame) -> Frame:
    return f.with_df(f.df.where(F.size("_path") != F.size(F.array_distinct("_path"))))


@step
def coin(f: Frame, p: float, seed: int | None = None) -> Frame:
    return f.with_df(f.df.where(F.rand(seed) < p))


@step
def sample(f: Frame, n: int, seed: int = 0) -> Frame:
    """n traversers by a seeded hash of the object: the same ones each time."""
    return limit(f.with_df(f.df, order=(F.xxhash64(f.this(), F.lit(seed)), f.this())), n)


@step
def time_limit(f: Frame, ms: int) -> Frame:
    """No effect: results are always whole."""
    return f


# Projections


@step
def values(f: Frame, *keys) -> Frame:
    f = f.load()
    keys = keys or [c[2:] for c in f.props]
    cols = [(k, *f.value(k)) for k in keys]
    cols = [(k, c, t) for k, c, t in cols if t is not None]
    if len(cols) == 1:
        _, c, t = cols[0]
        if t.startswith("array<struct"):
            c = F.explode(F.transform(c, lambda x: x["value"]))
        elif t.startswith("array"):
            c = F.explode(c)
        df = f.df.select(*f.extras, c.alias("_val")).where(F.col("_val").isNotNull())
    else:
        items = F.concat(*[F.transform(c, lambda x: x.cast("string")) if t.startswith("array") else F.array(c.cast("string")) for _, c, t in cols])
        df = f.df.select(*f.extras, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("_val"))
    return f.walk(df, kind="value", labels=None, loaded=False)


@step
def properties(f: Frame, *keys) -> Frame:
    """Property elements; meta-properties, if a key's items are structs (value, ...), become the element's own properties."""
    f = f.load()
    parts = []
    for k in keys or [c[2:] for c in f.props]:
        c, t = f.value(k)
        head = [*f.extras, "_id", F.lit(k).alias("_key_name")]
        if t.startswith("array<struct"):
            d = f.df.select(*head, F.explode(c).alias("_s"))
            metas = [x for x in d.select("_s.*").columns if x != "value"]
            d = d.select(*f.extras, "_id", "_key_name", F.col("_s.value").cast("string").alias("_val"), *[F.col(f"_s.{m}").alias(f"m_{m}") for m in metas])
        elif t.startswith("array"):
            d = f.df.select(*head, F.explode(c).cast("string").alias("_val"))
        else:
            d = f.df.select(*head, c.cast("string").alias("_val"))
        parts.append(d.where(F.col("_val").isNotNull()))
    return f.walk(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), kind="property", labels=None, loaded=True)


def _entries(f: Frame, keys, lists: bool) -> Column:
    items = []
    for k in keys or [c[2:] for c in f.props]:
        c, t = f.value(k)
        if t.startswith("array<struct"):
            c = F.transform(c, lambda x: x["value"].cast("string"))
        elif t.startswith("array"):
            c = F.transform(c, lambda x: x.cast("string"))
        else:
            c = F.when(c.isNotNull(), F.array(c.cast("string")))
        items.append(F.struct(F.lit(k).alias("key"), (c if lists else F.element_at(c, -1)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*items), lambda e: e["value"].isNotNull()))


@step
def value_map(f: Frame, *keys, tokens: bool = False) -> Frame:
    """map key -> list of values (text); with tokens, also columns id and label."""
    f = f.load()
    more = [F.col("_id").alias("id"), f.label().alias("label")] if tokens else []
    return f.with_df(f.df.select(*f.extras, *more, _entries(f, keys, True).alias("value")), kind="map", order=())


STEPS["property_map"] = value_map


@step
def element_map(f: Frame, *keys) -> Frame:
    f = f.load()
    return f.with_df(f.df.select(*f.extras, F.col("_id").alias("id"), f.label().alias("label"), _entries(f, keys, False).alias("value")), kind="map", order=())


def _to_value(f: Frame, c: Column) -> Frame:
    return f.walk(f.df.select(*f.extras, c.alias("_val")), kind="value", labels=None, loaded=False)


@step
def label(f: Frame) -> Frame:
    return _to_value(f, f.label())


@step
def id_(f: Frame) -> Frame:
    return _to_value(f, F.col("_id"))


@step
def key(f: Frame) -> Frame:
    return _to_value(f, F.col("_key_name"))


@step
def value(f: Frame) -> Frame:
    return _to_value(f, F.col("_val"))


@step
def constant(f: Frame, v) -> Frame:
    return _to_value(f, F.lit(v))


@step
def map_(f: Frame, what) -> Frame:
    return attach(f, what) if isinstance(what, Traversal) else _to_value(f, what(f.this()))


@step
def flat_map(f: Frame, what) -> Frame:
    return run(f, what.steps) if isinstance(what, Traversal) else _to_value(f, F.explode(what(f.this())))


@step
def side_effect(f: Frame, what) -> Frame:
    return f


@step
def identity(f: Frame) -> Frame:
    return f


@step
def barrier(f: Frame, n: int = 0) -> Frame:
    return f


@step
def project(f: Frame, *names, by=()) -> Frame:
    cols = []
    for i, n in enumerate(names):
        f, c = scalar(f, by[i % len(by)][0] if by else None, f"p_~{n}")
        cols.append((n, c))
    return f.with_df(f.df.select(*f.extras, *[c.alias(n) for n, c in cols]), kind="map", order=())


@step
def as_(f: Frame, *names) -> Frame:
    return f.with_df(f.df.withColumns({f"@{n}": f.this() for n in names}), names=f.names | {n: (f.kind, f.labels) for n in names})


@step
def select(f: Frame, *names, by=()) -> Frame:
    if len(names) == 1 and not by:
        kind, labels = f.names[names[0]]
        col = F.col(f"@{names[0]}")
        if kind == "edge":
            e = _edge_columns(f.graph.edge_frame()).withColumn("_from", F.lit(None).cast("bigint"))
            return f.walk(f.df.select(*f.extras, col.alias("_at")).join(e, F.col("_at") == F.col("_id")).drop("_at"), kind="edge", labels=None, loaded=True)
        name = "_id" if kind == "vertex" else "_val"
        return f.walk(f.df.select(*f.extras, col.alias(name)), kind=kind, labels=labels, loaded=False)
    df = f.df
    for i, n in enumerate(names):
        what = by[i % len(by)][0] if by else None
        kind, labels = f.names[n]
        if what is None or kind != "vertex":
            df = df.withColumn(f"_s{i}", F.col(f"@{n}"))
            continue
        ids = Frame(f.graph, df.select(F.col(f"@{n}").alias("_id")).distinct(), "vertex", labels, options=f.options)
        ids, c = scalar(ids, what, "p_~by")
        df = df.join(ids.df.select(F.col("_id").alias("_sid"), c.alias(f"_s{i}")), F.col(f"@{n}") == F.col("_sid")).drop("_sid")
    return f.with_df(df.select(*f.extras, *[F.col(f"_s{i}").alias(n) for i, n in enumerate(names)]), kind="map", order=())


@step
def path(f: Frame, by=()) -> Frame:
    """The objects passed, as text; by(key): the vertices' property instead of their ids."""
    d = f.df.select(*f.origins, F.col("_path").alias("path"))
    if by:
        spots = d.select("path").distinct().select("path", F.posexplode("path").alias("nth", "spot"))
        v = Frame(f.graph, spots.select(F.expr("try_cast(spot as bigint)").alias("_id")).where("_id is not null").distinct(), "vertex", f.graph.vertex_labels(), options=f.options)
        v, c = scalar(v, by[0][0], "p_~path")
        named = spots.join(v.df.select(F.col("_id").cast("string").alias("spot"), c.cast("string").alias("name")), "spot", "left")
        named = named.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("name", "spot").alias("name")))), lambda x: x["name"]).alias("named"))
        d = d.join(named, "path").select(*f.origins, F.col("named").alias("path"))
    return f.with_df(d, kind="map", order=())


@step
def tree(f: Frame) -> Frame:
    """(depth, path, parent): the distinct prefixes of all paths, each a node of the tree."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda i: F.slice("_path", F.lit(1), i))).alias("path")
    d = f.df.select(*f.origins, prefixes).distinct()
    return f.with_df(d.select(*f.origins, F.size("path").alias("depth"), "path", F.try_element_at("path", F.lit(-2)).alias("parent")), kind="map", order=())


@step
def subgraph(f: Frame) -> Frame:
    """The distinct edges passed."""
    return f.with_df(f.df.drop("_from", *f.extras).distinct().withColumn("_from", F.lit(None).cast("bigint")), names={}, order=())


@step
def math_(f: Frame, text: str, by=()) -> Frame:
    """Arithmetic on the current value (_) and bindings, e.g. '_ * 2 + a'."""
    known = {"_": "_val", **{n: f"@{n}" for n in f.names}}
    sql = re.sub(r"[A-Za-z_]\w*", lambda m: f"CAST(`{known[m[0]]}` AS DOUBLE)" if m[0] in known else m[0], text)
    return _to_value(f, F.expr(sql))


@step
def sack(f: Frame, op=None, by=()) -> Frame:
    """Without an operator: the sack's value. With one (a function of sack and value): the sack changed."""
    if op is None:
        return _to_value(f, F.col("_sack"))
    f, c = scalar(f, by[0][0] if by else None, "p_~sack")
    return f.with_df(f.df.withColumn("_sack", op(F.col("_sack"), c)))


@step
def loops(f: Frame) -> Frame:
    return _to_value(f, F.col("_loops"))


@step
def unfold(f: Frame) -> Frame:
    kind = dict(f.df.dtypes).get("_val", "")
    return _to_value(f, F.explode("_val") if kind.startswith("array") else F.col("_val"))


# Branches


@step
def union(f: Frame, *ts: Traversal) -> Frame:
    return unite([run(f, optimize(t.steps)) for t in ts])


@step
def coalesce(f: Frame, *ts: Traversal) -> Frame:
    parts, rest = [], f
    for i, t in enumerate(ts):
        parts.append(attach(rest, t))
        if i + 1 < len(ts):
            rest = exists(rest, t, False)
    return unite(parts)


@step
def optional(f: Frame, t: Traversal) -> Frame:
    return unite([attach(f, t), exists(f, t, False)])


@step
def choose(f: Frame, cond, yes: Traversal | None = None, no: Traversal | None = None, options=()) -> Frame:
    """choose(condition, yes[, no]), or choose(key or traversal).option(value, branch)."""
    if options:
        f, c = scalar(f, cond, "p_~choice")
        return unite([run(f.with_df(f.df.where(F.coalesce(c == v, F.lit(False)))), b.steps) for v, b in options])
    test = cond if isinstance(cond, Traversal) else Traversal(None, (Step("is_", (cond,)),))
    return unite([run(exists(f, test, True), yes.steps), run(exists(f, test, False), (no or Traversal()).steps)])


@step
def local(f: Frame, t: Traversal) -> Frame:
    if not any(s.name in LOCAL for s in t.steps):
        return run(f, t.steps)
    return _first_by_hub(f, t) or attach(f, t)


def _first_by_hub(f: Frame, t: Traversal) -> Frame | None:
    """A child of the form: hops and filters, a last hop, filters and where(neq, binding), order by keys, limit n. What the last hop finds depends only on the vertex that it leaves (the hub), so
    candidates are ranked once per hub, not once per traverser that comes through it: each neq takes away one object, so besides the first n there need be n more for each (an object's parallel
    edges beyond n never count). None: the child has another form."""
    steps, hops = optimize(t.steps), ("out", "in_", "both")
    last = max((i for i, s in enumerate(steps) if s.name in hops), default=0)
    head, hop, tail = steps[:last], steps[last], steps[last + 1 :]
    if not any(s.name in hops for s in head) or [s.name for s in tail[-2:]] != ["order", "limit"] or tail[-1].args[0] < 1 or f.kind != "vertex":
        return None
    plain = [s for s in tail[:-2] if s.name in FILTERS]
    apart = [s for s in tail[:-2] if s.name == "where" and len(s.args) == 1 and isinstance(s.args[0], tuple) and s.args[0][0] == "neq" and s.args[0][1] not in f.effects and f.names.get(s.args[0][1], ("",))[0] == "vertex"]
    keys = [what for what, _ in tail[-2].kwargs.get("by", ())]
    if len(plain) + len(apart) < len(tail) - 2 or not all(s.name in FILTERS or s.name in hops for s in head) or not all(k is None or isinstance(k, str) for k in keys):
        return None
    c, pairs = child(f, Traversal(None, head))
    hubs = c.df.select("_id").distinct().withColumn("_hub", F.col("_id"))
    g = run(Frame(f.graph, hubs, "vertex", c.labels, origins=("_hub",), starts=hubs.select("_hub"), options=f.options), (hop, *plain, tail[-2]))
    n, found = tail[-1].args[0], g.df
    if apart:
        found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("_hub", "_id").orderBy("_id"))).where(F.col("_nth") <= n)
    found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("_hub").orderBy(*g.order))).where(F.col("_nth") <= n * (1 + len(apart))).drop("_nth")
    joined = c.df.select(*c.extras, F.col("_id").alias("_at")).join(found, F.col("_at") == F.col("_hub")).drop("_at", "_hub")
    c = replace(c, df=joined, kind=g.kind, labels=g.labels, loaded=g.loaded, order=g.order)
    return _moved(f, run(c, (*apart, tail[-1])), pairs)


@step
def repeat(f: Frame, body: Traversal, times=None, until=None, until_first=False, emit=None, emit_first=False, most: int | None = None) -> Frame:
    """Loops run on the driver over lazy frames. With a number of times the plan is simply unrolled; else each frontier is written and the loop ends when it is empty.
    On a graph with cycles it may never be: `most` loops then end in an error, not in a part of the result."""
    out: list[Frame] = []

    def slim(g: Frame) -> Frame:
        return g.with_df(g.df.select(*g.extras, "_id"), loaded=False) if g.kind == "vertex" else g

    def split(g: Frame, cond, keep_rest: bool) -> Frame:
        out.append(slim(exists(g, cond, True)))
        return exists(g, cond, False) if keep_rest else g

    if until is not None and until_first:
        f = split(f, until, True)
    for i in itertools.count(1):
        if most is not None and i > most:
            raise RuntimeError(f"traversers are left after {most} loops")
        if times == 0:
            out.append(slim(f))
            break
        if emit and emit_first:
            out.append(slim(f if emit is True else exists(f, emit, True)))
        f = run(f, optimize(body.steps))
        f = slim(f.with_df(f.df.withColumn("_loops", F.lit(i))))
        if i == times:
            out.append(f)
            break
        if until is None and times is None and not emit:
            raise ValueError("repeat needs times, until or emit")
        if until is not None:
            f = split(f, until, True)
        if emit and not emit_first:
            out.append(slim(f if emit is True else exists(f, emit, True)))
        if times is None:
            f = f.with_df(materialize(f.df, "frontier"))
            if f.df.isEmpty():
                break
    return unite([slim(x) for x in out]) if out else f


def _first_edges(graph: PropertyGraph, body, labels) -> list[DataFrame]:
    """The edges that the first step of a body reads."""
    name = body[0].name.rstrip("_") if body else ""
    if name not in ("out", "in", "both", "out_e", "in_e", "both_e"):
        return []
    ends = ([(labels, None)] if name[:2] != "in" else []) + ([(None, labels)] if name[:3] != "out" else [])
    return [t.df for o, i in ends for _, t in graph.edge_tables(body[0].args, o, i)]


@step
def match(f: Frame, *patterns: Traversal) -> Frame:
    """Patterns as_(a). ... .as_(b), joined on their variables; the current object is the first pattern's first variable."""
    first = patterns[0].steps[0].args[0]
    f = as_(f, first)
    todo = list(patterns)
    while todo:
        p = next((p for p in todo if p.steps[0].args[0] in f.names), None)
        if p is None:
            raise ValueError("match: patterns aren't connected")
        todo.remove(p)
        a, body = p.steps[0].args[0], p.steps[1:]
        b = body[-1].args[0] if body and body[-1].name == "as_" else None
        body = body[:-1] if b else body
        kind, labels = f.names[a]
        seeds = f.df.select(F.col(f"@{a}").alias("_id")).distinct()
        # Where the input asks for more partitions than the session has: the body and the join follow the seeds' number, as Spark takes the larger of two sides.
        n = share(f.df, *_first_edges(f.graph, body, labels))
        more = n > int(f.graph.spark.conf.get("spark.sql.shuffle.partitions"))
        seeds = (seeds.repartition(n, "_id") if more else seeds).withColumn("_o0_0", F.col("_id"))
        g = run(Frame(f.graph, seeds, kind, labels, origins=("_o0_0",), starts=seeds.select("_o0_0"), options=f.options), body)
        if b is None:
            f = f.with_df(f.df.join(g.df.select("_o0_0").distinct(), F.col(f"@{a}") == F.col("_o0_0"), "left_semi"))
            continue
        found = g.df.select("_o0_0", g.this().alias("_end"))
        on = F.col(f"@{a}") == F.col("_o0_0")
        if b in f.names:
            found = found.repartition(n, "_o0_0", "_end") if more else found
            f = f.with_df(f.df.join(found, on & (F.col(f"@{b}") == F.col("_end"))).drop("_o0_0", "_end"))
        else:
            f = f.with_df(f.df.join(found, on).withColumnRenamed("_end", f"@{b}").drop("_o0_0"), names=f.names | {b: (g.kind, g.labels)})
    return f


# Reductions


def _reduce(f: Frame, agg: Column, empty=None) -> Frame:
    """Global, or per origin of the innermost local scope."""
    if f.origins:
        d = f.df.groupBy(*f.origins).agg(agg.alias("_val"))
        if empty is not None and f.starts is not None:
            s = f.starts.distinct()
            d = s.join(d, [*f.origins], "left").withColumn("_val", F.coalesce("_val", empty))
    else:
        d = f.df.agg(agg.alias("_val"))
    if empty is None:
        d = d.where(F.col("_val").isNotNull())
    return f.with_df(d, kind="value", labels=None, loaded=False, order=(), names={} if not f.origins else f.names)


@step
def count(f: Frame) -> Frame:
    return _reduce(f, F.count("*"), F.lit(0).cast("bigint"))


@step
def sum_(f: Frame) -> Frame:
    return _reduce(f, F.sum("_val"))


@step
def min_(f: Frame) -> Frame:
    return _reduce(f, F.min("_val"))


@step
def max_(f: Frame) -> Frame:
    return _reduce(f, F.max("_val"))


@step
def mean(f: Frame) -> Frame:
    return _reduce(f, F.avg("_val"))


@step
def fold(f: Frame) -> Frame:
    """One list, sorted so that it is the same each time."""
    kind = dict(f.df.dtypes)["_val" if f.kind in ("value", "property") else "_id"]
    return _reduce(f, F.sort_array(F.collect_list(f.this())), F.array().cast(f"array<{kind}>"))


@step
def group(f: Frame, by=()) -> Frame:
    """(key, value): by(key) then by(reducing traversal); without the second, the objects as a list."""
    f, k = scalar(f, by[0][0] if by else None, "p_~group")
    g = f.with_df(f.df.withColumn("_key", k).where(F.col("_key").isNotNull()), origins=(*f.origins, "_key"), starts=None)
    then = by[1][0] if len(by) > 1 else Traversal(None, (Step("fold"),))
    if isinstance(then, str):
        then = Traversal(None, (Step("values", (then,)), Step("fold")))
    r = run(g, optimize(then.steps))
    if not any(s.name in REDUCERS for s in then.steps):
        r = fold(r)
    return f.with_df(r.df.select(*f.origins, F.col("_key").alias("key"), F.col("_val").alias("value")), kind="map", order=())


@step
def group_count(f: Frame, by=()) -> Frame:
    return group(f, by=(*(by or ((None, "asc"),)), (Traversal(None, (Step("count"),)), "asc")))


@step
def dedup(f: Frame, *names, by=()) -> Frame:
    if names:
        return f.with_df(f.df.dropDuplicates([*f.origins, *[f"@{n}" for n in names]]))
    if by:
        f, c = scalar(f, by[0][0], "p_~dedup")
        nth = F.row_number().over(Window.partitionBy(*f.origins, "_by").orderBy(f.this()))
        return f.with_df(f.df.withColumn("_by", c).withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_by"))
    return f.with_df(f.df.dropDuplicates(list(dict.fromkeys([*f.origins, *f.identity]))))


@step
def aggregate(f: Frame, name: str, by=()) -> Frame:
    kept = f
    if by:
        kept, c = scalar(f, by[0][0], "p_~agg")
        kept = _to_value(kept, c)
    return f.with_df(f.df, effects=f.effects | {name: kept})


STEPS["store"] = aggregate


@step
def cap(f: Frame, name: str) -> Frame:
    return fold(f.effects[name])


# Order and range


@step
def order(f: Frame, by=()) -> Frame:
    """Missing values come last either way; ties are settled by the object."""
    cols = []
    for i, (what, way) in enumerate(by or ((None, "asc"),)):
        f, c = scalar(f, what, f"p_~order{i}")
        cols.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
    return f.with_df(f.df, order=(*cols, f.this().asc_nulls_last()))


@step
def range_(f: Frame, low: int, high: int) -> Frame:
    """[low, high); high -1: to the end."""
    if high != -1 and high <= low:
        return f.with_df(f.df.limit(0))
    by = f.order or ((f.this(),) if f.kind != "map" else ())
    if f.origins:
        nth = F.row_number().over(Window.partitionBy(*f.origins).orderBy(*by))
        d = f.df.withColumn("_nth", nth).where((F.col("_nth") > low) & (F.lit(high == -1) | (F.col("_nth") <= high))).drop("_nth")
        return f.with_df(d)
    d = f.df.orderBy(*by) if by else f.df
    if high == -1:
        return f.with_df(d.offset(low))
    return f.with_df(d.offset(low).limit(high - low) if low else d.limit(high))


@step
def limit(f: Frame, n: int) -> Frame:
    return range_(f, 0, n)


@step
def skip(f: Frame, n: int) -> Frame:
    return range_(f, n, -1)


@step
def tail(f: Frame, n: int = 1) -> Frame:
    """The last n, in reverse of the order."""
    by = f.order or (f.this().asc(),)
    nth = F.row_number().over(Window.partitionBy(*f.origins).orderBy(*by)) if f.origins else None
    if nth is not None:
        total = F.count("*").over(Window.partitionBy(*f.origins))
        return f.with_df(f.df.withColumn("_nth", nth).withColumn("_all", total).where(F.col("_nth") > F.col("_all") - n).drop("_nth", "_all"))
    total = f.df.count()
    return range_(f, max(0, total - n), -1)
