"""A property graph as DataFrames: one table per vertex label (`id`, properties) and per edge label (`eid`, `src`, `dst`, properties).

Ids are bigints with the label's number in the top byte, so joins hash longs and an id tells its label. Edges are stored once; the in-direction is a
join on dst. A property is absent where its column is null; LIST and SET properties are arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import ship
from graphloom.schema import EdgeLabel, GraphSchema, PropertyKey, VertexLabel

SHIFT = 56
RESERVED = ("id", "eid", "src", "dst")


def make_id(number: int, key: Column) -> Column:
    """Id of the vertex with whole-number key (0 <= key < 2^56) under the label with this number."""
    return key.cast("bigint") + F.lit(number << SHIFT)


def make_string_id(number: int, key: Column) -> Column:
    """Id from a text key, by its hash; for keys without a number."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << SHIFT) - 1)) + F.lit(number << SHIFT)


def _entry(key: str):
    return lambda v: F.struct(F.lit(key).alias("key"), v.alias("value"))


class Tables(dict):
    """label -> DataFrame, or a function that makes it when it is first asked for: a query opens only the tables it needs."""

    def __getitem__(self, label: str) -> DataFrame:
        got = super().__getitem__(label)
        if callable(got):
            got = got()
            self[label] = got
        return got

    def items(self):
        return [(x, self[x]) for x in self]

    def values(self):
        return [self[x] for x in self]

    def get(self, label, default=None):
        return self[label] if label in self else default

    def copy(self) -> Tables:
        return Tables(super().items())


class EdgeTable:
    """df: a DataFrame or a function that makes it."""

    def __init__(self, df, out_label: str, in_label: str) -> None:
        self._df, self.out_label, self.in_label = df, out_label, in_label

    @property
    def df(self) -> DataFrame:
        if callable(self._df):
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, df) -> None:
        self._df = df


@dataclass
class PropertyGraph:
    spark: SparkSession
    vertices: Tables = field(default_factory=dict)
    edges: dict[str, list[EdgeTable]] = field(default_factory=dict)
    schema: GraphSchema = field(default_factory=GraphSchema)
    variables: dict[str, object] = field(default_factory=dict)
    #: label -> number in the ids
    numbers: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)
        self._before: PropertyGraph | None = None
        self.vertices = self.vertices if isinstance(self.vertices, Tables) else Tables(self.vertices)

    def number(self, label: str) -> int:
        return self.numbers.setdefault(label, len(self.numbers) + 1)

    def add_vertices(self, label: str, df: DataFrame, key: str, string_key: bool = False) -> PropertyGraph:
        """df's columns become properties; `key` makes the id. df may be a function that makes the DataFrame once it is needed."""
        make, number = make_string_id if string_key else make_id, self.number(label)
        if callable(df):
            self.vertices[label] = lambda: df().withColumn("id", make(number, F.col(key)))
            self.schema.vertex_labels[label] = VertexLabel(label)
            return self
        self.vertices[label] = df.withColumn("id", make(number, F.col(key)))
        self._learn(label, df)
        return self

    def add_edges(self, label: str, df: DataFrame, out_label: str, out_key: Column, in_label: str, in_key: Column, eid: Column, out_string: bool = False, in_string: bool = False, multiplicity: str = "MULTI") -> PropertyGraph:
        """df's columns are kept as properties, as they are; src, dst and eid come from the given expressions."""
        out_id = (make_string_id if out_string else make_id)(self.number(out_label), out_key)
        in_id = (make_string_id if in_string else make_id)(self.number(in_label), in_key)
        ids = {"src": out_id, "dst": in_id, "eid": eid}
        table = (lambda: df().withColumns(ids)) if callable(df) else df.withColumns(ids)
        self.edges.setdefault(label, []).append(EdgeTable(table, out_label, in_label))
        have = self.schema.edge_labels.get(label)
        ends = (have.connections if have else ()) + ((out_label, in_label),)
        self.schema.edge_labels[label] = EdgeLabel(label, multiplicity, ends, () if callable(df) else tuple(df.columns))
        for c, t in [] if callable(df) else df.dtypes:
            self.schema.keys.setdefault(c, PropertyKey(c, t))
        return self

    def _learn(self, label: str, df: DataFrame) -> None:
        self.schema.vertex_labels[label] = VertexLabel(label, tuple(c for c in df.columns if c not in RESERVED))
        for c, t in df.dtypes:
            if c not in RESERVED:
                self.schema.keys.setdefault(c, PropertyKey(c, t.removeprefix("array<").removesuffix(">"), "LIST" if t.startswith("array") else "SINGLE"))

    # Scans ----------------------------------------------------------------------------------------------------------

    def vertex_labels(self) -> tuple[str, ...]:
        return tuple(self.vertices)

    def vertex_frame(self, labels=None) -> DataFrame:
        """(id, label, properties...) of these labels; a label's table is only read if it is asked for."""
        chosen = [self.vertices[x].withColumn("label", F.lit(x)) for x in self.vertices if labels is None or x in labels]
        if not chosen:
            return self.spark.createDataFrame([], "id bigint, label string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)

    def edge_tables(self, labels=None, out_labels=None, in_labels=None) -> list[tuple[str, EdgeTable]]:
        """Edge tables of these labels that can start (end) at a vertex of the given labels."""
        return [(x, t) for x, ts in self.edges.items() for t in ts if (not labels or x in labels) and (out_labels is None or t.out_label in out_labels) and (in_labels is None or t.in_label in in_labels)]

    def edge_frame(self, labels=None, out_labels=None, in_labels=None) -> DataFrame:
        chosen = [t.df.withColumn("label", F.lit(x)) for x, t in self.edge_tables(labels, out_labels, in_labels)]
        if not chosen:
            return self.spark.createDataFrame([], "eid string, src bigint, dst bigint, label string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)

    def property_frame(self, labels=None, keys=None) -> DataFrame:
        """(id, label, key, value: string): every vertex property as an element; arrays give a row per item."""
        parts = []
        for x in self.vertices:
            if labels is not None and x not in labels:
                continue
            df, items = self.vertices[x], []
            for c, t in df.dtypes:
                if c in RESERVED or (keys and c not in keys):
                    continue
                values = F.transform(F.col(c), lambda v: v.cast("string")) if t.startswith("array") else F.array(F.col(c).cast("string"))
                items.append(F.transform(F.filter(F.coalesce(values, F.array()), lambda v: v.isNotNull()), _entry(c)))
            if items:
                parts.append(df.select("id", F.lit(x).alias("label"), F.explode(F.concat(*items)).alias("p")).select("id", "label", "p.key", "p.value"))
        if not parts:
            return self.spark.createDataFrame([], "id bigint, label string, key string, value string")
        return reduce(DataFrame.unionByName, parts)

    # Entry points ---------------------------------------------------------------------------------------------------

    def traversal(self):
        from graphloom.plans.traversal import Source

        return Source(self)

    def query(self):
        from graphloom.operators.query import GraphQuery

        return GraphQuery(self)

    def multi_query(self, seeds: DataFrame):
        from graphloom.operators.query import VertexQuery

        return VertexQuery(self, seeds)

    def index_query(self, index: str, text: str):
        from graphloom.operators.fulltext import IndexQuery

        return IndexQuery(self, index, text)

    def with_changes(self, **changes) -> PropertyGraph:
        from graphloom.operators.mutate import with_changes

        return with_changes(self, **changes)

    def begin(self, changed: PropertyGraph) -> None:
        """This object shows `changed` until rollback() or commit(): a transaction's own view. Changes on top of changes share one rollback."""
        self._before = self._before or self.copy()
        self.vertices, self.edges, self.schema, self.variables, self.numbers = changed.vertices, changed.edges, changed.schema, changed.variables, changed.numbers

    def rollback(self) -> None:
        if self._before:
            old, self._before = self._before, None
            self.vertices, self.edges, self.schema, self.variables, self.numbers = old.vertices, old.edges, old.schema, old.variables, old.numbers

    def commit(self) -> None:
        self._before = None

    def features(self) -> dict[str, bool]:
        """What graphs of this kind can do, by the usual names."""
        return {"computer": True, "transactions": True, "persistence": True, "threaded_transactions": False, "variables": True, "user_supplied_ids": True, "string_ids": False, "meta_properties": True, "multi_properties": True, "null_property_values": False, "duplicate_multi_properties": True, "upsert": False}

    def copy(self) -> PropertyGraph:
        import copy

        return PropertyGraph(self.spark, self.vertices.copy(), {k: list(v) for k, v in self.edges.items()}, copy.deepcopy(self.schema), dict(self.variables), dict(self.numbers))
