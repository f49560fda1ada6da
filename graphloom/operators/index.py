"""Indexes as tables: built, looked up, aggregated, checked against their base, selected for a query, and taken through their states.

A composite index is a table (keys, id) and a vertex-centric one (src, keys, id, dst), dealt by ranges and sorted, so a lookup prunes files and row groups by their min and max. A mixed index has a
table of its keys' values by id, which range predicates and aggregates read, and for text keys postings (field, term, id, tf, positions) in segments, each sorted by field and term,
of which a query reads its terms only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.predicates import P, as_predicate
from graphloom.functions.text import tokens
from graphloom.graph import PropertyGraph
from graphloom.lineage import new_path, remove
from graphloom.schema import Index

#: The states that each action may follow.
ACTIONS = {
    "REGISTER_INDEX": ("INSTALLED", "DISABLED"),
    "REINDEX": ("REGISTERED", "ENABLED", "DISABLED", "WRITE_ONLY_ENABLED"),
    "REMOVE_STALE_ENTRIES": ("REGISTERED", "ENABLED", "DISABLED", "WRITE_ONLY_ENABLED"),
    "ENABLE_WRITE_ONLY": ("REGISTERED", "ENABLED", "WRITE_ONLY_ENABLED"),
    "ENABLE_INDEX": ("REGISTERED", "DISABLED", "ENABLED", "WRITE_ONLY_ENABLED"),
    "DISABLE_INDEX": ("ENABLED", "DISABLED", "REGISTERED", "WRITE_ONLY_ENABLED", "INSTALLED"),
    "DISCARD_INDEX": ("DISABLED", "REGISTERED", "DISCARDED", "WRITE_ONLY_ENABLED"),
    "DROP_INDEX": ("DISCARDED",),
    "MARK_DISCARDED": ("DISABLED", "REGISTERED", "DISCARDED", "WRITE_ONLY_ENABLED"),
}
#: The state that an action leads to; REINDEX leads to ENABLED unless writes alone were enabled, REMOVE_STALE_ENTRIES changes none, DROP_INDEX leaves none.
LEADS_TO = {"REGISTER_INDEX": "REGISTERED", "ENABLE_WRITE_ONLY": "WRITE_ONLY_ENABLED", "ENABLE_INDEX": "ENABLED", "DISABLE_INDEX": "DISABLED", "DISCARD_INDEX": "DISCARDED", "MARK_DISCARDED": "DISCARDED"}
#: Indexes in these states follow changes of the graph.
FOLLOWING = ("INSTALLED", "REGISTERED", "ENABLED", "WRITE_ONLY_ENABLED")

#: Analyzers of text keys: a value's terms in order. A function of Column may stand for either.
ANALYZERS: dict[str, Callable[[Column], Column]] = {"text": tokens, "string": lambda c: F.array(c)}


def counted(terms: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """[(term, tf, positions)] of an array of terms (those that `keep` says): sorted with their places, and cut where the term changes."""

    def cut(s: Column) -> Column:
        return _let(F.filter(F.transform(s, lambda x, j: j), lambda b: (b == 0) | (F.get(s, b)["term"] != F.get(s, b - 1)["term"])), lambda starts: F.transform(starts, lambda b, j: run(s, b, F.coalesce(F.get(starts, j + 1), F.size(s)))))

    def run(s: Column, b: Column, end: Column) -> Column:
        at = F.transform(F.slice(s, b + 1, end - b), lambda x: x["at"])
        return F.struct(F.get(s, b)["term"].alias("term"), (end - b).alias("tf"), at.alias("positions"))

    items = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return _let(F.sort_array(F.filter(items, lambda x: F.coalesce(keep(x["term"]), F.lit(False)) if keep else x["term"].isNotNull())), cut)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value made once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(post: DataFrame, base: DataFrame) -> DataFrame:
    """Postings with one row per field, term and id, where rows of the base share an id."""
    if base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return post
    return post.groupBy("field", "term", "id").agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


@dataclass
class IndexCatalog:
    """Indexes of a graph and the paths of their tables, by kind of table."""

    graph: PropertyGraph
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    analyzers: dict[str, dict[str, Callable[[Column], Column]]] = field(default_factory=dict)

    def build_index(self, name: str, kind: str, keys: tuple[str, ...], label: str | None = None, unique: bool = False, analyzers: dict | None = None, inline: tuple[str, ...] = ()) -> Index:
        """inline: properties that a composite index holds beside its keys. analyzers: for text keys of a mixed index, "text" (the default), "string" (the whole value is one term) or a function of Column."""
        if name in self.graph.schema.indexes:
            raise ValueError(f"index exists: {name}")
        if kind not in ("composite", "mixed", "vertex_centric"):
            raise ValueError(f"no such kind of index: {kind}")
        self.graph.schema.indexes[name] = Index(name, kind, tuple(keys), label, unique, inline=tuple(inline))
        self.analyzers[name] = {k: ANALYZERS[a] if isinstance(a, str) else a for k, a in (analyzers or {}).items()}
        return self.graph.schema.indexes[name]

    def enabled(self, name: str, kind: str, keys: tuple[str, ...], label: str | None = None, **more) -> IndexCatalog:
        """Build, register and fill an index: it answers from now on."""
        self.build_index(name, kind, keys, label, **more)
        self.update_index(name, "REGISTER_INDEX")
        self.update_index(name, "REINDEX")
        return self

    # Tables ---------------------------------------------------------------------------------------------------------

    def _elements(self, name: str) -> DataFrame:
        """The elements that the index is over, their id as `id`."""
        i = self.graph.schema.indexes[name]
        if i.kind == "vertex_centric" or i.label in self.graph.edges:
            return self.graph.edge_frame([i.label]).withColumn("id", F.col("eid").cast("string"))
        return self.graph.vertex_frame([i.label] if i.label else None)

    def base(self, name: str) -> DataFrame:
        """What the index's table would hold if it were written now."""
        i = self.graph.schema.indexes[name]
        d = self._elements(name)
        if i.kind == "vertex_centric":
            return d.select("src", *i.keys, "id", "dst")
        return d.select(*i.keys, *i.inline, "id").dropna(subset=list(i.keys), how="any" if i.kind == "composite" else "all")

    def postings(self, name: str, base: DataFrame | None = None) -> DataFrame:
        """(field, term, id, tf, positions) of a mixed index's text keys. Terms are counted within their row: nothing is shuffled, unless an id stands in several rows."""
        base = self.base(name) if base is None else base
        parts = [base.select(F.lit(k).alias("field"), "id", F.explode(counted(cut(F.col(k)))).alias("p")) for k, cut in self.text_keys(name, base).items()]
        if not parts:
            return self.graph.spark.createDataFrame([], f"field string, term string, id {dict(base.dtypes)['id']}, tf int, positions array<int>")
        return once(reduce(DataFrame.unionByName, parts).select("field", "p.term", "id", "p.tf", "p.positions"), base)

    def text_keys(self, name: str, base: DataFrame) -> dict[str, Callable[[Column], Column]]:
        """Text keys of an index, each with what cuts its terms."""
        keys = self.graph.schema.indexes[name].keys
        return {k: self.analyzers.get(name, {}).get(k, tokens) for k, t in base.dtypes if k in keys and t == "string"}

    def lengths(self, name: str) -> DataFrame:
        """(field, id, len) of a mixed index: how many terms each value has. Written when a ranked query first asks."""
        if "lengths" not in self.tables[name]:
            post = self.table(name, "postings").groupBy("field", "id").agg(F.sum("tf").alias("len"))
            self.tables[name]["lengths"] = path = new_path(self.graph.spark, f"index-{name}")
            post.write.parquet(path)
        return self.table(name, "lengths")

    def _write(self, name: str, rows: DataFrame) -> None:
        i = self.graph.schema.indexes[name]
        by = {"vertex_centric": ["src", *i.keys], "composite": list(i.keys), "mixed": ["id"]}[i.kind]
        new = {"values": self._put(name, rows, by)}
        if i.kind == "mixed":
            terms = self.postings(name, self.graph.spark.read.schema(rows.schema).parquet(new["values"]))
            new["postings"] = self._put(name, terms, ["field", "term", "id"], segments=True)
        old, self.tables[name] = self.tables.get(name, {}), new
        self._forget(old)

    def _put(self, name: str, rows: DataFrame, by: list[str], segments: bool = False) -> str:
        """segments: each task's rows are sorted where they are, not dealt by ranges first; a reader then skips within each file what it doesn't ask for."""
        path = new_path(self.graph.spark, f"index-{name}")
        (rows if segments else rows.repartitionByRange(*by)).sortWithinPartitions(*by).write.parquet(path)
        return path

    def _forget(self, paths: dict[str, str]) -> None:
        for p in paths.values():
            remove(self.graph.spark, p)

    def table(self, name: str, what: str = "values") -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"index has no entries yet: {name}")
        return self.graph.spark.read.parquet(self.tables[name][what])

    # States ---------------------------------------------------------------------------------------------------------

    def update_index(self, name: str, action: str) -> str | None:
        """Take an action; returns the new state, None after DROP_INDEX."""
        i = self.graph.schema.indexes[name]
        if i.status not in ACTIONS[action]:
            raise ValueError(f"{action} isn't possible in state {i.status}")
        if action == "REINDEX":  # restores what is missing, removes nothing
            base = self.base(name)
            self._write(name, self.table(name).unionByName(self.missing_entries(name)) if name in self.tables else base)
            i.status = i.status if i.status == "WRITE_ONLY_ENABLED" else "ENABLED"
        elif action == "REMOVE_STALE_ENTRIES":  # of elements that are gone; adds nothing
            if i.kind == "vertex_centric":
                raise ValueError("only indexes of the whole graph have stale entries removed")
            if name in self.tables:
                self._write(name, self.table(name).join(self._elements(name).select("id"), "id", "left_semi").select(*self.table(name).columns))
        elif action == "DROP_INDEX":
            del self.graph.schema.indexes[name]
            self._forget(self.tables.pop(name, {}))
            return None
        else:
            if action in ("DISCARD_INDEX", "MARK_DISCARDED"):
                self._forget(self.tables.pop(name, {}))
            i.status = LEADS_TO[action]
        return i.status

    def follow(self, graph: PropertyGraph) -> IndexCatalog:
        """The same indexes over a new version of the graph: those in a state that receives changes are brought up to date, the others keep their entries as they are."""
        graph.schema.indexes = self.graph.schema.indexes
        self.graph = graph
        for name, i in graph.schema.indexes.items():
            if i.status in FOLLOWING and name in self.tables:
                self._write(name, self.base(name))
        return self

    def _answering(self, name: str) -> Index:
        i = self.graph.schema.indexes[name]
        if i.status != "ENABLED":
            raise ValueError(f"index {name} is {i.status}")
        return i

    # Queries --------------------------------------------------------------------------------------------------------

    def lookup(self, name: str, *values) -> DataFrame:
        """Ids, and what the index holds inline, by equality on all keys of a composite index; only an enabled index answers."""
        i = self._answering(name)
        if len(values) != len(i.keys):
            raise ValueError("a composite index needs a value for each key")
        d = self.table(name)
        for k, v in zip(i.keys, values, strict=True):
            d = d.where(F.col(k) == F.lit(v))
        return d.select("id", *i.inline)

    def incident(self, name: str, seeds: DataFrame | list[int], *prefix, interval: tuple | None = None, order: str = "asc", limit: int | None = None) -> DataFrame:
        """(src, keys, id, dst) of a vertex-centric index: edges of the seeds (a list of ids, or a DataFrame with a column id) whose first keys equal `prefix` and whose next key is in
        [low, high) of `interval` (None: open), per vertex in the index's order, at most `limit` each."""
        i = self._answering(name)
        if len(prefix) + (interval is not None) > len(i.keys):
            raise ValueError("the index has fewer keys")
        d = self.table(name)
        if isinstance(seeds, DataFrame):
            d = d.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
        else:
            d = d.where(F.col("src").isin(list(seeds)))
        for k, v in zip(i.keys, prefix, strict=False):
            d = d.where(F.col(k) == F.lit(v))
        if interval:
            k, (low, high) = F.col(i.keys[len(prefix)]), interval
            d = d.where(k >= F.lit(low)) if low is not None else d
            d = d.where(k < F.lit(high)) if high is not None else d
        if limit is None:
            return d
        by = [F.col(k).desc_nulls_last() if order == "desc" else F.col(k).asc_nulls_last() for k in i.keys[len(prefix) :]]
        nth = F.row_number().over(Window.partitionBy("src").orderBy(*by, "id"))
        return d.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")

    def query(self, name: str, *conditions: tuple[str, object]) -> DataFrame:
        """Ids by conditions (key, value or P) on keys of a mixed index, all of which must hold. (key, Words("a b")) asks the postings for all these terms; everything else reads the values' columns."""
        i = self._answering(name)
        if unknown := [k for k, _ in conditions if k not in i.keys]:
            raise ValueError(f"not in the index: {unknown}")
        d = self.table(name)
        kinds = dict(d.dtypes)
        for k, p in conditions:
            if not isinstance(p, Words):
                d = d.where(as_predicate(p).column(F.col(k), kinds[k]))
        d = d.select("id")
        for k, p in conditions:
            if isinstance(p, Words):
                for term in p.terms:
                    d = d.join(self.table(name, "postings").where((F.col("field") == k) & (F.col("term") == term)).select("id"), "id", "left_semi")
        return d

    def aggregate(self, name: str, key: str, *conditions: tuple[str, object]) -> DataFrame:
        """(count, min, max, avg, sum) of a numeric key over the elements that meet the conditions, from the index alone: conditions on other keys are refused."""
        hit = self.query(name, *conditions)
        d = self.table(name).select("id", key)
        if dict(d.dtypes)[key] in ("string", "boolean", "binary") or dict(d.dtypes)[key].startswith(("array", "struct", "map")):
            raise ValueError(f"{key} is no number")
        d = d.join(hit, "id", "left_semi") if conditions else d
        c = F.col(key)
        return d.agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum(c).alias("sum"))

    def select(self, label: str, conditions: dict[str, object]) -> tuple[str, dict] | None:
        """(index, the conditions that it answers) with the most keys answered: a composite one needs equality on all its keys (a unique one is taken first), a mixed one takes any of its own."""
        best, score = None, (0, 0, 0)
        for name, i in self.graph.schema.indexes.items():
            if i.status != "ENABLED" or i.label not in (None, label) or i.kind == "vertex_centric":
                continue
            mine = {k: v for k, v in conditions.items() if k in i.keys}
            if i.kind == "composite" and (len(mine) < len(i.keys) or any(isinstance(v, (P, Words)) for v in mine.values())):
                continue
            rank = (int(i.unique), len(mine), int(i.kind == "composite"))
            if mine and rank > score:
                best, score = (name, mine), rank
        return best

    def vertices(self, label: str, conditions: dict[str, object], force: bool = False) -> DataFrame:
        """Vertices by conditions: ids from as many indexes as help, intersected, and what they leave is filtered on the vertices. force: a query that no index helps is refused."""
        left, ids, used = dict(conditions), None, []
        while found := self.select(label, left):
            name, mine = found
            i = self.graph.schema.indexes[name]
            hit = self.lookup(name, *[mine[k] for k in i.keys]) if i.kind == "composite" else self.query(name, *mine.items())
            ids = hit if ids is None else ids.join(hit, "id", "left_semi")
            left = {k: v for k, v in left.items() if k not in mine}
            used.append(name)
        if force and not used:
            raise ValueError("no index answers any of these conditions")
        v = self.graph.vertices[label]
        kinds = dict(v.dtypes)
        for k, p in left.items():
            p = reduce(P.and_, [_has_word(t) for t in p.terms]) if isinstance(p, Words) else as_predicate(p)
            v = v.where(p.column(F.col(k), kinds[k]))
        return v if ids is None else v.join(ids.select("id").distinct(), "id", "left_semi")

    # Checks ---------------------------------------------------------------------------------------------------------

    def stale_entries(self, name: str) -> DataFrame:
        """Entries that the base no longer has."""
        return self.table(name).exceptAll(self.base(name))

    def missing_entries(self, name: str) -> DataFrame:
        return self.base(name).exceptAll(self.table(name))

    def unique_violations(self, name: str) -> DataFrame:
        i = self.graph.schema.indexes[name]
        return self.base(name).groupBy(*i.keys).agg(F.count("*").alias("n")).where("n > 1")


@dataclass(frozen=True)
class Words:
    """All these words, as the text analyzer would cut them."""

    text: str

    @property
    def terms(self) -> list[str]:
        import re

        return [t for t in re.split(r"[^\w]|_", self.text.lower()) if len(t) >= 2]


def _has_word(term: str) -> P:
    return P(lambda c, k: F.array_contains(tokens(c), term), "word")


def print_schema(graph: PropertyGraph) -> dict[str, DataFrame]:
    """vertex_labels, edge_labels, property_keys and indexes as tables."""
    s, spark = graph.schema, graph.spark
    return {
        "vertex_labels": spark.createDataFrame([(v.name, v.partitioned, v.static) for v in s.vertex_labels.values()], "name string, partitioned boolean, static boolean"),
        "edge_labels": spark.createDataFrame([(e.name, e.directed, e.multiplicity) for e in s.edge_labels.values()], "name string, directed boolean, multiplicity string"),
        "property_keys": spark.createDataFrame([(k.name, k.cardinality, k.type) for k in s.keys.values()], "name string, cardinality string, type string"),
        "indexes": spark.createDataFrame([(i.name, i.kind, ",".join(i.keys), i.label, i.unique, i.status) for i in s.indexes.values()], "name string, kind string, keys string, label string, is_unique boolean, status string"),
    }
