"""Immutable graph versions: additions, property changes, removals with their cascades, expiry, and the checks that writes are held to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import EdgeTable, PropertyGraph
from graphloom.lineage import materialize


def with_changes(graph: PropertyGraph, add_vertices: dict | None = None, add_edges: dict | None = None, set_properties: dict | None = None, remove_vertices: DataFrame | None = None, remove_edges: DataFrame | None = None, check: bool | None = None) -> PropertyGraph:
    """A new graph; the old one stays as it is. Names that the schema doesn't know are added, dropped or refused, as its mode says.
    check (by default where the schema has constraints): a change that breaks a unique index, a multiplicity or a connection is refused with a ValueError; that runs the checks.

    add_vertices: label -> rows with id and properties. add_edges: label -> rows with eid, src, dst, added to each edge table whose ends fit the ids.
    set_properties: label -> (key, rows (id, value)). remove_vertices: rows with id; their edges go too. remove_edges: rows with eid and, as an eid is only known within its label, label; with src and dst too, these must agree.
    """
    g = graph.copy()
    check = g.schema.constraints if check is None else check
    for label, rows in (add_vertices or {}).items():
        rows = g.schema.admit_vertices(label, rows)
        old = g.vertices.get(label)
        g.number(label)
        g.vertices[label] = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    for label, rows in (add_edges or {}).items():
        rows = g.schema.admit_edges(label, rows)
        if check and g.schema.edge_labels[label].connections:
            number = {n: x for x, n in g.numbers.items()}
            ends = rows.select(F.shiftright("src", 56).alias("o"), F.shiftright("dst", 56).alias("i")).distinct().collect()  # at most labels squared
            if bad := [(number.get(r["o"]), number.get(r["i"])) for r in ends if (number.get(r["o"]), number.get(r["i"])) not in g.schema.edge_labels[label].connections]:
                raise ValueError(f"{label} doesn't connect {bad}")
        for t in g.edges.get(label, []):
            mine = rows.where((F.shiftright("src", 56) == g.numbers[t.out_label]) & (F.shiftright("dst", 56) == g.numbers[t.in_label]))
            t2 = EdgeTable(t.df.unionByName(mine, allowMissingColumns=True), t.out_label, t.in_label)
            g.edges[label] = [t2 if x is t else x for x in g.edges[label]]
    for label, (key, rows) in (set_properties or {}).items():
        cardinality = g.schema.keys[key].cardinality if key in g.schema.keys else "SINGLE"
        g.vertices[label] = set_property(g.vertices[label], key, rows, cardinality)
    if remove_edges is not None:
        known = [c for c in ("label", "src", "dst") if c in remove_edges.columns]
        gone = remove_edges.select(F.col("eid").cast("string").alias("_gone"), *[F.col(c).alias(f"_{c}") for c in known]).distinct()
        for label, ts in g.edges.items():
            on = F.col("eid").cast("string") == F.col("_gone")
            for c in known:
                on = on & ((F.lit(label) if c == "label" else F.col(c)) == F.col(f"_{c}"))
            g.edges[label] = [EdgeTable(t.df.join(gone, on, "left_anti"), t.out_label, t.in_label) for t in ts]
    if remove_vertices is not None:
        gone = remove_vertices.select(F.col("id").alias("_gone")).distinct()
        without = lambda df, c: df.join(gone, F.col(c) == F.col("_gone"), "left_anti")
        g.vertices = {x: without(df, "id") for x, df in g.vertices.items()}
        g.edges = {x: [EdgeTable(without(without(t.df, "src"), "dst"), t.out_label, t.in_label) for t in ts] for x, ts in g.edges.items()}
    if check:
        verify(g, set(add_vertices or {}) | set(set_properties or {}), set(add_edges or {}))
    return g


def verify(graph: PropertyGraph, vertex_labels: set[str], edge_labels: set[str]) -> None:
    """Raise ValueError if a unique index over one of these vertex labels, or the multiplicity of one of these edge labels, is broken."""
    for i in graph.schema.indexes.values():
        for label in vertex_labels if i.unique and i.kind == "composite" else ():
            if i.label in (None, label) and set(i.keys) <= set(graph.vertices[label].columns) and not uniqueness_violations(graph.vertices[label], list(i.keys)).isEmpty():
                raise ValueError(f"{i.name} isn't unique any more")
    for label in edge_labels:
        if not multiplicity_violations(graph, label).isEmpty():
            raise ValueError(f"{label} has more edges than {graph.schema.edge_labels[label].multiplicity} allows")


def drop(graph: PropertyGraph, frame) -> PropertyGraph:
    if frame.kind == "vertex":
        return with_changes(graph, remove_vertices=frame.df.select(F.col("_id").alias("id")))
    if frame.kind == "edge":
        return with_changes(graph, remove_edges=frame.df.select(F.col("_id").alias("eid"), F.col("_label").alias("label"), F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    raise ValueError("only vertices and edges can be dropped")


def set_property(df: DataFrame, key: str, rows: DataFrame, cardinality: str = "SINGLE") -> DataFrame:
    """rows (id, value[, at]). SINGLE: the latest (by at, then value) replaces, null removes; LIST: values are appended; SET: added where new."""
    if cardinality == "SINGLE":
        at = F.struct("at", "value") if "at" in rows.columns else F.struct("value")
        new = rows.groupBy("id").agg(F.max_by("value", at).alias("_new"))
        out = df.join(new.withColumn("_has", F.lit(True)), "id", "left")
        return out.withColumn(key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(key))).drop("_new", "_has")
    new = rows.groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("_new"))
    out = df.join(new, "id", "left")
    old, more = F.coalesce(F.col(key), F.array().cast(df.schema[key].dataType)), F.coalesce("_new", F.array().cast(df.schema[key].dataType))
    return out.withColumn(key, F.array_union(old, more) if cardinality == "SET" else F.concat(old, more)).drop("_new")


def expired(df: DataFrame, created: Column, ttl_seconds: int, now: Column) -> DataFrame:
    """Rows whose time to live is over."""
    return df.where(created + F.make_dt_interval(secs=F.lit(ttl_seconds)) <= now)


def alive(df: DataFrame, created: Column, ttl_seconds: int, now: Column) -> DataFrame:
    return df.where(~F.coalesce(created + F.make_dt_interval(secs=F.lit(ttl_seconds)) <= now, F.lit(False)))


def expire(graph: PropertyGraph, now: Column, created: str = "created") -> PropertyGraph:
    """The graph at `now`: rows of labels with a time to live whose column `created` is older are gone (a vertex's edges with it), and values of keys with one are absent. What has no such column lives."""
    g = graph.copy()
    for label in g.vertices:
        kind = g.schema.vertex_labels.get(label)
        keys = [k for k in g.schema.keys.values() if k.ttl_seconds]
        if not (keys or (kind and kind.ttl_seconds)):
            continue
        df = g.vertices[label]
        if created not in df.columns:
            continue
        if kind and kind.ttl_seconds:
            g = with_changes(g, remove_vertices=expired(df, F.col(created), kind.ttl_seconds, now).select("id"), check=False)
            df = g.vertices[label]
        for k in keys:
            if k.name in df.columns:
                over = F.coalesce(F.col(created) + F.make_dt_interval(secs=F.lit(k.ttl_seconds)) <= now, F.lit(False))
                df = df.withColumn(k.name, F.when(~over, F.col(k.name)))
        g.vertices[label] = df
    for label, ts in g.edges.items():
        ttl = g.schema.edge_labels[label].ttl_seconds if label in g.schema.edge_labels else None
        if ttl:
            g.edges[label] = [EdgeTable(alive(t.df, F.col(created), ttl, now), t.out_label, t.in_label) if created in t.df.columns else t for t in ts]
    return g


# Checks ------------------------------------------------------------------------------------------------------------------


def ghost_edges(graph: PropertyGraph, labels=None) -> DataFrame:
    """(eid, label, src, dst) of edges with an end that no longer exists."""
    parts = []
    for label, t in graph.edge_tables(labels):
        v_out, v_in = graph.vertices[t.out_label].select(F.col("id").alias("src")), graph.vertices[t.in_label].select(F.col("id").alias("dst"))
        e = t.df.select(F.col("eid").cast("string").alias("eid"), F.lit(label).alias("label"), "src", "dst")
        # Each edge once, also where both ends are gone.
        parts.append(e.join(v_out, "src", "left_anti").select(*e.columns).unionByName(e.join(v_out, "src", "left_semi").join(v_in, "dst", "left_anti").select(*e.columns)))
    return reduce(DataFrame.unionByName, parts)


def remove_ghosts(graph: PropertyGraph, labels=None) -> tuple[PropertyGraph, DataFrame]:
    """The graph without edges that have an end which no longer exists, and (label, removed): how many went."""
    ghosts = materialize(ghost_edges(graph, labels), "ghosts")
    g = graph.copy()
    for label in g.edges if labels is None else labels:
        gone = ghosts.where(F.col("label") == label).select(F.col("eid").alias("_gone"), F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        on = (F.col("eid").cast("string") == F.col("_gone")) & (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst"))
        g.edges[label] = [EdgeTable(t.df.join(gone, on, "left_anti"), t.out_label, t.in_label) for t in g.edges[label]]
    return g, ghosts.groupBy("label").agg(F.count("*").alias("removed"))


def uniqueness_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): value combinations that stand in more than one row, all keys present."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def id_collisions(df: DataFrame, key: str) -> DataFrame:
    """(id, n): ids that several values of a text key share. Ids of text keys are 56-bit hashes: from some hundred million keys on, check before the graph is used."""
    return df.groupBy("id").agg(F.countDistinct(key).alias("n")).where("n > 1")


def multiplicity_violations(graph: PropertyGraph, label: str, multiplicity: str | None = None) -> DataFrame:
    """(side, vertex, n): vertices with more edges of the label than its multiplicity allows; for SIMPLE, vertex is src, and a row per repeated pair."""
    m = multiplicity or graph.schema.edge_labels[label].multiplicity
    e = graph.edge_frame([label])
    sides = {"MULTI": (), "SIMPLE": (), "MANY2ONE": ("src",), "ONE2MANY": ("dst",), "ONE2ONE": ("src", "dst")}[m]
    if m == "SIMPLE":
        return e.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("src").alias("side"), F.col("src").alias("vertex"), "n")
    parts = [e.groupBy(F.col(s).alias("vertex")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(s).alias("side"), "vertex", "n") for s in sides]
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "side string, vertex bigint, n bigint")


def connection_violations(graph: PropertyGraph) -> DataFrame:
    """(label, out_label, in_label, n) of edges whose ends' labels the schema doesn't connect."""
    parts = []
    for label, t in graph.edge_tables():
        if graph.schema.edge_labels[label].connections and (t.out_label, t.in_label) not in graph.schema.edge_labels[label].connections:
            parts.append(t.df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), F.lit(t.out_label).alias("out_label"), F.lit(t.in_label).alias("in_label"), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "label string, out_label string, in_label string, n bigint")


def cardinality_violations(df: DataFrame, key: str) -> DataFrame:
    """(id, n) of rows whose SET property holds a value twice."""
    return df.where(F.size(key) > F.size(F.array_distinct(key))).select("id", F.size(key).alias("n"))


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row per key by `at`."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
