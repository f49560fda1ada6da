"""GraphSON adjacency lines (one JSON object per vertex, as graph tools exchange them), typed (v3) or plain (v1, v2), and GraphML."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import RESERVED, PropertyGraph

EDGE = "struct<id:string,inV:string,outV:string,properties:map<string,string>>"
PROPERTY = "struct<id:string,value:string>"


def _plain(c: Column) -> Column:
    """Text of a JSON value, out of its {"@type", "@value"} wrapper if it has one."""
    return F.when(F.get_json_object(c, "$['@value']").isNotNull(), F.get_json_object(c, "$['@value']")).otherwise(c)


def read_graphson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: id, label, properties map<string, array<string>>; edges: eid, label, src, dst, properties map<string, string>), ids as text.
    Lines are parsed by native JSON functions; edges are taken from outE."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    v = raw.select(F.from_json("value", "id string, label string, properties map<string,array<string>>, outE map<string,array<string>>").alias("v")).select("v.*")
    props = F.transform_values("properties", lambda k, xs: F.transform(xs, lambda x: _plain(F.coalesce(F.get_json_object(x, "$['@value'].value"), F.get_json_object(x, "$.value")))))
    vertices = v.select(_plain(F.col("id")).alias("id"), "label", F.coalesce(props, F.create_map().cast("map<string,array<string>>")).alias("properties"))
    e = v.select(_plain(F.col("id")).alias("src"), F.explode("outE").alias("label", "es")).select("src", "label", F.explode("es").alias("e"))
    field = lambda n: _plain(F.get_json_object("e", f"$.{n}"))
    values = F.transform_values(F.from_json(F.get_json_object("e", "$.properties"), "map<string,string>"), lambda k, x: _plain(x))
    edges = e.select(field("id").alias("eid"), "label", "src", field("inV").alias("dst"), F.coalesce(values, F.create_map().cast("map<string,string>")).alias("properties"))
    return vertices, edges


def write_graphson(graph: PropertyGraph, path: str | None = None, labels=None) -> DataFrame:
    """Adjacency lines (column value), written to path if one is given. A vertex's edges meet in one line: that is the format."""
    props = graph.property_frame(labels).groupBy("id", "key").agg(F.sort_array(F.collect_list("value")).alias("vs"))
    props = props.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.transform("vs", lambda x: F.struct(x.alias("value"))).alias("vs"))))).alias("properties"))
    parts = []
    for label, t in graph.edge_tables():
        names = [c for c in t.df.columns if c not in ("eid", "src", "dst")]
        items = [F.struct(F.lit(c).alias("k"), (F.to_json(c) if dict(t.df.dtypes)[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias("v")) for c in names]
        p = F.map_from_entries(F.filter(F.array(*items), lambda x: x["v"].isNotNull())) if items else F.create_map().cast("map<string,string>")
        parts.append(t.df.select(F.lit(label).alias("label"), F.col("eid").cast("string").alias("eid"), "src", "dst", p.alias("p")))
    e = parts[0]
    for x in parts[1:]:
        e = e.unionByName(x)

    def side(here: str, there: str, name: str) -> DataFrame:
        """A vertex's edges by label; sorted while properties are still text, as maps have no order."""
        end = "inV" if here == "src" else "outV"
        es = e.groupBy(F.col(here).alias("id"), "label").agg(F.sort_array(F.collect_list(F.struct(F.col("eid").alias("id"), F.col(there).alias(end), F.to_json("p").alias("p")))).alias("es"))
        lists = es.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "es"))).alias("ls"))
        edge = lambda x: F.struct(x["id"].alias("id"), x[end].alias(end), F.from_json(x["p"], "map<string,string>").alias("properties"))
        return lists.select("id", F.map_from_entries(F.transform("ls", lambda x: F.struct(x["label"].alias("label"), F.transform(x["es"], edge).alias("es")))).alias(name))

    v = graph.vertex_frame(labels).select("id", "label").join(props, "id", "left").join(side("src", "dst", "outE"), "id", "left").join(side("dst", "src", "inE"), "id", "left")
    lines = v.select(F.to_json(F.struct("id", "label", "inE", "outE", "properties")).alias("value"))
    if path:
        lines.write.text(path)
    return lines


def write_graphml(graph: PropertyGraph, path: str) -> None:
    """A folder of GraphML documents, one a task: each has the header and some of the nodes or edges."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    p = graph.property_frame().groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<data key="'), esc(F.col("key")), F.lit('">'), esc(F.col("value")), F.lit("</data>")))), "").alias("d"))
    v = graph.vertex_frame().select("id", "label").join(p, "id", "left")
    nodes = v.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('"><data key="labelV">'), esc(F.col("label")), F.lit("</data>"), F.coalesce("d", F.lit("")), F.lit("</node>")).alias("value"))
    e = graph.edge_frame().select("eid", "src", "dst", "label")
    edges = e.select(F.concat(F.lit('<edge id="'), esc(F.col("eid").cast("string")), F.lit('" source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('"><data key="labelE">'), esc(F.col("label")), F.lit("</data></edge>")).alias("value"))
    header = graphml_header(sorted({c for v in graph.vertices.values() for c in v.columns if c not in RESERVED}))

    def document(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches
        yield pd.DataFrame({"value": [FOOTER]})

    nodes.unionByName(edges).mapInPandas(document, "value string").write.text(path)


FOOTER = "</graph></graphml>"


def graphml_header(keys: list[str]) -> str:
    named = "".join(f'<key id={quoteattr(k)} for="node" attr.name={quoteattr(k)} attr.type="string"/>' for k in keys)
    return f'<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{named}<graph id="G" edgedefault="directed">'


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, properties; edges: eid, src, dst, properties), properties map<string, string>, by Spark's XML source."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: F.struct(x["_key"], x["_VALUE"])))
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("id"), as_map.alias("properties"))
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, {data}").load(path)
    return n, e.select(F.col("_id").alias("eid"), F.col("_source").alias("src"), F.col("_target").alias("dst"), as_map.alias("properties"))
