"""Relational tables as a graph: which table makes which vertices and edges."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

#: table -> (vertex label, key)
VERTICES = {
    "region": ("region", "r_regionkey"),
    "nation": ("nation", "n_nationkey"),
    "customer": ("customer", "c_custkey"),
    "supplier": ("supplier", "s_suppkey"),
    "part": ("part", "p_partkey"),
    "orders": ("order", "o_orderkey"),
    "documents": ("document", "doc_id"),
    "pages": ("page", "page_id"),
}

HREF = r'href="([^"]*)"'


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Vertices of VERTICES, user and event; edges in_region, in_nation (from customers and suppliers), placed, contains, supplied_by, supplies, did, next and
    links. Nothing is read until a traversal asks for it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    some = lambda t, *cols: lambda: read(t).select(*cols)
    g, c = PropertyGraph(spark), F.col
    for table, (label, key) in VERTICES.items():
        g.add_vertices(label, lambda table=table: read(table), key)
    g.add_vertices("user", lambda: read("events").select("user_id").where("user_id is not null").distinct(), "user_id")
    g.add_vertices("event", lambda: read("events"), "event_id")
    # A turn's key has room for 4096 turns of a conversation.
    turn = F.col("conv_id") * 4096 + F.col("turn")
    g.add_vertices("turn", lambda: read("conversations").withColumn("turn_key", turn), "turn_key")
    g.add_edges("in_region", some("nation", "n_nationkey", "n_regionkey"), "nation", c("n_nationkey"), "region", c("n_regionkey"), c("n_nationkey").cast("string"), multiplicity="MANY2ONE")
    g.add_edges("in_nation", some("customer", "c_custkey", "c_nationkey"), "customer", c("c_custkey"), "nation", c("c_nationkey"), F.concat(F.lit("c"), c("c_custkey")), multiplicity="MANY2ONE")
    g.add_edges("in_nation", some("supplier", "s_suppkey", "s_nationkey"), "supplier", c("s_suppkey"), "nation", c("s_nationkey"), F.concat(F.lit("s"), c("s_suppkey")), multiplicity="MANY2ONE")
    g.add_edges("placed", some("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "customer", c("o_custkey"), "order", c("o_orderkey"), c("o_orderkey").cast("string"), multiplicity="ONE2MANY")
    line = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    g.add_edges("contains", lambda: read("lineitem"), "order", c("l_orderkey"), "part", c("l_partkey"), line)
    g.add_edges("supplied_by", some("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "order", c("l_orderkey"), "supplier", c("l_suppkey"), line)
    g.add_edges("supplies", lambda: read("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplier", c("l_suppkey"), "part", c("l_partkey"), F.concat_ws(":", "l_suppkey", "l_partkey"), multiplicity="SIMPLE")
    g.add_edges("did", lambda: read("events"), "user", c("user_id"), "event", c("event_id"), c("event_id").cast("string"))
    g.add_edges("next", lambda: read("conversations").where("turn > 0").select("conv_id", "turn"), "turn", turn - 1, "turn", turn, F.concat_ws(":", "conv_id", "turn"))
    hrefs = lambda: read("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("nth", "target"))
    g.add_vertices("target", lambda: hrefs().select("target").distinct(), "target", string_key=True)
    g.add_edges("links", hrefs, "page", c("page_id"), "target", c("target"), F.concat_ws(":", "page_id", "nth"), in_string=True)
    return g
