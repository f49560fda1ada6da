"""Registered queries of the engine beside traversals: indexes, vertex programs, scan jobs, changes under a schema, change logs, shapes. They join the catalogue when this is imported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import geo
from graphloom.functions.predicates import P
from graphloom.graph import PropertyGraph
from graphloom.lineage import new_path
from graphloom.operators import algorithms, mutate
from graphloom.operators.index import ACTIONS, IndexCatalog, Words
from graphloom.operators.pregel import GraphComputer, MapReduce, Memory, VertexProgram
from graphloom.operators.scan import VertexScan
from graphloom.plans.catalog import _D, _S, _g, _named, query
from graphloom.plans.traversal import T, __
from graphloom.schema import INDEX_STATES, EdgeLabel, PropertyKey, VertexLabel
from graphloom.sources.tables import trade_graph

_C, _O = 3 << 56, 6 << 56


def _key(column="id"):
    """A vertex's key in its table, out of its id."""
    return (F.col(column) if isinstance(column, str) else column).bitwiseAND(F.lit((1 << 56) - 1))


# Steps -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey + {_C} AS id FROM customer WHERE c_nationkey = 3")
def id_step(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").has("c_nationkey", 3).id_(), id="value")


@query("SELECT 'n_name' AS key, count(*) AS n FROM nation UNION ALL SELECT 'n_regionkey', count(*) FROM nation")
def key_step(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("nation").properties("n_name", "n_regionkey").key().df().groupBy(F.col("value").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS value FROM nation UNION ALL SELECT n_regionkey::VARCHAR FROM nation")
def value_step(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("nation").properties("n_name", "n_regionkey").value().df()


@query("SELECT s_suppkey, s_name || '!' AS value FROM supplier WHERE s_suppkey % 2 = 0")
def properties_meta_filter(spark, sf_dir):
    """Properties with properties of their own, filtered by those."""
    g = trade_graph(spark, sf_dir)
    item = F.struct(F.concat("s_name", F.lit("!")).alias("value"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    g.vertices["supplier"] = g.vertices["supplier"].withColumn("title", F.array(item))
    d = g.traversal().V().has_label("supplier").properties("title").has("even", True).df()
    return d.select(_key().alias("s_suppkey"), "value")


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS tag FROM part WHERE p_size < 10) WHERE starts_with(tag, 'Brand#1')")
def unfold_lists(spark, sf_dir):
    """A LIST key's values, folded per vertex and unfolded again."""
    g = trade_graph(spark, sf_dir)
    g.vertices["part"] = g.vertices["part"].withColumn("tags", F.array("p_brand", "p_type"))
    f = g.traversal().V().has_label("part").has("p_size", P.lt(10)).as_("p").local(__.values("tags").fold()).unfold().is_(P.starting_with("Brand#1")).frame()
    return f.df.select(_key("@p").alias("p_partkey"), F.col("_val").alias("tag"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 9 AND o_orderstatus = 'P'")
def flat_map_traversal(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("customer").has("c_nationkey", 9).as_("c").flat_map(__.out("placed").has("o_orderstatus", "P")).side_effect(__.count()).frame()
    return f.df.select(_key("@c").alias("c_custkey"), _key("_id").alias("o_orderkey"))


@query("SELECT word AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size = 1)")
def flat_map_lambda(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("part").has("p_size", 1).values("p_name").flat_map(lambda c: F.split(c, " ")).df()


@query("SELECT count(DISTINCT s_nationkey) AS n, sum(s_nationkey)::BIGINT AS total FROM supplier WHERE s_acctbal > 5000")
def aggregate_cap(spark, sf_dir):
    """Nations gathered on the way, and taken out at the end as one list."""
    t = _g(spark, sf_dir).V().has_label("supplier").has("s_acctbal", P.gt(5000.0)).out("in_nation").values("n_nationkey").aggregate("seen").cap("seen")
    return t.df().select(F.size(F.array_distinct("value")).cast("bigint").alias("n"), F.aggregate("value", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT DISTINCT conv_id, turn FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id) AND turn > 0")
def repeat_do_while(spark, sf_dir):
    """The body runs before the condition is asked: conversations of one turn have no result."""
    t = _g(spark, sf_dir).V().has_label("turn").has("turn", 0).repeat(__.out("next")).until(__.not_(__.out("next")))
    f = t.frame().load()
    return f.df.select(F.col("p_conv_id").alias("conv_id"), F.col("p_turn").alias("turn"))


@query(f"SELECT n_nationkey + {2 << 56} AS id, 'nation' AS label, n_name AS name, n_regionkey::VARCHAR AS region, 2 AS n FROM nation")
def value_map_tokens(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("nation").value_map("n_name", "n_regionkey", tokens=True).df()
    return d.select("id", "label", F.col("value")["n_name"][0].alias("name"), F.col("value")["n_regionkey"][0].alias("region"), F.size("value").alias("n"))


@query("SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY ALL")
def with_computer_group(spark, sf_dir):
    d = trade_graph(spark, sf_dir).traversal().with_computer().V().has_label("customer").group_count().by("c_mktsegment").df()
    return d.select("key", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def custom_predicate(spark, sf_dir):
    """A predicate of one's own, negated and negated again."""
    p = P(lambda c, kind: c % 7 == 3, "thirdOfWeek")
    return _named(_g(spark, sf_dir).V().has_label("customer").has("c_custkey", ~~p).values("c_custkey"), c_custkey="value")


@query("SELECT * FROM (VALUES (0, 25), (1, 5), (2, 5)) t(nth, rows)")
def profile_steps(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("nation").has("n_regionkey", 2).values("n_name").profile()
    from pyspark.sql import Window

    return d.select((F.row_number().over(Window.orderBy(F.desc("rows"), "step")) - 1).alias("nth"), F.col("rows").cast("int").alias("rows")).orderBy("nth")


# Indexes ---------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def mixed_query(spark, sf_dir):
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("orders", "mixed", ("o_totalprice", "o_orderstatus", "o_orderpriority"), "order", analyzers={"o_orderstatus": "string", "o_orderpriority": "string"})
    d = c.query("orders", ("o_totalprice", P.between(100000.0, 200000.0)), ("o_orderstatus", "F"), ("o_orderpriority", P.within("1-URGENT", "2-HIGH")))
    return d.select(_key().alias("o_orderkey"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({_D}, 'license') AND list_contains({_D}, 'general') AND lang = 'en'")
def mixed_query_words(spark, sf_dir):
    """Words from the postings, the language from the values."""
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("texts", "mixed", ("text", "lang"), "document", analyzers={"lang": "string"})
    return c.query("texts", ("text", Words("General license")), ("lang", "en")).select(_key().alias("doc_id"))


@query(f"SELECT count(*) FILTER (list_contains({_D}, 'license')) AS licence, count(*) FILTER (len(list_filter({_D}, lambda t: starts_with(t, 'licen'))) > 0) AS prefix, count(*) FILTER (list_contains({_D}, 'license') AND n_chars >= 1000) AS long FROM documents")
def index_totals_of_one_index(spark, sf_dir):
    """Three totals from the postings of one index."""
    from graphloom.operators.fulltext import IndexQuery

    g = trade_graph(spark, sf_dir)
    c = IndexCatalog(g).enabled("texts", "mixed", ("text", "n_chars"), "document")
    n = [IndexQuery(g, "document", q, catalog=c).totals() for q in ("v.text:license", "v.text:licen*", "+v.text:license +v.n_chars:[1000 TO *]")]
    return spark.createDataFrame([tuple(n)], "licence bigint, prefix bigint, long bigint")


@query("SELECT count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS avg, round(sum(o_totalprice), 2) AS sum FROM orders WHERE o_orderstatus = 'F'")
def index_aggregates(spark, sf_dir):
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("orders", "mixed", ("o_totalprice", "o_orderstatus"), "order", analyzers={"o_orderstatus": "string"})
    d = c.aggregate("orders", "o_totalprice", ("o_orderstatus", "F"))
    return d.select("count", "min", "max", F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size < 20 AND contains(p_name, 'blue')")
def index_intersection(spark, sf_dir):
    """One condition by a composite index, one by a mixed one, and one that neither has."""
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("brands", "composite", ("p_brand",), "part").enabled("sizes", "mixed", ("p_size",), "part")
    return c.vertices("part", {"p_brand": "Brand#12", "p_size": P.lt(20), "p_name": P.containing("blue")}, force=True).select("p_partkey")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#12' AND p_size = 7")
def composite_inline(spark, sf_dir):
    """Properties out of the index itself."""
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("brands", "composite", ("p_brand", "p_size"), "part", inline=("p_name", "p_retailprice"))
    return c.lookup("brands", "Brand#12", 7).select(_key().alias("p_partkey"), "p_name", "p_retailprice")


@query("SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_partkey IN (3, 17, 41)")
def adjacent_key(spark, sf_dir):
    """Edges by the id of their other end, as a key of the edge."""
    g = trade_graph(spark, sf_dir)
    ends = [(g.number("part") << 56) + k for k in (3, 17, 41)]
    t = g.traversal().V().has_label("supplier").as_("s").out_e("supplies").has(T.adjacent, P.within(ends)).select("s").dedup().values("s_suppkey")
    return _named(t, s_suppkey="value")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS r FROM orders WHERE o_custkey % 5 = 0 AND o_totalprice >= 50000 AND o_totalprice < 250000) WHERE r <= 2")
def vertex_centric_lookup(spark, sf_dir):
    """Of some customers' orders in a range of prices, the two dearest, from an index by customer and price."""
    g = trade_graph(spark, sf_dir)
    c = IndexCatalog(g).enabled("by_price", "vertex_centric", ("o_totalprice",), "placed")
    d = c.incident("by_price", g.vertices["customer"].where("c_custkey % 5 = 0"), interval=(50000.0, 250000.0), order="desc", limit=2)
    return d.select(_key("src").alias("c_custkey"), F.col("id").cast("bigint").alias("o_orderkey"))


@query("SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity < 30 AND l_orderkey IN (1, 2, 3, 5, 8, 13) GROUP BY ALL")
def vertex_centric_prefix(spark, sf_dir):
    """Equality on the first key, a range on the second."""
    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("lines", "vertex_centric", ("l_returnflag", "l_quantity"), "contains")
    d = c.incident("lines", [_O + k for k in (1, 2, 3, 5, 8, 13)], "R", interval=(10.0, 30.0))
    return d.groupBy(_key("src").alias("o_orderkey")).agg(F.count("*").alias("n"))


_AFTER = {
    "INSTALLED": {"REGISTER_INDEX": "REGISTERED", "DISABLE_INDEX": "DISABLED"},
    "REGISTERED": {"REINDEX": "ENABLED", "REMOVE_STALE_ENTRIES": "REGISTERED", "ENABLE_WRITE_ONLY": "WRITE_ONLY_ENABLED", "ENABLE_INDEX": "ENABLED", "DISABLE_INDEX": "DISABLED", "DISCARD_INDEX": "DISCARDED", "MARK_DISCARDED": "DISCARDED"},
    "ENABLED": {"REINDEX": "ENABLED", "REMOVE_STALE_ENTRIES": "ENABLED", "ENABLE_WRITE_ONLY": "WRITE_ONLY_ENABLED", "ENABLE_INDEX": "ENABLED", "DISABLE_INDEX": "DISABLED"},
    "DISABLED": {"REGISTER_INDEX": "REGISTERED", "REINDEX": "ENABLED", "REMOVE_STALE_ENTRIES": "DISABLED", "ENABLE_INDEX": "ENABLED", "DISABLE_INDEX": "DISABLED", "DISCARD_INDEX": "DISCARDED", "MARK_DISCARDED": "DISCARDED"},
    "DISCARDED": {"DISCARD_INDEX": "DISCARDED", "DROP_INDEX": "dropped", "MARK_DISCARDED": "DISCARDED"},
    "WRITE_ONLY_ENABLED": {"REINDEX": "WRITE_ONLY_ENABLED", "REMOVE_STALE_ENTRIES": "WRITE_ONLY_ENABLED", "ENABLE_WRITE_ONLY": "WRITE_ONLY_ENABLED", "ENABLE_INDEX": "ENABLED", "DISABLE_INDEX": "DISABLED", "DISCARD_INDEX": "DISCARDED", "MARK_DISCARDED": "DISCARDED"},
}
_REACH = {"INSTALLED": (), "REGISTERED": ("REGISTER_INDEX",), "ENABLED": ("REGISTER_INDEX", "ENABLE_INDEX"), "DISABLED": ("DISABLE_INDEX",), "DISCARDED": ("DISABLE_INDEX", "DISCARD_INDEX"), "WRITE_ONLY_ENABLED": ("REGISTER_INDEX", "ENABLE_WRITE_ONLY")}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{a}', '{_AFTER[s].get(a, 'refused')}')" for s in _AFTER for a in ACTIONS) + ") t(state, action, after)")
def index_lifecycle(spark, sf_dir):
    """Every action in every state, over regions."""
    g, rows = trade_graph(spark, sf_dir), []
    for state in INDEX_STATES:
        for action in ACTIONS:
            c = IndexCatalog(PropertyGraph(spark, {"region": g.vertices["region"]}, numbers=g.numbers))
            c.build_index("names", "composite", ("r_name",), "region")
            for a in _REACH[state]:
                c.update_index("names", a)
            try:
                rows.append((state, action, c.update_index("names", action) or "dropped"))
            except ValueError:
                rows.append((state, action, "refused"))
    return spark.createDataFrame(rows, "state string, action string, after string")


@query("SELECT 'stale' AS what, count(*) AS n FROM part WHERE p_size < 10 UNION ALL SELECT 'missing', count(*) FROM part WHERE p_size >= 40 UNION ALL SELECT 'after removal', count(*) FROM part WHERE p_size >= 10 AND p_size < 40 UNION ALL SELECT 'after reindex', count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 'after change', count(*) FROM part WHERE p_size >= 10 AND p_size < 50")
def index_repair_jobs(spark, sf_dir):
    """An index over parts that then change: what is stale and missing, what removal and reindexing leave, and an index that follows a further change."""
    g = trade_graph(spark, sf_dir)
    parts = g.vertices["part"]
    g.vertices["part"] = parts.where("p_size < 40")
    c = IndexCatalog(g).enabled("brands", "composite", ("p_brand",), "part")
    g.vertices["part"] = parts.where("p_size >= 10")
    n = [("stale", c.stale_entries("brands").count()), ("missing", c.missing_entries("brands").count())]
    c.update_index("brands", "REMOVE_STALE_ENTRIES")
    n.append(("after removal", c.table("brands").count()))
    c.update_index("brands", "REINDEX")
    n.append(("after reindex", c.table("brands").count()))
    h = g.with_changes(remove_vertices=parts.where("p_size >= 50"))
    n.append(("after change", c.follow(h).table("brands").count()))
    return spark.createDataFrame(n, "what string, n bigint")


@query("SELECT * FROM (VALUES ('orders', 'mixed', 'o_totalprice', 'order', false, 'WRITE_ONLY_ENABLED'), ('names', 'composite', 'n_name', 'nation', true, 'ENABLED'), ('lines', 'vertex_centric', 'l_quantity', 'contains', false, 'INSTALLED')) t(name, kind, keys, label, is_unique, status)")
def print_indexes(spark, sf_dir):
    from graphloom.operators.index import print_schema

    c = IndexCatalog(trade_graph(spark, sf_dir)).enabled("names", "composite", ("n_name",), "nation", unique=True)
    c.build_index("orders", "mixed", ("o_totalprice",), "order")
    for a in ("REGISTER_INDEX", "ENABLE_WRITE_ONLY"):
        c.update_index("orders", a)
    c.build_index("lines", "vertex_centric", ("l_quantity",), "contains")
    return print_schema(c.graph)["indexes"]


# Vertex programs -------------------------------------------------------------------------------------------------------


class _Ring(VertexProgram):
    """Global scope: each part sends its size to the part whose key is next, whatever the edges; twice."""

    def __init__(self, number: int, n: int) -> None:
        self.number, self.n = number, n

    def setup(self, vertices, edges):
        return vertices.select("id", F.col("p_size").cast("bigint").alias("held"))

    def send_to(self, memory: Memory):
        return F.lit(self.number << 56) + (_key() + 1) % self.n, F.col("held")

    def update(self, memory: Memory):
        return {"held": F.coalesce("inbox", F.lit(0).cast("bigint"))}

    def terminate(self, memory: Memory) -> bool:
        return memory.iteration >= 1


@query("SELECT (p_partkey + 2) % (SELECT count(*) FROM part) AS p_partkey, p_size::BIGINT AS held FROM part")
def global_scope(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    n = g.vertices["part"].count()
    state = GraphComputer(g, ["part"], ["none"]).program(_Ring(g.number("part"), n)).workers(3).submit().state
    return state.select(_key().alias("p_partkey"), "held")


@query(f"SELECT 'during' AS at, count(*) AS n FROM supplier WHERE s_suppkey <= 5 AND s_suppkey IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'after', 0::BIGINT UNION ALL SELECT 'persisted', count(*) FROM supplier WHERE s_suppkey <= 5 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def computer_result_modes(spark, sf_dir):
    """LOCALTX shows the results in the graph itself until it is rolled back; PERSIST leaves it alone and gives a graph that has them."""
    g = trade_graph(spark, sf_dir)
    few = F.col("id") <= _S + 5

    def reached(h) -> int:
        d = h.vertices["supplier"]
        return d.where(few & (F.col("degree_sum") > 0)).count() if "degree_sum" in d.columns else 0

    class Degrees(VertexProgram):
        scope = "out"

        def setup(self, vertices, edges):
            return vertices.select("id", F.lit(0).cast("bigint").alias("degree_sum"))

        def message(self, memory):
            return F.lit(1).cast("bigint")

        def update(self, memory):
            return {"degree_sum": F.coalesce("inbox", F.lit(0).cast("bigint"))}

        def terminate(self, memory):
            return True

    Degrees.scope = "in"
    computer = lambda mode: GraphComputer(g, ["supplier", "part"], ["supplies"]).program(Degrees()).result(mode).submit()
    computer("LOCALTX")
    rows = [("during", reached(g))]
    g.rollback()
    rows.append(("after", reached(g)))
    rows.append(("persisted", reached(computer("PERSIST").graph)))
    return spark.createDataFrame(rows, "at string, n bigint")


@query("SELECT p_partkey, count(*) AS n, sum(l_quantity) AS total FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 25 GROUP BY p_partkey")
def filtered_computer(spark, sf_dir):
    """Vertices and edges of a computer filtered; messages along the edges from orders, summed."""
    g = trade_graph(spark, sf_dir)

    class Totals(VertexProgram):
        def setup(self, vertices, edges):
            return vertices.select("id", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"))

        def message(self, memory):
            return F.struct(F.lit(1).cast("bigint").alias("n"), F.col("l_quantity").alias("q"))

        def combine(self, message):
            return F.struct(F.sum(message["n"]).alias("n"), F.sum(message["q"]).alias("q"))

        def update(self, memory):
            return {"n": F.coalesce(F.col("inbox.n"), F.lit(0)), "total": F.coalesce(F.col("inbox.q"), F.lit(0.0))}

        def terminate(self, memory):
            return True

    keep = F.coalesce(F.col("p_size") < 25, F.lit(True))
    state = GraphComputer(g, ["part", "order"], ["contains"]).vertices(keep).program(Totals()).submit().state
    return state.where(F.shiftright("id", 56) == g.number("part")).where("n > 0").select(_key().alias("p_partkey"), "n", "total")


@query("SELECT o_orderstatus AS key, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderstatus")
def map_reduce_orders(spark, sf_dir):
    return GraphComputer(trade_graph(spark, sf_dir), ["order"]).map_reduce("s", MapReduce((F.col("o_orderstatus"), F.lit(1)), F.count, sort=True)).submit().reduced["s"]


@query("SELECT count(*) AS vertices, count(*) FILTER (n > 20) AS busy, coalesce(sum(n), 0)::BIGINT AS orders FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey)")
def scan_counters(spark, sf_dir):
    job = VertexScan(trade_graph(spark, sf_dir), ("customer",)).where(F.col("c_acctbal") > 0).totals("out", "placed", n=F.count("*"))
    n = F.coalesce("n", F.lit(0))
    return job.counters(busy=n > 20, orders=n)


@query("SELECT c_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) AS r FROM orders) WHERE r <= 4 GROUP BY c_custkey")
def scan_relations(spark, sf_dir):
    d = VertexScan(trade_graph(spark, sf_dir), ("customer",)).relations("some", "out", "placed", limit=4).frame().where("some is not null")
    keys = F.aggregate("some", F.lit(0).cast("bigint"), lambda a, x: a + _key(x["adjacent"]))
    return d.select("c_custkey", F.size("some").cast("bigint").alias("n"), keys.alias("keys"))


# Changes under a schema ------------------------------------------------------------------------------------------------


@query("SELECT 'removed' AS what, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 3 UNION ALL SELECT 'left', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey >= 3 UNION ALL SELECT 'ghosts', 0::BIGINT")
def remove_ghosts(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    g.vertices["customer"] = g.vertices["customer"].where("c_nationkey >= 3")
    h, counts = mutate.remove_ghosts(g, ["placed"])
    removed = counts.select(F.lit("removed").alias("what"), F.col("removed").alias("n"))
    left = h.edge_frame(["placed"]).agg(F.count("*").alias("n")).select(F.lit("left").alias("what"), "n")
    return removed.unionByName(left).unionByName(mutate.ghost_edges(h, ["placed"]).agg(F.count("*").alias("n")).select(F.lit("ghosts").alias("what"), "n"))


@query("SELECT c_custkey, count(*) AS n FROM (SELECT o_custkey AS c_custkey FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0) GROUP BY c_custkey")
def add_edges(spark, sf_dir):
    """An order more for some customers."""
    g = trade_graph(spark, sf_dir)
    k = F.col("c_custkey")
    new = g.vertices["customer"].where("c_custkey % 50 = 0").select(F.concat(F.lit("new"), k).alias("eid"), F.col("id").alias("src"), (F.lit(_O + 900_000_000) + k).alias("dst"))
    return g.with_changes(add_edges={"placed": new}).edge_frame(["placed"]).groupBy(_key("src").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT 'placed' AS label, count(*) AS n FROM orders WHERE o_totalprice < 200000 UNION ALL SELECT 'in_region', count(*) FROM nation UNION ALL SELECT 'in_nation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def drop_edges(spark, sf_dir):
    """Edges of one label go; those of others stay, whatever their ids."""
    h = _g(spark, sf_dir).V().has_label("customer").out_e("placed").has("o_totalprice", P.gte(200000.0)).drop_from_graph()
    return h.edge_frame(["placed", "in_region", "in_nation"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT (c_nationkey = 2 AND o_totalprice > 150000)")
def multi_query_drop(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    q = g.multi_query(g.vertices["customer"].where("c_nationkey = 2")).direction("out").labels("placed").has("o_totalprice", P.gt(150000.0))
    return q.drop().edge_frame(["placed"]).agg(F.count("*").alias("n"))


@query(f"SELECT id FROM (SELECT c_custkey + {_C} AS id FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey + {_C} FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY id LIMIT 20 OFFSET 10")
def vertex_lists(spark, sf_dir):
    """Two lists of vertices put together, sorted, and a part of that."""
    from graphloom.operators.query import VertexList

    c = trade_graph(spark, sf_dir).vertices["customer"]
    a, b = (VertexList(c.where(x).select("id")) for x in ("c_nationkey = 1", "c_mktsegment = 'BUILDING'"))
    return a.add_all(b).sort().sub_list(10, 20).ids()


@query("SELECT 'edge' AS kind, 'REMOVED' AS change, 'in_nation' AS type, count(*) AS n FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'vertex', 'REMOVED', NULL, count(*) FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'edge', 'REMOVED', 'supplies', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3 UNION ALL SELECT 'property', 'ADDED', 's_name', 2 UNION ALL SELECT 'vertex', 'ADDED', 'supplier', 1")
def transaction_log(spark, sf_dir):
    """What a transaction with a log path writes when it commits; one that is rolled back writes nothing."""
    from graphloom.operators.transaction import begin

    g, where = trade_graph(spark, sf_dir), new_path(spark, "tx")
    g = PropertyGraph(spark, {x: g.vertices[x] for x in ("supplier", "part", "nation")}, {"supplies": g.edges["supplies"], "in_nation": [t for t in g.edges["in_nation"] if t.out_label == "supplier"]}, g.schema, {}, g.numbers)
    new = spark.createDataFrame([("new",)], "s_name string").withColumn("id", F.lit(_S + 9_000_001))
    gone = g.vertices["supplier"].where("s_nationkey = 3").select("id")
    renamed = spark.createDataFrame([(_S + 1, "other")], "id bigint, value string")
    begin(g, log_path=where, tx=7).change(remove_vertices=gone).rollback()
    begin(g, log_path=where, tx=8).change(remove_vertices=gone).change(add_vertices={"supplier": new}, set_properties={"supplier": ("s_name", renamed)}).commit()
    return spark.read.parquet(where).where("tx = 8").groupBy("kind", "change", "type").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS n")
def id_collisions(spark, sf_dir):
    return mutate.id_collisions(trade_graph(spark, sf_dir).vertices["target"], "target").agg(F.count("*").alias("n"))


@query(f"SELECT (n_nationkey + {2 << 56})::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS other FROM nation UNION ALL SELECT (r_regionkey + {1 << 56})::VARCHAR, r_name, NULL FROM region UNION ALL SELECT n_nationkey::VARCHAR, (n_nationkey + {2 << 56})::VARCHAR, (n_regionkey + {1 << 56})::VARCHAR FROM nation")
def graphml_roundtrip(spark, sf_dir):
    """Nodes with their data, and edges with their ends, as they come back."""
    from graphloom.sources import graphson

    g, where = trade_graph(spark, sf_dir), new_path(spark, "graphml")
    small = PropertyGraph(spark, {x: g.vertices[x] for x in ("nation", "region")}, {"in_region": g.edges["in_region"]}, g.schema, {}, g.numbers)
    graphson.write_graphml(small, where)
    n, e = graphson.read_graphml(spark, where)
    p = F.col("properties")
    return n.select("id", F.coalesce(p["n_name"], p["r_name"]).alias("name"), p["n_regionkey"].alias("other")).unionByName(e.select(F.col("eid").alias("id"), F.col("src").alias("name"), F.col("dst").alias("other")))


@query("SELECT count(s_acctbal) AS left, (SELECT count(*) FROM supplier) AS n FROM supplier WHERE s_nationkey > 4")
def drop_property(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    gone = g.vertices["supplier"].where("s_nationkey <= 4").select("id", F.lit(None).cast("double").alias("value"))
    return g.with_changes(set_properties={"supplier": ("s_acctbal", gone)}).vertices["supplier"].agg(F.count("s_acctbal").alias("left"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand || ',' || p_brand || ',new' ELSE p_brand END AS listed, CASE WHEN p_size < 10 THEN p_brand || ',new' ELSE p_brand END AS once FROM part")
def list_and_set_properties(spark, sf_dir):
    """LIST keeps every value, SET each once."""
    g = trade_graph(spark, sf_dir)
    for name, kind in (("listed", "LIST"), ("once", "SET")):
        g.schema.keys[name] = PropertyKey(name, "string", kind)
        g.vertices["part"] = g.vertices["part"].withColumn(name, F.array("p_brand"))
        few = g.vertices["part"].where("p_size < 10").select("id", F.explode(F.array("p_brand", F.lit("new"))).alias("value"))
        g = g.with_changes(set_properties={"part": (name, few)})
    return g.vertices["part"].select("p_partkey", F.array_join("listed", ",").alias("listed"), F.array_join("once", ",").alias("once"))


@query("SELECT * FROM (VALUES ('unknown key, none', 'refused'), ('unknown key, ignore', 'dropped'), ('unknown key, infer', 'added'), ('unknown label, none', 'refused'), ('not unique', 'refused'), ('unique', 'added'), ('multiplicity', 'refused'), ('connection', 'refused'), ('not a key of the label', 'refused')) t(change, outcome)")
def schema_enforced(spark, sf_dir):
    """Changes that a schema lets in, in part, or not at all."""
    rows = []

    def graph(mode: str) -> PropertyGraph:
        g = trade_graph(spark, sf_dir)
        g = PropertyGraph(spark, {x: g.vertices[x] for x in ("region", "nation")}, {"in_region": list(g.edges["in_region"])}, numbers=dict(g.numbers))
        g.schema.mode, g.schema.constraints = mode, True
        g.schema.keys |= {k: PropertyKey(k) for k in ("r_regionkey", "r_name", "n_nationkey", "n_name", "n_regionkey")}
        g.schema.vertex_labels |= {"region": VertexLabel("region", ("r_regionkey", "r_name")), "nation": VertexLabel("nation", ("n_nationkey", "n_name", "n_regionkey"))}
        g.schema.edge_labels["in_region"] = EdgeLabel("in_region", "MANY2ONE", (("nation", "region"),))
        IndexCatalog(g).build_index("names", "composite", ("r_name",), "region", unique=True)
        return g

    def attempt(what: str, mode: str, done, **change) -> None:
        try:
            rows.append((what, done(graph(mode).with_changes(**change))))
        except ValueError:
            rows.append((what, "refused"))

    region = lambda name: spark.createDataFrame([(99, name)], "r_regionkey int, r_name string").withColumn("id", F.lit((1 << 56) + 99))
    odd = region("NEW").withColumn("odd", F.lit(1))
    edge = lambda a, b: spark.createDataFrame([("x", a, b)], "eid string, src bigint, dst bigint")
    named = lambda h: "added" if "odd" in h.vertices["region"].columns else "dropped"
    for mode in ("none", "ignore", "infer"):
        attempt(f"unknown key, {mode}", mode, named, add_vertices={"region": odd})
    attempt("unknown label, none", "none", named, add_vertices={"planet": region("MARS")})
    attempt("not unique", "none", lambda h: "added", add_vertices={"region": region("ASIA")})
    attempt("unique", "none", lambda h: "added", add_vertices={"region": region("NEW")})
    attempt("multiplicity", "none", lambda h: "added", add_edges={"in_region": edge(2 << 56, (1 << 56) + 1)})
    attempt("connection", "none", lambda h: "added", add_edges={"in_region": edge(1 << 56, 1 << 56)})
    attempt("not a key of the label", "none", lambda h: "added", add_vertices={"region": region("NEW").withColumn("n_name", F.lit("x"))})
    return spark.createDataFrame(rows, "change string, outcome string")


@query("SELECT event_id, CASE WHEN ts + INTERVAL 10 DAY > (SELECT max(ts) FROM events) THEN value END AS value FROM events WHERE ts + INTERVAL 30 DAY > (SELECT max(ts) FROM events)")
def ttl_by_schema(spark, sf_dir):
    """Events live thirty days, their values ten."""
    g = trade_graph(spark, sf_dir)
    g = PropertyGraph(spark, {"event": g.vertices["event"]}, {}, g.schema, {}, g.numbers)
    g.schema.vertex_labels["event"].ttl_seconds = 30 * 86400
    g.schema.keys["value"] = PropertyKey("value", "double", ttl_seconds=10 * 86400)
    now = g.vertices["event"].agg(F.max("ts")).first()[0]
    return mutate.expire(g, F.lit(now), created="ts").vertices["event"].select("event_id", "value")


@query("SELECT 'own view' AS at, count(*) AS n FROM customer WHERE c_nationkey <> 1 UNION ALL SELECT 'rolled back', count(*) FROM customer UNION ALL SELECT 'committed', count(*) FROM customer WHERE c_nationkey <> 1")
def transaction_view(spark, sf_dir):
    """A graph's own uncommitted removals are seen by its queries, until they are rolled back or for good."""
    g = trade_graph(spark, sf_dir)
    n = lambda: g.vertices["customer"].count()
    remove = lambda: g.begin(g.with_changes(remove_vertices=g.vertices["customer"].where("c_nationkey = 1")))
    remove()
    rows = [("own view", n())]
    g.rollback()
    rows.append(("rolled back", n()))
    remove()
    g.commit()
    g.rollback()
    rows.append(("committed", n()))
    return spark.createDataFrame(rows, "at string, n bigint")


# Change logs -----------------------------------------------------------------------------------------------------------


def _log(spark, sf_dir, where: str):
    from graphloom.plans.catalog import _events
    from graphloom.streaming.changes import ChangeLog

    whole = _events(spark, sf_dir)
    return whole, ChangeLog(spark, f"appended-{uuid.uuid4().hex}", where, whole.batch().schema, lambda d: d)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM events")
def change_resume(spark, sf_dir):
    """A processor goes on where its identifier stopped: what is appended after its first run comes in its second, once."""
    from graphloom.streaming.changes import append_changes

    where, out = new_path(spark, "log"), new_path(spark, "read")
    whole, log = _log(spark, sf_dir, where)
    for run, part in ((1, "tx % 3 = 0"), (2, "tx % 3 != 0")):
        append_changes(whole.batch().where(part), where)
        log.processor("one").add_processor(lambda tx, state, run=run: state.rows.select(F.col("tx").alias("event_id"), F.lit(run).alias("run")).write.mode("append").parquet(out)).run()
    return spark.read.parquet(out)


@query("SELECT event_id FROM events WHERE ts >= (SELECT quantile_disc(ts, 0.5) FROM events)")
def change_start_time(spark, sf_dir):
    from graphloom.streaming.changes import time_at_rank

    out = new_path(spark, "read")
    at = time_at_rank(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts"), lambda n: (n + 1) // 2 - 1)
    whole, _ = _log(spark, sf_dir, "")
    if at is None:
        return whole.batch().select(F.col("tx").alias("event_id")).limit(0)
    whole.processor(f"from-{uuid.uuid4().hex}").set_start_time(at).add_processor(lambda tx, state: state.rows.select(F.col("tx").alias("event_id")).write.mode("append").parquet(out)).run()
    return spark.read.parquet(out)


@query("SELECT count(*) AS n, 3 AS attempts FROM events")
def change_retries(spark, sf_dir):
    """A processor that fails twice and then succeeds has every change once."""
    out, tried = new_path(spark, "read"), []

    def shaky(tx, state) -> None:
        tried.append(1)
        if len(tried) < 3:
            raise RuntimeError("not yet")
        state.rows.select("tx").write.mode("append").parquet(out)

    whole, _ = _log(spark, sf_dir, "")
    whole.processor(f"shaky-{uuid.uuid4().hex}").set_retry_attempts(3).add_processor(shaky).run()
    return spark.read.parquet(out).agg(F.count("*").alias("n")).withColumn("attempts", F.lit(len(tried)))


@query("SELECT DISTINCT user_id AS vertex, 'signed up' AS what FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 'viewed' FROM events WHERE event_type = 'view' GROUP BY user_id HAVING count(*) > 5")
def change_state_views(spark, sf_dir):
    """vertices() and properties() of a change state."""
    from graphloom.plans.catalog import _processed

    def both(s) -> DataFrame:
        new = s.vertices("ADDED").select("vertex", F.lit("signed up").alias("what"), F.lit(1).alias("n"))
        return new.unionByName(s.properties("ADDED").select("vertex", F.lit("viewed").alias("what"), F.lit(1).alias("n")))

    d = _processed(spark, sf_dir, both).groupBy("vertex", "what").agg(F.sum("n").alias("n"))
    return d.where("what = 'signed up' OR n > 5").select("vertex", "what")


# Shapes that aren't points ---------------------------------------------------------------------------------------------

# Boxes of WKT per customer: west = key % 300 - 170, south = key % 120 - 80, 10 wide and 5 high; lines are their diagonals.
_BOX = "(SELECT *, (c_custkey % 300 - 170)::DOUBLE AS w, (c_custkey % 120 - 80)::DOUBLE AS s FROM customer)"


def _boxes(name: str, predicate: P, where: str, line: bool = False) -> None:
    def run(spark, sf_dir):
        g = trade_graph(spark, sf_dir)
        w, s = F.col("c_custkey") % 300 - 170, F.col("c_custkey") % 120 - 80
        shape = F.format_string("LINESTRING (%d %d, %d %d)", w, s, w + 10, s + 5) if line else F.format_string("ENVELOPE (%d, %d, %d, %d)", w, w + 10, s + 5, s)
        g.vertices["customer"] = g.vertices["customer"].withColumn("area", shape)
        return _named(g.traversal().V().has_label("customer").has("area", predicate).values("c_custkey"), c_custkey="value")

    run.__name__ = name
    query(f"SELECT c_custkey FROM {_BOX} WHERE {where}")(run)


_boxes("geo_shapes_intersect", geo.geo_intersect(geo.box(-10.5, -20.5, 30.5, 40.5)), "w <= 40.5 AND w + 10 >= -20.5 AND s <= 30.5 AND s + 5 >= -10.5")
_boxes("geo_shapes_disjoint", geo.geo_disjoint(geo.box(-10.5, -20.5, 30.5, 40.5)), "NOT (w <= 40.5 AND w + 10 >= -20.5 AND s <= 30.5 AND s + 5 >= -10.5)")
_boxes("geo_shapes_within", geo.geo_within(geo.geoshape("ENVELOPE (-60.5, 70.5, 40.5, -30.5)")), "w >= -60.5 AND w + 10 <= 70.5 AND s >= -30.5 AND s + 5 <= 40.5")
_boxes("geo_shapes_contain", geo.geo_contains(geo.geoshape('{"type": "Point", "coordinates": [3.5, -33.25]}')), "w <= 3.5 AND w + 10 >= 3.5 AND s <= -33.25 AND s + 5 >= -33.25")
_boxes("geo_lines_within", geo.geo_within(geo.geoshape([-30.5, -60.5, 40.5, 70.5])), "w >= -60.5 AND w + 10 <= 70.5 AND s >= -30.5 AND s + 5 <= 40.5", line=True)
