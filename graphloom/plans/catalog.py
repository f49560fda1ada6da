"""Registered queries: each operator of the engine over the whole driver tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import geo, text
from graphloom.functions.predicates import P
from graphloom.operators import algorithms, mutate
from graphloom.operators.pregel import GraphComputer, MapReduce
from graphloom.plans.traversal import T, __, ref
from graphloom.sources.tables import trade_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _g(spark: SparkSession, sf_dir: str):
    return trade_graph(spark, sf_dir).traversal()


def _named(t, **names: str) -> DataFrame:
    """The traversal's result with columns renamed new=old."""
    return t.df().select(*[F.col(old).alias(new) for new, old in names.items()])


# Scans -----------------------------------------------------------------------------------------------------------------


@query("SELECT o.n_nationkey, o.n_name, count(*) AS n_orders FROM customer c JOIN orders x ON x.o_custkey = c.c_custkey JOIN nation o ON o.n_nationkey = c.c_nationkey WHERE c.c_mktsegment = 'BUILDING' AND x.o_orderstatus = 'F' GROUP BY ALL")
def flagship(spark, sf_dir):
    """Orders with a status, of customers of a segment, counted by nation: two hops, two filters, a binding and a group."""
    t = _g(spark, sf_dir).V().has_label("customer").has("c_mktsegment", "BUILDING").as_("c").out("placed").has("o_orderstatus", "F").select("c").out("in_nation")
    f = t.frame().load()
    return f.df.groupBy(F.col("p_n_nationkey").alias("n_nationkey"), F.col("p_n_name").alias("n_name")).agg(F.count("*").alias("n_orders"))


@query("SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'document', count(*) FROM documents UNION ALL SELECT 'page', count(*) FROM pages")
def v_count_by_label(spark, sf_dir):
    labels = ["region", "nation", "customer", "supplier", "part", "order", "document", "page"]
    return _named(_g(spark, sf_dir).V().has_label(*labels).group_count().by(T.label), label="key", n="value")


@query("SELECT 'placed' AS label, count(*) AS n FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem UNION ALL SELECT 'in_nation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'in_region', count(*) FROM nation UNION ALL SELECT 'supplies', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def e_count_by_label(spark, sf_dir):
    return _named(_g(spark, sf_dir).E().has_label("placed", "contains", "in_nation", "in_region", "supplies").group_count().by(T.label), label="key", n="value")


@query("SELECT n_nationkey AS id, 'n_name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def property_scan(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    p = g.property_frame(["nation"], ["n_name", "n_regionkey"])
    return p.select(F.col("id").bitwiseAND(F.lit((1 << 56) - 1)).cast("int").alias("id"), "key", "value")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7, 42)")
def point_lookup(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    ids = [(g.number("customer") << 56) + k for k in (1, 7, 42)]
    f = g.traversal().V(*ids).frame()
    return f.df.select(F.col("p_c_custkey").alias("c_custkey"), F.col("p_c_name").alias("c_name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3 AND c_custkey IN (3, 13, 23, 24)")
def has_id(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    ids = [(g.number("customer") << 56) + k for k in (3, 13, 23, 24)]
    return _named(g.traversal().V().has_label("customer").filter_(lambda c: c.bitwiseAND(F.lit((1 << 56) - 1)) % 10 == 3).has_id(ids).values("c_custkey"), c_custkey="value")


# Filters ---------------------------------------------------------------------------------------------------------------


def _customers(name: str, where: str, build) -> None:
    def run(spark, sf_dir):
        return _named(build(_g(spark, sf_dir).V().has_label("customer")).values("c_custkey"), c_custkey="value")

    run.__name__ = name
    query(f"SELECT c_custkey FROM customer WHERE {where}")(run)


_customers("has_eq", "c_mktsegment = 'MACHINERY'", lambda t: t.has("c_mktsegment", "MACHINERY"))
_customers("has_neq", "c_mktsegment <> 'MACHINERY'", lambda t: t.has("c_mktsegment", P.neq("MACHINERY")))
_customers("has_range", "c_acctbal > 1000 AND c_acctbal <= 5000 AND c_custkey >= 100 AND c_custkey < 90000", lambda t: t.has("c_acctbal", P.gt(1000.0)).has("c_acctbal", P.lte(5000.0)).has("c_custkey", P.gte(100)).has("c_custkey", P.lt(90000)))
_customers("has_within", "c_nationkey IN (1, 5, 9)", lambda t: t.has("c_nationkey", P.within(1, 5, 9)))
_customers("has_without", "c_nationkey NOT IN (1, 5, 9)", lambda t: t.has("c_nationkey", P.without(1, 5, 9)))
_customers("has_within_empty", "false", lambda t: t.has("c_nationkey", P.within([])))
_customers("has_without_empty", "c_nationkey IS NOT NULL", lambda t: t.has("c_nationkey", P.without([])))
_customers("has_inside", "c_acctbal > 0 AND c_acctbal < 500", lambda t: t.has("c_acctbal", P.inside(0.0, 500.0)))
_customers("has_between", "c_custkey >= 10 AND c_custkey < 50", lambda t: t.has("c_custkey", P.between(10, 50)))
_customers("has_outside", "c_acctbal < 0 OR c_acctbal > 9000", lambda t: t.has("c_acctbal", P.outside(0.0, 9000.0)))
_customers("has_connective_nested", "(c_nationkey < 5 OR (c_nationkey > 20 AND c_nationkey <> 22)) AND c_custkey > 20", lambda t: t.has("c_nationkey", P.lt(5) | (P.gt(20) & P.neq(22))).has("c_custkey", P.gt(20)))
_customers("has_negated", "NOT (c_nationkey < 5 OR c_nationkey > 20)", lambda t: t.has("c_nationkey", ~(P.lt(5) | P.gt(20))))
_customers("has_exists", "c_mktsegment IS NOT NULL", lambda t: t.has("c_mktsegment"))
_customers("has_unknown_key", "c_nationkey < 3", lambda t: t.has_not("no_such_key").has("c_nationkey", P.lt(3)).not_(__.has("no_such_key", P.neq(1))))


@query("SELECT c_custkey FROM customer WHERE NOT c_acctbal > 0")
def has_not(spark, sf_dir):
    """Vertices that lack a property, which those with a balance of 0 or less do here."""
    g = trade_graph(spark, sf_dir)
    g.vertices["customer"] = g.vertices["customer"].withColumn("credit", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return _named(g.traversal().V().has_label("customer").has_not("credit").values("c_custkey"), c_custkey="value")
_customers("and_or_filters", "(c_nationkey = 3 OR c_acctbal > 9000) AND c_mktsegment = 'BUILDING'", lambda t: t.or_(__.has("c_nationkey", 3), __.has("c_acctbal", P.gt(9000.0))).and_(__.has("c_mktsegment", "BUILDING")))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def interval(spark, sf_dir):
    return trade_graph(spark, sf_dir).query().has_label("order").interval("o_totalprice", 100000.0, 150000.0).vertices().select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal > 9000")
def graph_or_dedup(spark, sf_dir):
    q = trade_graph(spark, sf_dir).query()
    return q.has_label("customer").or_(q.has("c_nationkey", 3), q.has("c_acctbal", P.gt(9000.0))).vertices().select("c_custkey")


@query("SELECT c_custkey FROM ((SELECT * FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, c_custkey LIMIT 7)) ORDER BY c_acctbal, c_custkey LIMIT 8")
def graph_or_branch_limits(spark, sf_dir):
    q = trade_graph(spark, sf_dir).query()
    a = q.has("c_nationkey", 3).order_by("c_acctbal", "desc").limit(5)
    b = q.has("c_mktsegment", "BUILDING").order_by("c_acctbal").limit(7)
    return q.has_label("customer").or_(a, b).order_by("c_acctbal").limit(8).vertices().select("c_custkey")


@query("SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(*) > 50")
def is_predicate(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").where(__.in_("in_nation").has_label("customer").count().is_(P.gt(50)))
    t = t.project("n_nationkey", "n").by("n_nationkey").by(__.in_("in_nation").has_label("customer").count())
    return t.df()


@query("SELECT n_nationkey, 'n_name' AS key, n_name AS value FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'KENYA') UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation WHERE n_regionkey = 2")
def has_key_value(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").properties("n_nationkey", "n_name", "n_regionkey").has_key("n_name", "n_regionkey").has_value("FRANCE", "GERMANY", "KENYA", 2)
    return t.df().select((F.col("id") - F.lit(2 << 56)).cast("int").alias("n_nationkey"), "key", "value")


# Text ------------------------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}]'), lambda x: length(x) >= 2)"
_D = _TOKENS.format(c="text")


def _texts(name: str, predicate: P, where: str) -> None:
    def run(spark, sf_dir):
        return _named(_g(spark, sf_dir).V().has_label("document").has("text", predicate).values("doc_id"), doc_id="value")

    run.__name__ = name
    query(f"SELECT doc_id FROM documents WHERE {where}")(run)


def _parts(name: str, predicate: P, where: str) -> None:
    def run(spark, sf_dir):
        return _named(_g(spark, sf_dir).V().has_label("part").has("p_name", predicate).values("p_partkey"), p_partkey="value")

    run.__name__ = name
    query(f"SELECT p_partkey FROM part WHERE {where}")(run)


_texts("text_contains", text.text_contains("the License"), f"list_contains({_D}, 'the') AND list_contains({_D}, 'license')")
_texts("text_not_contains", text.text_not_contains("the"), f"NOT list_contains({_D}, 'the')")
_texts("text_contains_prefix", text.text_contains_prefix("Licen"), f"len(list_filter({_D}, lambda t: starts_with(t, 'licen'))) > 0")
_texts("text_not_contains_prefix", text.text_not_contains_prefix("th"), f"len(list_filter({_D}, lambda t: starts_with(t, 'th'))) = 0")
_texts("text_contains_regex", text.text_contains_regex("lic[a-z]+e"), f"len(list_filter({_D}, lambda t: regexp_full_match(t, 'lic[a-z]+e'))) > 0")
_texts("text_not_contains_regex", text.text_not_contains_regex("[a-z]{2}"), f"len(list_filter({_D}, lambda t: regexp_full_match(t, '[a-z]{{2}}'))) = 0")
_texts("text_contains_phrase", text.text_contains_phrase("Apache License"), f"contains(' ' || array_to_string({_D}, ' ') || ' ', ' apache license ')")
_texts("text_not_contains_phrase", text.text_not_contains_phrase("of the"), f"NOT contains(' ' || array_to_string({_D}, ' ') || ' ', ' of the ')")
_parts("text_prefix", text.text_prefix("b"), "starts_with(p_name, 'b')")
_parts("text_not_prefix", text.text_not_prefix("b"), "NOT starts_with(p_name, 'b')")
_parts("text_regex", text.text_regex("[a-m].* .*e.*"), "regexp_full_match(p_name, '[a-m].* .*e.*')")
_parts("text_not_regex", text.text_not_regex("[a-m].* .*e.*"), "NOT regexp_full_match(p_name, '[a-m].* .*e.*')")
_N = "(SELECT min(p_name) FROM part)"
_PT = _TOKENS.format(c="p_name")
_parts("text_fuzzy", text.text_fuzzy("blue boltz"), "levenshtein(trim(p_name), 'blue boltz') <= 2")
_parts("text_not_fuzzy", text.text_not_fuzzy("blue boltz"), "NOT levenshtein(trim(p_name), 'blue boltz') <= 2")
_parts("text_contains_fuzzy", text.text_contains_fuzzy("blua"), f"len(list_filter({_PT}, lambda t: levenshtein(t, 'blua') <= 1)) > 0")
_parts("text_not_contains_fuzzy", text.text_not_contains_fuzzy("blua"), f"len(list_filter({_PT}, lambda t: levenshtein(t, 'blua') <= 1)) = 0")
_parts("text_starting_ending_containing", P.starting_with("b").and_(P.ending_with("t").or_(P.containing("e"))), "starts_with(p_name, 'b') AND (ends_with(p_name, 't') OR contains(p_name, 'e'))")

# Expansion -------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4")
def out(spark, sf_dir):
    return _bound(_g(spark, sf_dir).V().has_label("customer").has("c_nationkey", 4).as_("c").out("placed").as_("o"), c_custkey="c", o_orderkey="o")


def _bound(t, **names: str) -> DataFrame:
    """Keys of bound vertices, out of their ids: no join is needed for them."""
    return t.frame().df.select(*[F.col(f"@{old}").bitwiseAND(F.lit((1 << 56) - 1)).alias(new) for new, old in names.items()])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def in_(spark, sf_dir):
    return _bound(_g(spark, sf_dir).V().has_label("nation").as_("n").in_("in_nation").has_label("supplier").as_("s"), n_nationkey="n", s_suppkey="s")


@query("SELECT n_nationkey, count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n_nationkey")
def both(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").project("n_nationkey", "n").by("n_nationkey").by(__.both().count())
    return t.df()


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.02")
def out_e(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("order").out_e("contains").has("l_quantity", P.gt(49.0)).has("l_discount", P.lt(0.02)).frame()
    return f.df.select(F.col("p_l_orderkey").alias("l_orderkey"), F.col("p_l_partkey").alias("l_partkey"), F.col("p_l_quantity").alias("l_quantity"))


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY p_brand")
def in_v(spark, sf_dir):
    return _named(_g(spark, sf_dir).E().has_label("contains").has("l_returnflag", "R").in_v().group_count().by("p_brand"), p_brand="key", n="value")


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey WHERE s_nationkey = 7 GROUP BY s_suppkey")
def other_v(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("supplier").has("s_nationkey", 7).as_("s").both_e("supplies").other_v()
    return t.frame().df.groupBy(F.col("@s").bitwiseAND(F.lit((1 << 56) - 1)).alias("s_suppkey")).agg(F.count("*").alias("n"))


@query("SELECT 2 * count(*) AS n FROM nation")
def both_v(spark, sf_dir):
    return _named(_g(spark, sf_dir).E().has_label("in_region").both_v().count(), n="value")


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def two_hop(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("region").as_("r").in_("in_region").in_("in_nation").has_label("customer").select("r").group_count().by("r_name")
    return _named(t, r_name="key", n="value")


@query("SELECT p_brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey = 11 GROUP BY p_brand")
def three_hop_label_mix(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").has("c_nationkey", 11).out("placed").out("contains").group_count().by("p_brand"), p_brand="key", n="value")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2")
def vertex_query_topk(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    q = g.multi_query(g.vertices["customer"]).direction("out").labels("placed").order_by("o_totalprice", "desc").limit(2)
    return q.edges().select(F.col("seed").bitwiseAND(F.lit((1 << 56) - 1)).alias("c_custkey"), "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def multi_query_collect(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    c = g.multi_query(g.vertices["customer"]).direction("out").labels("placed").collected()
    low = F.lit((1 << 56) - 1)
    total = F.aggregate("relations", F.lit(0).cast("bigint"), lambda a, r: a + r["adjacent"].bitwiseAND(low))
    return c.select(F.col("seed").bitwiseAND(low).alias("c_custkey"), F.size("relations").cast("bigint").alias("n"), total.alias("total"))


@query("SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_partkey = 17")
def adjacent_exists(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    part = (g.number("part") << 56) + 17
    return _named(g.traversal().V().has_label("supplier").where(__.out("supplies").has_id(part)).values("s_suppkey"), s_suppkey="value")


@query("SELECT a, b FROM (SELECT a.s_suppkey AS a, b.s_suppkey AS b, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS r FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE r <= 3")
def cohabit_neq(spark, sf_dir):
    """Of each supplier's neighbours in its nation, itself left out, the three richest."""
    near = __.out("in_nation").in_("in_nation").has_label("supplier").where(ref("neq", "x")).order().by("s_acctbal", "desc").limit(3)
    return _bound(_g(spark, sf_dir).V().has_label("supplier").as_("x").local(near).as_("y"), a="x", b="y")


@query("SELECT DISTINCT c_custkey, s_suppkey, o_orderkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey")
def match_triangle(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("customer").match(__.as_("c").out("placed").as_("o"), __.as_("o").out("supplied_by").dedup().as_("s"), __.as_("s").out("in_nation").as_("n"), __.as_("c").out("in_nation").as_("n"))
    return _bound(t, c_custkey="c", s_suppkey="s", o_orderkey="o")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def where_exists(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").where(__.out("placed").has("o_totalprice", P.gt(300000.0))).values("c_custkey"), c_custkey="value")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def where_not(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").not_(__.out("placed")).values("c_custkey"), c_custkey="value")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND (c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000))")
def where_and_or(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("customer").where(__.out("placed").has("o_orderstatus", "P")).or_(__.has("c_acctbal", P.gt(9000.0)), __.out("placed").has("o_totalprice", P.gt(300000.0)))
    return _named(t.values("c_custkey"), c_custkey="value")


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY conv_id")
def chain_edges(spark, sf_dir):
    return _named(_g(spark, sf_dir).E().has_label("next").group_count().by("conv_id"), conv_id="key", n="value")


@query("SELECT page_id, count(*) AS n, count(DISTINCT target) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY page_id")
def page_links(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("page").as_("p").out("links").frame()
    return f.df.groupBy(F.col("@p").bitwiseAND(F.lit((1 << 56) - 1)).alias("page_id")).agg(F.count("*").alias("n"), F.countDistinct("_id").alias("n_targets"))


# Projections -----------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS value FROM nation UNION ALL SELECT n_regionkey::VARCHAR FROM nation")
def values(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("nation").values("n_name", "n_regionkey").df()


@query("SELECT r_name AS name, 1 AS n FROM region")
def value_map(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("region").value_map("r_name").df()
    return d.select(F.col("value")["r_name"][0].alias("name"), F.size("value").alias("n"))


@query("SELECT n_name AS name, 'nation' AS label, n_regionkey::VARCHAR AS region FROM nation")
def element_map(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("nation").element_map("n_name", "n_regionkey").df()
    return d.select(F.col("value")["n_name"].alias("name"), "label", F.col("value")["n_regionkey"].alias("region"))


@query("SELECT 'customer' AS value, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def label_step(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("nation").in_("in_nation").label().df().groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def project_by(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("customer").project("c_custkey", "c_name", "n_orders", "n_name").by("c_custkey").by("c_name").by(__.out("placed").count()).by(__.out("in_nation").values("n_name"))
    return t.df()


@query("SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON r_regionkey = n_regionkey")
def as_select_by(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").as_("nation").out("in_region").as_("region").select("nation", "region")
    return t.by("n_name").by("r_name").df()


@query("SELECT n_name || ' > ' || r_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def path(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").out("in_region").path().by(__.coalesce(__.values("n_name"), __.values("r_name")))
    return t.df().select(F.array_join("path", " > ").alias("path"))


@query("SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def simple_path(spark, sf_dir):
    return _bound(_g(spark, sf_dir).V().has_label("nation").as_("a").out("in_region").in_("in_region").simple_path().as_("b"), a="a", b="b")


@query("SELECT count(*) AS n FROM nation")
def cyclic_path(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("nation").out("in_region").in_("in_region").cyclic_path().count(), n="value")


@query("SELECT p_size * 2.0 + 1 AS value FROM part WHERE p_size < 5")
def math_step(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("part").has("p_size", P.lt(5)).values("p_size").math_("_ * 2 + 1").df()


@query("SELECT upper(r_name) AS value FROM region")
def map_lambda(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("region").values("r_name").map_(F.upper).df()


@query("SELECT n_regionkey, (1 + count(*))::BIGINT AS n FROM nation GROUP BY n_regionkey")
def tree(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("region").in_("in_region").tree().df()
    low = F.lit((1 << 56) - 1)
    return d.groupBy(F.col("path")[0].cast("bigint").bitwiseAND(low).cast("int").alias("n_regionkey")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, r_regionkey + 10 AS total FROM nation JOIN region ON r_regionkey = n_regionkey")
def sack(spark, sf_dir):
    t = trade_graph(spark, sf_dir).traversal().with_sack(10).V().has_label("nation").as_("n").out("in_region").sack(lambda s, v: s + v).by("r_regionkey").sack()
    low = F.lit((1 << 56) - 1)
    return t.frame().df.select(F.col("@n").bitwiseAND(low).cast("int").alias("n_nationkey"), F.col("_val").alias("total"))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 2")
def subgraph(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("supplier").has("s_nationkey", 2).out_e("supplies").subgraph().frame()
    return f.df.select(F.col("p_l_suppkey").alias("l_suppkey"), F.col("p_l_partkey").alias("l_partkey"))


# Branches --------------------------------------------------------------------------------------------------------------


@query("SELECT c_name AS value FROM customer WHERE c_nationkey = 6 UNION ALL SELECT n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 6")
def union(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("customer").has("c_nationkey", 6).union(__.values("c_name"), __.out("in_nation").values("n_name")).df()


@query("SELECT n_name AS value FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier)")
def union_dedup(spark, sf_dir):
    g = _g(spark, sf_dir)
    t = g.V().has_label("customer", "supplier").union(__.has("c_acctbal", P.gt(9000.0)), __.has_label("supplier")).out("in_nation").dedup().values("n_name")
    return t.df()


@query("SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), c_acctbal) AS v FROM customer")
def coalesce(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("customer").as_("c").coalesce(__.out("placed").has("o_orderstatus", "P").values("o_totalprice").max_(), __.values("c_acctbal"))
    return t.frame().df.select(F.col("@c").bitwiseAND(F.lit((1 << 56) - 1)).alias("c_custkey"), F.col("_val").alias("v"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def optional(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("customer").as_("c").optional(__.out("placed")).frame()
    low = F.lit((1 << 56) - 1)
    return f.df.select(F.col("@c").bitwiseAND(low).alias("c_custkey"), F.when(F.col("_id") != F.col("@c"), F.col("_id").bitwiseAND(low)).alias("o_orderkey"))


@query("SELECT CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS value, count(*) AS n FROM customer GROUP BY 1")
def choose(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("customer").choose(__.has("c_acctbal", P.gt(5000.0)), __.constant("rich"), __.values("c_mktsegment"))
    return t.df().groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS value, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def choose_option(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("order").choose("o_orderstatus").option("F", __.constant("done")).option("O", __.constant("open"))
    return t.df().groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def local_count(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("customer").as_("c").local(__.out("placed").count()).frame()
    return f.df.select(F.col("@c").bitwiseAND(F.lit((1 << 56) - 1)).alias("c_custkey"), F.col("_val").alias("n"))


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def repeat_times(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("supplier").repeat(__.out("in_nation", "in_region")).times(2).group_count().by("r_name")
    return _named(t, r_name="key", n="value")


@query("WITH RECURSIVE w(conv_id, turn, start) AS (SELECT conv_id, turn, turn FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, w.start FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1), l AS (SELECT conv_id, max(turn) AS last FROM w GROUP BY conv_id) SELECT conv_id, last FROM l")
def repeat_until(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("turn").has("turn", 0).until(__.not_(__.out("next"))).repeat(__.out("next"))
    f = t.frame().load()
    return f.df.select(F.col("p_conv_id").alias("conv_id"), F.col("p_turn").alias("last"))


@query("SELECT 'nation' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'region', count(*) FROM supplier")
def repeat_emit(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("supplier").repeat(__.out("in_nation", "in_region")).emit().label().df().groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT 'supplier' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'nation', count(*) FROM supplier UNION ALL SELECT 'region', count(*) FROM supplier")
def emit_repeat(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("supplier").emit().repeat(__.out("in_nation", "in_region")).times(2).label().df().groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT 2 AS value, count(*) AS n FROM supplier")
def loops_nested(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("supplier").repeat(__.repeat(__.out("in_nation", "in_region")).times(1)).times(2).loops()
    return t.df().groupBy("value").agg(F.count("*").alias("n"))


# Aggregates and order --------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def agg_count(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("order").has("o_orderpriority", "1-URGENT").count(), n="value")


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def agg_min_max(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("order").values("o_totalprice").df().agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'P'")
def agg_max_step(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("order").has("o_orderstatus", "P").values("o_totalprice").max_(), high="value")


@query("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def agg_sum_mean(spark, sf_dir):
    return _g(spark, sf_dir).E().has_label("contains").values("l_quantity").sum_().df().select(F.round("value", 2).alias("total"))


@query("SELECT round(avg(l_discount), 6) AS mean FROM lineitem")
def agg_mean_step(spark, sf_dir):
    return _g(spark, sf_dir).E().has_label("contains").values("l_discount").mean().df().select(F.round("value", 6).alias("mean"))


@query("SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by_sum(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("order").group().by("o_orderstatus").by(__.values("o_totalprice").sum_()).df()
    return d.select(F.col("key").alias("status"), F.round("value", 2).alias("total"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def group_count(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("part").group_count().by("p_type"), p_type="key", n="value")


@query("SELECT n_regionkey AS key, array_to_string(list_sort(list(n_name)), ',') AS nations FROM nation GROUP BY 1")
def fold(spark, sf_dir):
    d = _g(spark, sf_dir).V().has_label("nation").group().by("n_regionkey").by(__.values("n_name").fold()).df()
    return d.select("key", F.array_join("value", ",").alias("nations"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def dedup(spark, sf_dir):
    return _g(spark, sf_dir).V().has_label("customer").values("c_mktsegment").dedup().df()


@query("SELECT min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def dedup_by(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").dedup().by("c_mktsegment").values("c_custkey"), c_custkey="value")


@query("SELECT r_name FROM region WHERE r_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def aggregate_without(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    one = (g.number("nation") << 56) + 3
    f = g.traversal().V(one).out("in_region").aggregate("x").frame()
    t = g.traversal().V().has_label("region").frame()
    from dataclasses import replace

    from graphloom.plans.traversal import run

    t = run(replace(t, effects=f.effects), __.where(ref("without", "x")).values("r_name").steps)
    return t.df.select(F.col("_val").alias("r_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("order").order().by("o_totalprice", "desc").limit(10).frame()
    return f.df.select(F.col("p_o_orderkey").alias("o_orderkey"), F.col("p_o_totalprice").alias("o_totalprice"))


@query("SELECT p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 25")
def order_multi(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("part").order().by("p_brand").by("p_size", "desc").limit(25)
    return _named(t.values("p_partkey"), p_partkey="value")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
def range_step(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").order().by("c_acctbal").range_(20, 30).values("c_custkey"), c_custkey="value")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 3")
def tail(spark, sf_dir):
    return _named(_g(spark, sf_dir).V().has_label("customer").order().by("c_custkey").tail(3).values("c_custkey"), c_custkey="value")


@query("SELECT n_nationkey, c_custkey FROM (SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def local_topk(spark, sf_dir):
    f = _g(spark, sf_dir).V().has_label("nation").as_("n").local(__.in_("in_nation").has_label("customer").order().by("c_acctbal", "desc").limit(3)).frame()
    low = F.lit((1 << 56) - 1)
    return f.df.select(F.col("@n").bitwiseAND(low).cast("int").alias("n_nationkey"), F.col("_id").bitwiseAND(low).alias("c_custkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def intersect(spark, sf_dir):
    t = _g(spark, sf_dir).V().has_label("nation").and_(__.in_("in_nation").has_label("customer").has("c_acctbal", P.gt(9500.0)), __.in_("in_nation").has_label("supplier").has("s_acctbal", P.gt(5000.0)))
    return _named(t.values("n_nationkey"), n_nationkey="value")


@query("SELECT count(*) AS n FROM documents WHERE list_contains(" + _D + ", 'license')")
def index_totals(spark, sf_dir):
    n = trade_graph(spark, sf_dir).index_query("document", "v.text:license").totals()
    return spark.createDataFrame([(n,)], "n bigint")


_BM25 = f"""WITH d AS (SELECT doc_id, {_D} AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(t), 0)) AS mean FROM d),
h AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'apache')) AS b,
  len(list_filter(range(1, len(t)), lambda i: t[i] = 'general' AND t[i + 1] = 'public')) AS c FROM d),
f AS (SELECT count(*) FILTER (a > 0) AS a, count(*) FILTER (b > 0) AS b, count(*) FILTER (c > 0) AS c FROM h),
s AS (SELECT doc_id, ln(1 + (n - f.a + 0.5) / (f.a + 0.5)) * h.a * 2.2 / (h.a + 1.2 * (0.25 + 0.75 * l / mean))
  + ln(1 + (n - f.b + 0.5) / (f.b + 0.5)) * h.b * 2.2 / (h.b + 1.2 * (0.25 + 0.75 * l / mean))
  + ln(1 + (n - f.c + 0.5) / (f.c + 0.5)) * h.c * 2.2 / (h.c + 1.2 * (0.25 + 0.75 * l / mean)) AS score FROM h, f, n WHERE h.a + h.b + h.c > 0)
SELECT doc_id, round(score, 6) AS score FROM s"""


@query(_BM25)
def index_raw_query_score(spark, sf_dir):
    q = trade_graph(spark, sf_dir).index_query("document", 'v.text:(license apache) v.text:"general public"')
    return q.results().select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def composite_unique_check(spark, sf_dir):
    from graphloom.operators.index import IndexCatalog

    c = IndexCatalog(trade_graph(spark, sf_dir))
    c.build_index("by_brand", "composite", ("p_brand", "p_size"), "part", unique=True)
    return c.unique_violations("by_brand")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 7")
def composite_lookup(spark, sf_dir):
    from graphloom.operators.index import IndexCatalog

    g = trade_graph(spark, sf_dir)
    c = IndexCatalog(g)
    c.build_index("by_brand", "composite", ("p_brand", "p_size"), "part")
    c.update_index("by_brand", "REGISTER_INDEX")
    c.update_index("by_brand", "REINDEX")
    return c.lookup("by_brand", "Brand#12", 7).select(F.col("id").bitwiseAND(F.lit((1 << 56) - 1)).alias("p_partkey"))


# Geography (places made from keys) -------------------------------------------------------------------------------------

_LAT, _LON = "((c_custkey * 37) % 180 - 90)::DOUBLE", "((c_custkey * 91) % 360 - 180)::DOUBLE"


def _places(name: str, predicate: P, where: str | None) -> None:
    def run(spark, sf_dir):
        g = trade_graph(spark, sf_dir)
        k = F.col("c_custkey")
        g.vertices["customer"] = g.vertices["customer"].withColumn("place", geo.point_column((k * 37) % 180 - 90, (k * 91) % 360 - 180))
        return _named(g.traversal().V().has_label("customer").has("place", predicate).values("c_custkey"), c_custkey="value")

    run.__name__ = name
    query(f"SELECT c_custkey FROM (SELECT *, {_LAT} AS lat, {_LON} AS lon FROM customer) WHERE {where}" if where else None)(run)


def _km(lat: float, lon: float) -> str:
    h = f"pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2)"
    return f"2 * 6371.0087714 * asin(least(1.0, sqrt({h})))"


_places("geo_within_circle", geo.geo_within(geo.circle(20.0, 30.0, 2500.0)), f"{_km(20.0, 30.0)} <= 2500")
_places("geo_disjoint_circle", geo.geo_disjoint(geo.circle(20.0, 30.0, 9000.0)), f"NOT ({_km(20.0, 30.0)} <= 9000)")
_places("geo_within_box", geo.geo_within(geo.box(-10.0, -20.0, 40.0, 60.0)), "lat BETWEEN -10 AND 40 AND lon BETWEEN -20 AND 60")
_places("geo_intersect_polygon", geo.geo_intersect(geo.polygon((0.0, 0.0), (0.0, 50.5), (40.5, 0.0))), "lat >= 0 AND lon >= 0 AND lat / 40.5 + lon / 50.5 <= 1")
_places("geo_contains_point", geo.geo_contains(geo.point(-53.0, -89.0)), "lat = -53 AND lon = -89")


@query(f"SELECT c_custkey, round({_km(0.0, 0.0)}, 3) AS km FROM (SELECT *, {_LAT} AS lat, {_LON} AS lon FROM customer)")
def geo_distance(spark, sf_dir):
    c = trade_graph(spark, sf_dir).vertices["customer"]
    k = F.col("c_custkey")
    return c.select("c_custkey", F.round(geo.distance_km(((k * 37) % 180 - 90).cast("double"), ((k * 91) % 360 - 180).cast("double"), 0.0, 0.0), 3).alias("km"))


# Iterated algorithms ---------------------------------------------------------------------------------------------------


def _supply(spark, sf_dir):
    """Suppliers and parts, with supplies both ways: a strongly connected bipartite graph."""
    g = trade_graph(spark, sf_dir)
    v = g.vertices["supplier"].select("id").unionByName(g.vertices["part"].select("id"))
    e = g.edge_frame(["supplies"]).select("src", "dst")
    return g, v, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


_RANKS = "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), g AS (SELECT 's' || s AS src, 'p' || p AS dst FROM e UNION ALL SELECT 'p' || p, 's' || s FROM e), v AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), n AS (SELECT count(*)::DOUBLE AS n FROM v), d AS (SELECT src, count(*) AS d FROM g GROUP BY src), r0 AS (SELECT id, 1 / n AS r FROM v, n)"
for _i in range(1, 10):
    _RANKS += f", r{_i} AS (SELECT v.id, 0.15 / n.n + 0.85 * coalesce(m.r, 0) AS r FROM v CROSS JOIN n LEFT JOIN (SELECT g.dst, sum(p.r / d.d) AS r FROM g JOIN r{_i - 1} p ON p.id = g.src JOIN d ON d.src = g.src GROUP BY g.dst) m ON m.dst = v.id)"


@query(_RANKS + " SELECT substr(id, 2)::BIGINT AS s_suppkey, round(r, 9) AS rank FROM r9 WHERE id LIKE 's%'")
def pagerank(spark, sf_dir):
    g, v, e = _supply(spark, sf_dir)
    r = algorithms.pagerank(v, e)
    s = (g.number("supplier") << 56)
    return r.where(F.shiftright("id", 56) == g.number("supplier")).select((F.col("id") - s).alias("s_suppkey"), F.round("rank", 9).alias("rank"))


def _weighted(spark, sf_dir):
    """Suppliers and parts, each pair of lineitem both ways with its least quantity."""
    g = trade_graph(spark, sf_dir)
    v = g.vertices["supplier"].select("id").unionByName(g.vertices["part"].select("id"))
    e = g.edge_frame(["contains"]).select((F.col("l_suppkey") + F.lit(g.number("supplier") << 56)).alias("src"), "dst", F.col("l_quantity").alias("distance"))
    e = e.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return g, v, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))


#: The same edges in SQL, vertices as the ids that they have in the graph.
_S, _P = 4 << 56, 5 << 56
_PAIRS = f"e AS (SELECT l_suppkey + {_S} AS s, l_partkey + {_P} AS p, min(l_quantity) AS w FROM lineitem GROUP BY ALL), g AS (SELECT s AS src, p AS dst, w FROM e UNION ALL SELECT p, s, w FROM e)"
_NEAR = f"WITH {_PAIRS}, d0 AS (SELECT {_S + 1} AS id, 0.0::DOUBLE AS d)"
for _i in range(1, 5):
    _NEAR += f", d{_i} AS (SELECT id, min(d) AS d FROM (SELECT id, d FROM d{_i - 1} UNION ALL SELECT g.dst, d + w FROM d{_i - 1} JOIN g ON g.src = id) GROUP BY id)"


@query(_NEAR + " SELECT id::BIGINT AS id, d AS distance FROM d4")
def sssp_weighted(spark, sf_dir):
    """Least sums of quantities over at most four edges, from the first supplier."""
    g, v, e = _weighted(spark, sf_dir)
    return algorithms.shortest_distance(v, e, (g.number("supplier") << 56) + 1, max_depth=4).select("id", F.col("distance_to").alias("distance"))


_WAYS = f"WITH {_PAIRS}, f0 AS (SELECT {_S + 1} AS id, 0 AS hops, [{_S + 1}] AS path), r0 AS (SELECT * FROM f0)"
for _i in range(1, 4):
    _WAYS += f", f{_i} AS (SELECT dst AS id, {_i} AS hops, list_append(min(path), dst) AS path FROM f{_i - 1} JOIN g ON g.src = id WHERE dst NOT IN (SELECT id FROM r{_i - 1}) GROUP BY dst), r{_i} AS (SELECT * FROM r{_i - 1} UNION ALL SELECT * FROM f{_i})"


@query(_WAYS + " SELECT id::BIGINT AS id, hops, array_to_string(path, '>') AS path FROM r3")
def shortest_path(spark, sf_dir):
    """The paths themselves, of up to three edges; of equally short ones that with the smallest predecessors."""
    g, v, e = _weighted(spark, sf_dir)
    d = algorithms.shortest_paths(v, e, (g.number("supplier") << 56) + 1, max_distance=3)
    return d.select("id", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(_WAYS + f" SELECT id::BIGINT AS id, hops FROM r3 WHERE id < {_S + 6}")
def shortest_path_targets(spark, sf_dir):
    g, v, e = _weighted(spark, sf_dir)
    s = g.number("supplier") << 56
    return algorithms.shortest_paths(v, e, s + 1, target=F.col("id") < s + 6, max_distance=3).select("id", "hops")


@query(f"SELECT r_regionkey + {1 << 56} AS id, r_regionkey + {1 << 56} AS component FROM region UNION ALL SELECT n_nationkey + {2 << 56}, n_regionkey + {1 << 56} FROM nation UNION ALL SELECT c_custkey + {3 << 56}, n_regionkey + {1 << 56} FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT s_suppkey + {4 << 56}, n_regionkey + {1 << 56} FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def components(spark, sf_dir):
    """Regions, nations, customers and suppliers by where they are."""
    g = trade_graph(spark, sf_dir)
    v = g.vertex_frame(["region", "nation", "customer", "supplier"]).select("id")
    return algorithms.connected_components(v, g.edge_frame(["in_region", "in_nation"]).select("src", "dst"))


@query(f"WITH e AS (SELECT DISTINCT l_suppkey + {_S} AS s, l_partkey + {_P} AS p FROM lineitem), v AS (SELECT s_suppkey + {_S} AS id FROM supplier UNION ALL SELECT p_partkey + {_P} FROM part) SELECT id, (SELECT count(*) FROM e WHERE s = id) AS out_degree, (SELECT count(*) FROM e WHERE p = id) AS in_degree, (SELECT count(*) FROM e WHERE s = id OR p = id) AS degree FROM v")
def degree_in_out_both(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    v = g.vertex_frame(["supplier", "part"]).select("id")
    return algorithms.degrees(v, g.edge_frame(["supplies"])).select("id", "out_degree", "in_degree", "degree")


@query("SELECT c_custkey, count(l_partkey) AS walks FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def k_step_degree(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    v = g.vertex_frame(["customer", "order", "part"]).select("id")
    w = algorithms.k_step_degree(v, g.edge_frame(["placed", "contains"]), 2)
    return w.where(F.shiftright("id", 56) == g.number("customer")).select(F.col("id").bitwiseAND(F.lit((1 << 56) - 1)).alias("c_custkey"), "walks")


_CLUSTERS = f"WITH {_PAIRS}, v AS (SELECT s_suppkey + {_S} AS id FROM supplier UNION ALL SELECT p_partkey + {_P} FROM part), o AS (SELECT src, count(*) AS n FROM g GROUP BY src), c0 AS (SELECT id, id AS c FROM v)"
for _i in range(1, 4):
    _CLUSTERS += f", b{_i} AS (SELECT dst, c, row_number() OVER (PARTITION BY dst ORDER BY round(sum(1.0::DOUBLE / n), 9) DESC, c) AS r FROM g JOIN o USING (src) JOIN c{_i - 1} ON id = src GROUP BY dst, c), c{_i} AS (SELECT id, coalesce(b.c, p.c) AS c FROM c{_i - 1} p LEFT JOIN b{_i} b ON dst = id AND r = 1)"


@query(_CLUSTERS + " SELECT id, c AS cluster FROM c3")
def label_propagation(spark, sf_dir):
    """Three rounds of peer pressure among suppliers and parts."""
    g, v, e = _supply(spark, sf_dir)
    return algorithms.peer_pressure(v, e, iterations=3)


@query("SELECT c_nationkey AS key, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY c_nationkey")
def map_reduce(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    job = MapReduce((F.col("c_nationkey"), F.col("c_acctbal")), F.sum, sort=True)
    d = GraphComputer(g, ["customer"]).map_reduce("by_nation", job).submit().reduced["by_nation"]
    return d.select("key", F.round("value", 2).alias("value"))


@query("SELECT o_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def vertex_scan_job(spark, sf_dir):
    """A scan job that declares totals over each order's lines, and a callback over batches of orders."""
    from graphloom.operators.scan import VertexScan

    job = VertexScan(trade_graph(spark, sf_dir), ("order",)).totals("out", "contains", n=F.count("*"), returned=F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)))
    return job.process(_with_lines, "o_orderkey bigint, n bigint, returned bigint")


def _with_lines(batches):
    for pdf in batches:
        yield pdf[pdf["n"].notna()][["o_orderkey", "n", "returned"]].astype("int64")


# Changes and checks ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 3")
def ghost_edges(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    g.vertices["customer"] = g.vertices["customer"].where("c_nationkey >= 3")
    return mutate.ghost_edges(g, ["placed"]).select(F.col("eid").cast("bigint").alias("o_orderkey"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return mutate.uniqueness_violations(trade_graph(spark, sf_dir).vertices["part"], ["p_name"])


@query("SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def multiplicity_violations(spark, sf_dir):
    d = mutate.multiplicity_violations(trade_graph(spark, sf_dir), "placed", "MANY2ONE")
    return d.select(F.col("vertex").bitwiseAND(F.lit((1 << 56) - 1)).alias("c_custkey"), "n")


@query("SELECT 'order' AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'contains', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' UNION ALL SELECT 'placed', count(*) FROM orders WHERE o_orderstatus <> 'P'")
def drop_cascade(spark, sf_dir):
    g = _g(spark, sf_dir).V().has_label("order").has("o_orderstatus", "P").drop_from_graph()
    v = g.vertex_frame(["order"]).groupBy("label").agg(F.count("*").alias("n"))
    return v.unionByName(g.edge_frame(["contains", "placed"]).groupBy("label").agg(F.count("*").alias("n")))


@query("SELECT count(*) AS n, max(s_suppkey) AS top FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT 9000001) ")
def add_vertices(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    new = spark.createDataFrame([(9000001, "new")], "s_suppkey bigint, s_name string").withColumn("id", F.col("s_suppkey") + F.lit(g.number("supplier") << 56))
    h = g.with_changes(add_vertices={"supplier": new})
    return h.vertices["supplier"].agg(F.count("*").alias("n"), F.max("s_suppkey").alias("top"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE s_name END AS s_name FROM supplier")
def set_overwrite(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    rows = g.vertices["supplier"].where("s_suppkey % 2 = 0").select("id", F.lit("even").alias("value"))
    return g.with_changes(set_properties={"supplier": ("s_name", rows)}).vertices["supplier"].select("s_suppkey", "s_name")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 30 DAY <= (SELECT max(ts) FROM events)")
def ttl_expired(spark, sf_dir):
    e = trade_graph(spark, sf_dir).vertices["event"]
    now = e.agg(F.max("ts").alias("now"))
    return mutate.expired(e.crossJoin(F.broadcast(now)), F.col("ts"), 30 * 86400, F.col("now")).select("event_id")


def _events(spark, sf_dir):
    """The events table as a change log: signups add a vertex, purchases and clicks an edge, errors remove one, views set a property."""
    from graphloom.streaming.changes import ChangeLog

    def changes(d: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "vertex").when(F.col("event_type") == "view", "property").otherwise("edge")
        change = F.when(F.col("event_type") == "error", "REMOVED").otherwise("ADDED")
        return d.select(F.col("event_id").alias("tx"), "ts", kind.alias("kind"), change.alias("change"), F.col("user_id").alias("vertex"), F.col("event_type").alias("type"), F.col("event_id").alias("other"), "value")

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return ChangeLog(spark, "events", sf_dir, schema, changes, "events.parquet")


def _processed(spark, sf_dir, view) -> DataFrame:
    """Run a processor over the log as a stream, its batches kept in the shared folder, and read what it wrote."""
    import uuid

    from graphloom.lineage import new_path

    where = new_path(spark, "processed")
    log = _events(spark, sf_dir)
    log.processor(f"p{uuid.uuid4().hex}").set_retry_attempts(2).add_processor(lambda tx, state: view(state).write.mode("append").parquet(where)).run()
    return spark.read.parquet(where)


@query("SELECT CASE event_type WHEN 'error' THEN 'REMOVED' ELSE 'ADDED' END AS change, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def change_stream_counts(spark, sf_dir):
    return _processed(spark, sf_dir, lambda s: s.rows.select("change", "type")).groupBy("change", "type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase')")
def change_state_added(spark, sf_dir):
    return _processed(spark, sf_dir, lambda s: s.edges("ADDED").select(F.col("tx").alias("event_id"), F.col("vertex").alias("user_id")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def change_state_removed(spark, sf_dir):
    return _processed(spark, sf_dir, lambda s: s.relations("REMOVED").select(F.col("tx").alias("event_id"), F.col("vertex").alias("user_id")))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def change_windows(spark, sf_dir):
    from graphloom.streaming.changes import counts_by_window

    return counts_by_window(_events(spark, sf_dir).batch()).select("start", "type", "n")


# Exchange formats ------------------------------------------------------------------------------------------------------


@query(f"SELECT (n_nationkey + {2 << 56})::VARCHAR AS id, 'nation' AS kind, n_name AS name, n_regionkey::VARCHAR AS other FROM nation UNION ALL SELECT (r_regionkey + {1 << 56})::VARCHAR, 'region', r_name, NULL FROM region UNION ALL SELECT n_nationkey::VARCHAR, 'in_region', (n_nationkey + {2 << 56})::VARCHAR, (n_regionkey + {1 << 56})::VARCHAR FROM nation")
def graphson_roundtrip(spark, sf_dir):
    """Ids, labels, properties and ends as they come back."""
    from graphloom.graph import PropertyGraph
    from graphloom.lineage import new_path
    from graphloom.sources import graphson

    g = trade_graph(spark, sf_dir)
    small = PropertyGraph(spark, {x: g.vertices[x] for x in ("nation", "region")}, {"in_region": g.edges["in_region"]}, g.schema, {}, g.numbers)
    where = new_path(spark, "graphson")
    graphson.write_graphson(small, where)
    v, e = graphson.read_graphson(spark, where)
    p = F.col("properties")
    names = v.select("id", F.col("label").alias("kind"), F.coalesce(p["n_name"], p["r_name"])[0].alias("name"), p["n_regionkey"][0].alias("other"))
    return names.unionByName(e.select(F.col("eid").alias("id"), F.col("label").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("other")))


@query("SELECT * FROM (VALUES ('in_region', true, 'MANY2ONE'), ('in_nation', true, 'MANY2ONE'), ('placed', true, 'ONE2MANY'), ('contains', true, 'MULTI'), ('supplied_by', true, 'MULTI'), ('supplies', true, 'SIMPLE'), ('did', true, 'MULTI'), ('next', true, 'MULTI'), ('links', true, 'MULTI')) t(name, directed, multiplicity)")
def print_schema(spark, sf_dir):
    from graphloom.operators.index import print_schema as tables

    return tables(trade_graph(spark, sf_dir))["edge_labels"]


@query("SELECT * FROM (VALUES ('jupiter', 'sky'), ('neptune', 'sea')) t(god, place)")
def sample_graph_golden(spark, sf_dir):
    from graphloom.sources.samples import gods

    return gods(spark).traversal().V().has("name", "pluto").out("brother").as_("god").out("lives").as_("place").select("god", "place").by("name").df()
