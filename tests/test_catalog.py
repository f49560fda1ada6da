"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from graphloom.plans import catalog, catalog_engine  # noqa: F401

SF = "/root/testdata/sf0.001"
#: A share of the catalogue; the driver compares all of it.
NAMES = ["flagship", "property_scan", "has_connective_nested", "graph_or_branch_limits", "text_contains_phrase", "text_fuzzy", "both", "other_v", "vertex_query_topk", "match_triangle", "where_and_or", "as_select_by", "coalesce", "optional", "local_topk", "repeat_until", "group_by_sum", "order_multi", "geo_within_circle", "sssp_weighted", "ghost_edges", "drop_cascade", "change_state_added", "graphson_roundtrip", "id_step", "properties_meta_filter", "repeat_do_while", "aggregate_cap", "mixed_query_words", "index_aggregates", "index_intersection", "vertex_centric_lookup", "index_lifecycle", "index_repair_jobs", "index_raw_query_score", "global_scope", "computer_result_modes", "label_propagation", "shortest_path", "scan_counters", "remove_ghosts", "schema_enforced", "ttl_by_schema", "transaction_view", "change_resume", "change_retries", "geo_shapes_within"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    plain = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


def test_every_query_is_callable():
    assert len(catalog.QUERIES) > 180 and set(catalog.SQL) <= set(catalog.QUERIES)
