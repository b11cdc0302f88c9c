"""Registered queries against their SQL where memories share an id and a question names many names."""

import duckdb
import pytest

from remora import registry

from .test_queries import TABLES, plain


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    """The smallest tables: documents again under ids that are 365 apart, which gives the same memory_id."""
    to = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        rows = f"SELECT * FROM '{sf}/{t}.parquet'"
        if t == "documents":
            rows += f" UNION ALL SELECT d.* REPLACE (doc_id + 365 * k AS doc_id) FROM '{sf}/{t}.parquet' d, range(1000, 1003) r(k) WHERE doc_id % 3 = 0 AND (k = 1000 OR doc_id % 2 = 0)"
        if t == "benchmark":
            rows = f"SELECT * REPLACE (CASE WHEN item_id % 2 = 1 THEN (SELECT string_agg(n, ' and ') FROM (SELECT DISTINCT regexp_extract(text, '\\b[A-Z][a-z]{{2,}}\\b') AS n FROM '{sf}/documents.parquet' ORDER BY n LIMIT 40)) || ' ' || text ELSE text END AS text) FROM '{sf}/{t}.parquet'"
        con.execute(f"COPY ({rows}) TO '{to}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet'")
    return str(to), con


@pytest.mark.parametrize("name", ["index_build", "bm25_search", "cross_lang_demo", "lexical_route", "index_counts", "join_raw_meta_mem", "seed_union", "reach", "entity_route", "rrf", "gold_semi", "budget_clip", "recency_blend", "search_api", "neighbours", "expand_hits", "retrieve_e2e", "delivery_size"])
def test_query_equals_sql_with_copies(spark, copies, name):
    folder, duck = copies
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert got and got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())
