"""Driver contract: entry() runs; every query has a DataFrame; oracle keys are a subset; twins agree on a few."""
import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert rows and all(r.rank < 0 and 1 <= r.rn <= 10 and r.total >= 1 for r in rows)


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80


@pytest.mark.parametrize("name", ["tokenize_corpus", "orphans", "claim_batch", "url_levels", "script_code", "page_fields", "knn_cosine"])
def test_twins_agree_on_the_smallest_data(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    want = sorted(str(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall())
    assert got == want and got
