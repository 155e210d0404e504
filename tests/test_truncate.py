"""Byte budget (B9): against a plain spender of bytes, and cuts inside multi-byte characters."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators.extract import truncate_bytes


def spend(budget, items):
    out = []
    for it in items:
        raw = it.encode()
        out.append(it if len(raw) <= budget else raw[:budget].decode(errors="ignore") if budget > 0 else "")
        budget = budget - len(raw) if len(raw) <= budget else 0
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.lists(st.text(alphabet="ab é日𝄞", max_size=6), min_size=3, max_size=3)), min_size=1, max_size=20))
def test_budget_is_spent_in_order(spark, rows):
    df = spark.createDataFrame([(i, b, *t) for i, (b, t) in enumerate(rows)], "i int, b int, c0 string, c1 string, c2 string")
    cols = truncate_bytes([F.col("c0"), F.col("c1"), F.col("c2")], F.col("b"))
    got = df.select("i", *[c.alias(f"o{k}") for k, c in enumerate(cols)]).sort("i").collect()
    assert [list(r)[1:] for r in got] == [spend(b, t) for b, t in rows]


def test_nulls_are_empty(spark):
    df = spark.createDataFrame([(None, "xyz")], "a string, b string")
    assert list(df.select(*truncate_bytes([F.col("a"), F.col("b")], F.lit(2))).first()) == ["", "xy"]
