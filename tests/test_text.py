"""Tokenizer (E1) and query escaping (F-Q1)."""
from pyspark.sql import functions as F

from quarry.functions.text import match_expression, python_tokens, tokens


def test_tokens_fold_and_split(spark):
    text = "Crème BRÛLÉE_x ß ﬁne 12ab 日本 naïve"
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["creme", "brulee", "x", "ß", "ﬁne", "12ab", "日本", "naive"]
    assert python_tokens(text) == got


def test_query_words_are_quoted_and_the_last_is_a_prefix(spark):
    cases = [("Rain; then sun.", '"Rain" "then" "sun"*'), ("room101", '"room101"*'),
             ('"quoted phrase" with "more quotes"', '"quoted" "phrase" "with" "more" "quotes"*'),
             ("near NOT far or OR", '"near" "NOT" "far" "or" "OR"*'),
             ("stars ** and * marks *", '"stars" "and" "marks"*'), ("garçon", '"gar" "on"*')]
    df = spark.createDataFrame(cases, "q string, want string")
    rows = df.select(match_expression(F.col("q")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows), rows


def test_terms_of_a_text_are_counted_without_an_exchange_of_tokens(spark):
    from collections import Counter

    from quarry.operators.index import term_counts
    rows = [(1, "Crème creme CREME, ash"), (2, "plain ASCII plain"), (2, "Plain ê"), (3, None), (None, "x y"), (None, "X"), (4, " ,; ")]
    want = Counter((i, t) for i, text in rows for t in python_tokens(text or ""))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.tf for r in term_counts(docs).collect()}
    assert got == dict(want) and got[1, "creme"] == 3 and got[2, "plain"] == 3 and got[None, "x"] == 2
    alone = term_counts(docs.where("doc_id <> 2"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.term): r.tf for r in alone.collect()} == {k: n for k, n in want.items() if k[0] not in (2, None)}
