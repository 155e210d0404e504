"""The scalar functions as SQL functions of a session (2.13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phonetic as P


def register(spark: SparkSession, rules: list[tuple[int, str, str, int]] | None = None) -> None:
    """translit(w), phonetic_key(w), script_code(w), edit_cost(pattern, w), match_length(pattern, w) and
    edit_cost_lang(a, b, lang).

    ``rules`` is the cost table (lang, from, to, cost) of edit_cost_lang. Keys and
    script codes are SQL expressions, so they stay inside the engine's code.
    """
    for name, kind, body in (("phonetic_key", "STRING", P.phonetic_key_sql("w")), ("script_code", "INT", P.script_code_sql("w"))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS {kind} RETURN {body}")

    @F.pandas_udf(T.StringType())
    def translit(w: pd.Series) -> pd.Series:
        return w.map(lambda x: None if x is None else P.translit(x))

    def costs(a: pd.Series, b: pd.Series):
        return P.edit_costs([P.translit(x or "") for x in a], [P.translit(x or "") for x in b])

    @F.pandas_udf(T.LongType())
    def edit_cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(costs(a, b)[0])

    @F.pandas_udf(T.LongType())
    def match_length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(costs(a, b)[1])

    table = list(rules or [])

    @F.pandas_udf(T.LongType())
    def edit_cost_lang(a: pd.Series, b: pd.Series, lang: pd.Series) -> pd.Series:
        out = pd.Series(0, index=a.index, dtype="int64")
        for g, part in lang.groupby(lang):
            out[part.index] = P.edit_costs_lang([x or "" for x in a[part.index]], [y or "" for y in b[part.index]], P.cost_rules(table, g))[0]
        return out

    for f in (translit, edit_cost, match_length, edit_cost_lang):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
