"""Registered SQL functions, named stream folders that resume, sinks by source."""
from pyspark.sql import functions as F

from quarry.functions import phonetic as P
from quarry.functions.registered import register
from quarry.operators import chunks as ch
from quarry.sources import tables as tb
from quarry.streaming import jobs


def test_sql_functions(spark):
    register(spark, [(1, "ph", "f", 10)])
    r = spark.sql("SELECT translit('café') a, edit_cost('bat', 'bad') b, match_length('wa*', 'water') c, "
                  "edit_cost_lang('phone', 'fone', 1) d, edit_cost_lang('phone', 'fone', 2) e").first()
    assert (r.a, r.b, r.d) == ("cafe", 40, 10) and r.c == 2 and r.e == 250
    words = spark.createDataFrame([(w,) for w in ("gnome", "wrist", "o'hara", "'yes", "b2--c", "a b", "", "Привет", "αβ", "12", "x¡", "hЖ", None)], "w string")
    words.createOrReplaceTempView("some_words")
    got = spark.sql("SELECT w, phonetic_key(w) k, script_code(w) c FROM some_words").collect()
    want = words.select("w", P.phonetic_key(F.col("w")).alias("k"), P.script_code(F.col("w")).alias("c")).collect()
    assert got == want and got[0].k == "MAMA"


def test_a_named_stream_resumes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "One two."), (2, " ")], "doc_id long, text string").write.parquet(src)
    stream = lambda: jobs.embedding(spark.readStream.schema("doc_id long, text string").parquet(src), ch.hashing_embedder)
    first = sorted(r.page for r in jobs.run_available(stream(), "e", out=out).collect())
    spark.createDataFrame([(3, "Three.")], "doc_id long, text string").write.mode("append").parquet(src)
    again = sorted(r.page for r in jobs.run_available(stream(), "e", out=out).collect())
    assert first == [1] and again == [1, 3]  # what was embedded before is neither lost nor done twice
    assert sorted(r.page for r in jobs.run_available(stream(), "e", out=out).collect()) == again


def test_source_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c")], "id long, source string")
    assert tb.write_by_source(df, str(tmp_path / "t")).count() == 3
    assert tb.drop_source(spark, str(tmp_path / "t"), "c") and not tb.drop_source(spark, str(tmp_path / "t"), "zz")
    assert [r.id for r in spark.read.schema("id long, source string").parquet(str(tmp_path / "t")).collect()] == [1]
    bad = tb.invalid_sources(spark.createDataFrame([("ok_1",), ("no no",), (None,), ("twice",), ("twice",)], "id string"))
    assert sorted(str(r.id) for r in bad.collect()) == ["None", "no no", "twice", "twice"]


def test_scratch_is_cleared_from_a_mark(spark):
    from quarry.session import clear_scratch, pin, scratch_mark
    kept = pin(spark.range(3))
    mark = scratch_mark(spark)
    gone = pin(spark.range(4))
    assert gone.count() == 4 and scratch_mark(spark) == mark + 1
    clear_scratch(spark, mark)
    assert kept.count() == 3 and scratch_mark(spark) == mark
