"""Pages of more text than any byte budget are extracted whole unless a budget is given."""
import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as ex


@pytest.mark.parametrize("run", [ex.extract_pages, ex.fetched])
def test_a_long_page_is_whole(spark, run):
    text = " ".join(f"wörd{i}" for i in range(40_000)) + " theend"
    raw = spark.createDataFrame([(1, "https://site.com/p", f"<html><head><title>T</title></head><body><p>{text}</p></body></html>", "text/html", None)],
                                "page_id long, url string, html string, content_type string, fetch_error string")
    got = run(raw).first().content
    assert len(text.encode()) > 200_000 and got.split() == text.split()
    cut = run(raw, 1000).select(F.sum(F.octet_length("title") + F.octet_length("content"))).first()[0]
    assert 990 < cut <= 1000


def test_fields_of_a_batch_are_made_a_few_pages_at_a_time(monkeypatch):
    import pyarrow as pa
    made = []
    array = pa.array
    monkeypatch.setattr(ex.pa, "array", lambda rows, *a: made.append(len(rows)) or array(rows, *a))
    html = pa.concat_arrays([array([f"<title>t{i}</title><a href=/{i}>x</a>" for i in range(70)] + [None], pa.string())])
    got = ex._parse(html).to_pylist()
    assert max(made) <= ex.PARSE_PAGES and got == [ex.parse_page(h) for h in html.to_pylist()]
    assert len(ex._parse(array([], pa.string()))) == 0
