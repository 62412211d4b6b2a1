"""Pages are read once for all uses of a field, a few at a time, for the fields wanted alone."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions import html
from strata.plans import catalog, pipeline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_read_once_and_alone(spark, sf_dir):
    df = catalog.QUERIES["parsed_links"](spark, sf_dir)
    assert sum(line.lstrip("+- *:").split("(")[0].split(" ")[0].startswith("ArrowEvalPython") for line in plan(df).splitlines()) == 1
    assert "surrounding_text" not in plan(df) and "body_text" not in plan(df)


def test_sequences_are_read_alone(spark, sf_dir):
    assert "surrounding_text" not in plan(catalog.QUERIES["dom_sequence_sections"](spark, sf_dir))
    rows = spark.createDataFrame([("<h1>a</h1><p>b",)], "h string")
    assert rows.select(html.parse_page("h", only=("sequence", "lang")).alias("p")).select("p.*").columns == ["sequence", "lang"]


def test_pages_are_read_few_at_a_time_in_order(spark):
    pages = [None, "", "<p>a</p>", *(f"<html lang='l{k}'><body><h2>t{k}</h2><p>x{k} <a href='/{k}'>y</a><img src='{k}.png'>" for k in range(2 * html.PAGES_AT_ONCE + 1))]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, h string").coalesce(1)
    got = df.select("k", html.parse_page("h", F.lit("http://h/")).alias("p")).orderBy("k").collect()
    assert [r["p"].asDict(recursive=True) for r in got] == [html.read_page(p, "http://h/") for p in pages]
    alone = df.select("k", html.parse_page("h", F.lit("http://h/"), only=("markdown",)).alias("p")).orderBy("k").collect()
    assert [r["p"].asDict() for r in alone] == [{"markdown": html.read_page(p, "http://h/")["markdown"]} for p in pages]


def readers(spark, monkeypatch, run):
    """The functions given to mapInArrow while `run` runs."""
    found, frame = [], type(spark.range(1))
    as_it_was = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: found.append(f) or as_it_was(self, f, *a, **b))
    run()
    return found


@pytest.mark.parametrize("step", ["heading_injection", "extract_pages"])
def test_results_are_given_on_few_pages_at_a_time(spark, sf_dir, monkeypatch, step):
    pages = [None, "", *(f"<body><h2>t{k}</h2><p>x{k} <a href='/{k}'>y</a><div id='root'>" for k in range(2 * html.PAGES_AT_ONCE + 1))]
    n = len(pages)
    df = spark.createDataFrame([(f"http://h/{k}", f"http://h/{k}", p, True) for k, p in enumerate(pages)], "url string, final_url string, html string, ok boolean")
    run = {"heading_injection": lambda: catalog.QUERIES["heading_injection"](spark, sf_dir), "extract_pages": lambda: pipeline.extract_pages(df)}[step]
    read = readers(spark, monkeypatch, run)[0]
    batch = pa.record_batch({"page_id": range(n), "url": [f"u{k}" for k in range(n)], "final_url": [f"http://h/{k}" for k in range(n)], "html": pages})
    batch = batch.select(["page_id", "html"] if step == "heading_injection" else ["url", "final_url", "html"])
    out = list(read([batch]))
    assert max(b.num_rows for b in out) <= html.PAGES_AT_ONCE and sum(b.num_rows for b in out) == n
    rows = [r for b in out for r in b.to_pylist()]
    base = "http://h/{}".format if step == "extract_pages" else lambda k: None
    assert [r["markdown"] for r in rows] == [html.read_page(p, base(k))["markdown"] for k, p in enumerate(pages)]
    assert [r["sequence"] for r in rows] == [html.read_page(p)["sequence"] for p in pages]


def test_shells_are_told_from_the_fields_read(spark):
    pages = ["<body><p>a</p><div id='root'></div>", "<body><p>a</p>", "<div id='root'></div>"]
    df = spark.createDataFrame([(f"http://h/{k}", f"http://h/{k}", p, True) for k, p in enumerate(pages)], "url string, final_url string, html string, ok boolean")
    assert [r["spa"] for r in pipeline.extract_pages(df).orderBy("url").collect()] == [True, False, False]
