"""Of all pages only those that need a repair are taken apart, and texts are hashed and cut no more than once."""

import random

import pytest
from pyspark.sql import functions as F

from strata.functions import html, text
from strata.operators import blocks, boilerplate, dedup
from strata.plans import pipeline


def made_pages(n=60):
    r = random.Random(7)
    pieces = ["<p>5 kW</p>", "<p>Power</p>", "<p>~ 9 mm</p>", "<p>Total Width</p>", "<p>Prose that is long enough to stay here, and to be known again.</p>", "<h2>Part of it</h2>", "<ul><li>12 km</li><li>Range</li></ul>", "<footer><h2>Legal</h2><p>All rights are reserved by us.</p></footer>", "<table><tr><td>7 %</td><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"]
    bodies = ["", "<p></p>", *("".join(r.choice(pieces) for _ in range(r.randint(0, 6))) for _ in range(n)), *("<h1>Own</h1><p>Plain prose of a page, long enough to be kept.</p>" for _ in range(n))]
    return [(f"http://h.example/{k}", f"http://h.example/{k}", f"<body>{b}</body>", True) for k, b in enumerate(bodies)]


def test_only_broken_pages_are_taken_apart(spark, monkeypatch):
    df = spark.createDataFrame(made_pages(), "url string, final_url string, html string, ok boolean")
    parsed = html.read_pages(df.select("url", "final_url", "html"), "final_url", ("sequence", "markdown"))
    whole = blocks.pair_stat_cards(blocks.inject_headings(parsed, "url", "sequence", "markdown"), "url", "text")
    expected = {r["url"]: r["m"] for r in whole.select("url", text.strip(F.col("text")).alias("m")).collect()}
    taken, pair = [], blocks.pair_stat_cards
    monkeypatch.setattr(blocks, "pair_stat_cards", lambda df, *a: taken.append(df.count()) or pair(df, *a))
    got = {r["url"]: r["markdown"] for r in pipeline.extract_pages(df).collect()}
    assert got == expected
    assert 10 < taken[0] <= 62 < len(expected)


def test_lists_of_odd_lines_are_told_as_the_repairs_do(spark):
    r = random.Random(8)
    lines = ["5 kW", " \u00a0≈ 7 mm", "Power", "", " ", "\u2003", "A sentence of prose that ends here.", "x 5 kW", "٣ km", "# Head"]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(0, 8)))) for k in range(400)]
    df = spark.createDataFrame([*rows, (400, None)], "id int, md string")
    plain = F.coalesce(F.array_join(text.blocks(F.col("md")), "\n\n"), F.lit(""))
    both = blocks.pair_stat_cards(df, "id", "md").join(df.select("id", plain.alias("plain"), blocks.may_hold_cards(F.col("md")).alias("may")), "id").collect()
    assert len(both) == 401 and all(x["may"] or x["text"] == x["plain"] for x in both)
    assert any(x["text"] != x["plain"] for x in both) and not all(x["may"] for x in both)


def test_strip_and_top_lines_equal_python(spark):
    r = random.Random(9)
    letters = [*text.SPACES, *"ab\u0107\u0663\u200b\x1f", *["\r\n", "\n", " "] * 4]
    rows = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select("t", text.strip(F.col("t")).alias("s"), text.top_lines(F.col("t")).alias("top")).collect()
    assert all(x["s"] == x["t"].strip() and x["top"] == [y.strip() for y in x["t"].splitlines() if y.strip()][:3] for x in got)


def test_lines_of_a_page_are_cut_once(spark):
    df = spark.createDataFrame([("s", "a\nb")], "site string, body string")
    plan = boilerplate.boilerplate_lines(df, "site", "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


@pytest.mark.parametrize("near", [True, False])
def test_a_hash_that_is_there_is_taken(spark, near):
    texts = ["A b c d e f", "a, B c d e f!", "a b c d e g", "", "x y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("o", F.col("id")).withColumn("h", text.content_hash(F.col("t")))
    kept = lambda **more: sorted(r["id"] for r in dedup.dedup_text(df, "id", "t", "o", near, **more).collect())
    assert kept(hashed="h") == kept() == [0, 2, 3, 4]
