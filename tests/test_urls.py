import pytest
from pyspark.sql import functions as F

from strata.functions import urls


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.select(make(F.col("u")), "i").orderBy("i").collect()]


def test_normalize_drops_query_fragment_and_slashes(spark):
    got = column(spark, ["http://h.example/a/b/?x=1#y", "https://h.example:8080", "http://H.example/%20//", None], urls.normalize)
    assert got == ["http://h.example/a/b", "https://h.example:8080/", "http://H.example/%20", None]


def test_netloc_keeps_port_and_site_dir_replaces_it(spark):
    assert column(spark, ["http://h.example:81/x"], urls.netloc) == ["h.example:81"]
    assert column(spark, ["http://h.example:81/x"], urls.site_dir) == ["h.example_81"]
    assert column(spark, ["http://h.example:81/x?y"], urls.robots_url) == ["http://h.example:81/robots.txt"]


def test_registered_domain(spark):
    got = column(spark, ["http://a.b.example.com/", "http://www.shop.co.uk:80/x", "http://user@x.example.org/"], urls.registered_domain)
    assert got == ["example.com", "shop.co.uk", "example.org"]


@pytest.mark.parametrize(
    ("url", "include", "exclude", "expected"),
    [
        ("https://x.example/cookies-policy", [], ["*/cookies*"], False),
        ("https://x.example/cars/one", [], ["*/cookies*"], True),
        ("https://x.example/cars/one", ["*/blog/*"], [], False),
        ("https://x.example/blog/one", ["*/blog/*"], [], True),
        ("https://x.example/blog/login", ["*/blog/*"], ["*/login*"], False),
        ("https://x.example/a?q=/login", [], ["/a"], False),
        ("https://x.example/page7", ["*/page[0-9]"], [], True),
    ],
)
def test_scope(spark, url, include, exclude, expected):
    assert column(spark, [url], lambda u: urls.in_scope(u, include, exclude)) == [expected]


def test_resolve_and_join(spark):
    base = "http://h.example/dir/page?q#f"
    rows = [("x", "http://h.example/dir/x"), ("/y#z", "http://h.example/y"), ("//o.example/a", "http://o.example/a"), ("https://o.example/", "https://o.example/"), ("?k=1", "http://h.example/dir/page?k=1"), ("#top", "http://h.example/dir/page?q"), ("mailto:a@b", "mailto:a@b")]
    df = spark.createDataFrame([(base, h, e) for h, e in rows], "b string, h string, e string")
    for r in df.select("h", "e", urls.resolve(F.col("b"), F.col("h")).alias("n"), urls.join_urls("b", "h").alias("p")).collect():
        assert (r["n"], r["p"]) == (r["e"], r["e"]), r["h"]
    assert spark.range(1).select(urls.join_urls(F.lit(base), F.lit("../up"))).first()[0] == "http://h.example/up"


def test_slug(spark):
    df = spark.createDataFrame([("http://h/A b/C.html", "t"), ("http://h/", "My Title!"), ("http://h/", None), ("http://h/" + "x" * 100, ""), ("http://h/--/", "t")], "u string, t string")
    assert [r[0] for r in df.select(urls.slug(F.col("u"), F.col("t"))).collect()] == ["a-b-c-html", "my-title", "index", "x" * 80, "index"]


def test_dot_segments_are_worked_out_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h.example/dir/sub/page?q", "http://h.example/", "http://h.example", "https://h.example:8080/a/b/"]
    hrefs = ["../up", "./x", "../../../top?y=../z", "..", ".", "./", "a/./b/../c", "/x/../y", "x/..", "..x/y", "?k=../1", "#../f", "../a#b"]
    df = spark.createDataFrame([(b, h, urljoin(b, h).split("#")[0]) for b in bases for h in hrefs], "b string, h string, e string")
    for r in df.select("b", "h", "e", urls.resolve(F.col("b"), F.col("h")).alias("n")).collect():
        assert r["n"] == r["e"], (r["b"], r["h"])


def test_registered_domain_of_countries_and_addresses(spark):
    got = column(spark, ["http://shop.com.sg/", "http://a.b.org.br/x", "http://10.0.0.1:80/", "http://me.example/", "http://x.github.io/"], urls.registered_domain)
    assert got == ["shop.com.sg", "b.org.br", "10.0.0.1", "me.example", "github.io"]


def test_slug_without_accents(spark):
    assert column(spark, ["http://h/Größe/Éléphant œuvre/Łódź"], lambda u: urls.slug(u, F.lit(""))) == ["grosse-elephant-oeuvre-lodz"]


def test_slug_of_other_scripts(spark):
    urls_and_slugs = {"http://h/Новости/Щука-и-Ёж": "novosti-shchuka-i-ezh", "http://h/Ελληνικά/Ψυχή ΘΕΟΣ": "ellenika-psukhe-theos", "http://h/Київ Объём": "kiiv-obem", "http://h/日本": "index", "http://h/Ђорђе": "djordje"}
    assert column(spark, [*urls_and_slugs], lambda u: urls.slug(u, F.lit(""))) == [*urls_and_slugs.values()]
    letters = [c for c in map(chr, range(0x370, 0x460)) if c in urls.IN_LATIN]
    assert len(letters) > 80 and all(s.isascii() and s.isalpha() for s in urls.IN_LATIN.values())
