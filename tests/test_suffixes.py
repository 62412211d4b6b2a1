"""Registered domains by public suffix rules."""

import random

import pytest
from pyspark.sql import functions as F

from strata.functions import urls
from strata.functions.suffixes import SuffixRules, default_rules, parsed, shipped_list

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "io", "github.io", "*.compute.example", "jp", "*.kobe.jp", "!city.kobe.jp", "公司.cn", "cn"]


def naive(host, rules):
    """The longest rule wins, exceptions before all."""
    labels = host.split(".")
    best = 1
    for k in range(1, len(labels) + 1):
        end = labels[-k:]
        if "!" + ".".join(end) in rules:
            return ".".join(end)
        if ".".join(end) in rules or ".".join(["*", *end[1:]]) in rules and k > 1:
            best = k
    return ".".join(labels[-best - 1 :])


def domains(spark, hosts, rules):
    rows = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "i int, u string")
    return [r[0] for r in rows.select(urls.registered_domain(F.col("u"), rules), "i").orderBy("i").collect()]


def test_wildcards_and_exceptions(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.uk", "x.y.ck", "y.ck", "a.www.ck", "www.ck", "ck", "me.github.io", "a.me.github.io", "github.io", "a.b.c.compute.example", "www.city.kobe.jp", "a.b.kobe.jp", "a.unknown", "unknown", "a.公司.cn", "a.xn--55qx5d.cn", "b.a.xn--55qx5d.cn.", "10.1.2.3"]
    got = domains(spark, hosts, SuffixRules(RULES))
    assert got == ["b.co.uk", "co.uk", "b.uk", "x.y.ck", "y.ck", "www.ck", "www.ck", "ck", "me.github.io", "me.github.io", "github.io", "b.c.compute.example", "city.kobe.jp", "a.b.kobe.jp", "a.unknown", "unknown", "a.公司.cn", "a.xn--55qx5d.cn", "a.xn--55qx5d.cn", "10.1.2.3"]


def test_random_hosts_equal_the_longest_rule(spark):
    r = random.Random(4)
    labels = ["a", "b", "c", "d"]
    rules = {".".join(r.choice(labels) for _ in range(r.randint(1, 3))) for _ in range(12)} | {"*." + ".".join(r.choice(labels) for _ in range(r.randint(1, 2))) for _ in range(5)}
    rules |= {"!" + w.replace("*", r.choice(labels)) for w in rules if w.startswith("*")}
    hosts = [".".join(r.choice(labels) for _ in range(r.randint(1, 6))) for _ in range(300)]
    assert domains(spark, hosts, SuffixRules(rules)) == [naive(h, rules) for h in hosts]


def test_rules_of_tables_and_files(spark, tmp_path):
    text = "// note\n\ncom\n*.ck  and more\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n// ===END PRIVATE DOMAINS===\nuk\n"
    assert parsed(text) == ["com", "*.ck", "!www.ck", "uk"] and parsed(text, True) == ["com", "*.ck", "!www.ck", "github.io", "uk"]
    (tmp_path / "list.dat").write_text(text)
    spark.createDataFrame([(x,) for x in parsed(text, True)] + [(None,)], "rule string").write.parquet(f"{tmp_path}/rules")
    for rules in (SuffixRules.read(spark, f"{tmp_path}/list.dat", True), SuffixRules.read(spark, f"{tmp_path}/rules")):
        assert domains(spark, ["x.y.ck", "a.www.ck", "b.a.github.io"], rules) == ["x.y.ck", "www.ck", "a.github.io"]


def test_the_shipped_list(spark):
    if shipped_list() is None:
        pytest.skip("this Spark has no list")
    got = domains(spark, ["www.shop.co.uk", "a.b.city.kawasaki.jp", "a.b.kawasaki.jp", "x.github.io", "a.b.example.com"], default_rules())
    assert got == ["shop.co.uk", "city.kawasaki.jp", "a.b.kawasaki.jp", "github.io", "example.com"]
    private = SuffixRules(parsed(shipped_list(), private=True))
    assert domains(spark, ["a.x.github.io"], private) == ["x.github.io"]


def test_rules_are_one_literal_of_the_plan(spark):
    plan = spark.range(1).select(urls.registered_domain(F.concat(F.lit("http://a/"), "id"), SuffixRules(["co.uk", "uk"])).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split( co.uk" not in plan and "[ co.uk uk" in plan
