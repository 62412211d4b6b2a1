"""Public suffixes: rules under which names are registered, and the lookup of a host's registered domain.

Rules are written as public lists write them: `co.uk` is a suffix, `*.ck` makes every label under
`ck` one, `!www.ck` takes an exception out. They come from a table, a file in the public format, or
the list that Spark's own HTTP client ships. The longest rule that a host ends with holds; without
any, the last label is the suffix.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterable
from functools import lru_cache
from itertools import product
from pathlib import Path
from string import ascii_lowercase
from zlib import crc32

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where Spark's HTTP client keeps the public list.
SHIPPED = ("httpclient-*.jar", "mozilla/public-suffix-list.txt")
#: Rules that a table may have: they become one literal of each plan that uses them.
MOST_RULES = 50_000
#: Under a country's label these are suffixes, not names that a site registers; used where no list is found.
SECOND_LABELS = ("ac", "co", "com", "edu", "ed", "gob", "gov", "go", "gouv", "gv", "ltd", "mil", "me", "net", "ne", "nom", "or", "org", "plc", "sch")


def parsed(text: str, private: bool = False) -> list[str]:
    """Rules of a list in the public format: one a line up to the first blank, comments after //; those of private owners only if asked for."""
    rules, owner = [], True
    for line in text.splitlines():
        if "BEGIN PRIVATE DOMAINS" in line:
            owner = private
        elif "END PRIVATE DOMAINS" in line:
            owner = True
        elif owner and (rule := line.split("//")[0].strip()):
            rules.append(rule.split()[0])
    return rules


class SuffixRules:
    """Rules as a hash table in one literal: a suffix is looked for in the bucket of its checksum, whatever the number of rules."""

    def __init__(self, rules: Iterable[str]):
        known = {r.strip().strip(".").lower() for r in rules}
        self.rules = frozenset(filter(None, known | {_ascii(r) for r in known}))
        self.buckets = max(1, len(self.rules))
        table: list[list[str]] = [[] for _ in range(self.buckets)]
        for r in sorted(self.rules):
            table[crc32(r.encode()) % self.buckets].append(r)
        self._table = "\n".join("".join(f" {r}" for r in bucket) + " " for bucket in table)

    @classmethod
    def of_table(cls, rules: DataFrame) -> SuffixRules:
        """Rules of the column `rule`."""
        rows = rules.select("rule").where("rule IS NOT NULL").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} suffix rules")
        return cls(r["rule"] for r in rows)

    @classmethod
    def read(cls, spark: SparkSession, path: str, private: bool = False) -> SuffixRules:
        """Rules of a Parquet table with a column `rule`, or of a file in the public format."""
        if path.endswith((".txt", ".dat")):
            return cls(parsed("\n".join(r[0] for r in spark.read.text(path).orderBy(F.monotonically_increasing_id()).collect()), private))
        return cls.of_table(spark.read.parquet(path))

    def holds(self, rule: Column) -> Column:
        """True if there is such a rule."""
        table = F.split(F.lit(self._table), "\n", -1)  # of a literal, so it is split once
        bucket = F.get(table, F.pmod(F.crc32(F.encode(rule, "UTF-8")), F.lit(self.buckets)).cast("int"))
        return F.contains(bucket, F.concat(F.lit(" "), rule, F.lit(" ")))

    def registered(self, host: Column) -> Column:
        """The public suffix of a lower-case host and one label more; hosts that are suffixes, and addresses, are whole."""
        labels = F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")
        # Ends of the host, the longest first. What lambdas are given is worked out once.
        ends = F.aggregate(F.reverse(labels), F.array().cast("array<string>"), lambda done, x: F.concat(F.array(F.concat_ws(".", x, F.get(done, 0))), done))
        last = lambda s: ~s.contains(".")  # noqa: E731  a suffix without any rule
        is_suffix = lambda s: last(s) | self.holds(s) | self.holds(F.concat(F.lit("*"), F.regexp_extract(s, r"(\..*)$", 1)))
        above = lambda e: F.slice(e, F.greatest(F.array_position(F.transform(e, is_suffix), True).cast("int") - 1, F.lit(1)), F.lit(1))
        excepted = lambda e: F.filter(e, lambda s: self.holds(F.concat(F.lit("!"), s)))
        # No conditional expressions: what stands in one is not worked out once for all rows.
        address = F.filter(F.array(host), lambda h: h.rlike(r"^(\d+\.){3}\d+$|^\["))
        found = F.transform(F.array(ends), lambda e: F.get(F.concat(excepted(e), above(e)), 0))
        return F.get(F.concat(address, found), 0)


def _ascii(rule: str) -> str:
    """The rule as hosts outside ASCII are written in requests."""
    mark, bare = ("!", rule[1:]) if rule.startswith("!") else ("*.", rule[2:]) if rule.startswith("*.") else ("", rule)
    try:
        return mark + bare.encode("idna").decode()
    except UnicodeError:
        return rule


def shipped_list() -> str | None:
    """The public list inside a jar of Spark's, if there is one."""
    pattern, name = SHIPPED
    for home in filter(None, (os.environ.get("SPARK_HOME"), str(Path(pyspark.__file__).parent))):
        for jar in sorted(Path(home, "jars").glob(pattern)):
            with zipfile.ZipFile(jar) as z:
                if name in z.namelist():
                    return z.read(name).decode("utf-8")
    return None


@lru_cache
def default_rules() -> SuffixRules:
    """The shipped list without private owners; without it, the usual second labels under any label of two letters."""
    text = shipped_list()
    return SuffixRules(parsed(text) if text else (f"{s}.{a}{b}" for s, a, b in product(SECOND_LABELS, ascii_lowercase, ascii_lowercase)))
