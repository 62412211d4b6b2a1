"""Robots rules as a table: files are parsed once, by expressions and windows over their lines, and URLs are judged by a join on the host.

The rules are those of the standard library's parser: groups of agents, the first group that names the
agent and else the first for all agents, and in it the first rule that begins the path. `longest=True`
takes the rule of the most characters instead, as the published standard (RFC 9309) asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import LINE_BREAK, strip
from ..functions.urls import netloc

RULES = "array<struct<pattern:string,allow:boolean>>"


def unquoted(s: Column) -> Column:
    """Percent escapes as characters; what is no escape stays."""
    return F.url_decode(F.replace(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def quoted(s: Column) -> Column:
    """All characters but letters, digits and _.-~/ as percent escapes of their UTF-8 bytes."""
    out = F.url_encode(s)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(written), F.lit(wanted))
    return out


def tidy(s: Column) -> Column:
    """Without the marks of empty parameters, queries and fragments."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "#$", ""), r"\?(?=#|$)", ""), r";(?=[?#]|$)", "")


def judged_path(url: Column) -> Column:
    """What rules are compared with: path, query and fragment of a URL in one spelling."""
    rest = tidy(F.regexp_replace(unquoted(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""))
    return F.when(rest == "", F.lit("/")).otherwise(quoted(rest))


def rule_groups(files: DataFrame) -> DataFrame:
    """(netloc, place, agents, rules) of robots files (netloc, body): one row a group, in the order of the file."""
    lines = files.select("netloc", F.posexplode(F.split("body", LINE_BREAK, -1)).alias("pos", "line"))
    bare = strip(F.regexp_replace("line", "(?s)#.*$", ""))
    lines = lines.select("netloc", "pos", (F.col("line") == "").alias("blank"), bare.alias("bare"))
    name = F.when(F.contains("bare", F.lit(":")), F.lower(strip(F.substring_index("bare", ":", 1))))
    lines = lines.select("netloc", "pos", "blank", name.alias("name"), unquoted(strip(F.regexp_extract("bare", "(?s)^[^:]*:(.*)$", 1))).alias("value"))
    kind = F.when(F.col("blank"), "blank").when(F.col("name") == "user-agent", "agent").when(F.col("name").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    lines = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    w = W.partitionBy("netloc").orderBy("pos")  # a file is read in one place
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "agent")
    inside = F.last(F.when(F.col("kind").isin("agent", "blank"), F.col("kind")), ignorenulls=True).over(w) == "agent"
    lines = lines.withColumn("place", F.sum(opens.cast("int")).over(w)).withColumn("inside", inside).where("inside")
    rule = F.when(F.col("name").isin("allow", "disallow"), F.struct("pos", quoted(tidy(F.col("value"))).alias("pattern"), ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow")))
    groups = lines.groupBy("netloc", "place").agg(
        F.collect_set(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"),
        F.array_sort(F.collect_list(rule)).alias("rules"),
        F.max(F.col("kind") == "rule").alias("whole"),
    )
    return groups.where("whole").select("netloc", "place", "agents", F.transform("rules", lambda r: F.struct(r["pattern"].alias("pattern"), r["allow"].alias("allow"))).alias("rules"))


def policies(files: DataFrame, user_agent: str) -> DataFrame:
    """(netloc, whole, rules) of robots files (netloc, body, and status where they were fetched): what holds for an agent.

    whole: true where all is allowed, false where nothing is, null where the rules say. Files that were
    refused (401, 403) forbid all, missing ones allow all, those of a failing server forbid all; hosts
    that were not reached have no status, and all is allowed.
    """
    if "status" not in files.columns:
        files = files.withColumn("status", F.lit(200))
    s = F.col("status")
    whole = F.when(s.isNull(), True).when(s.isin(401, 403), False).when(s.between(400, 499), True).when(~s.between(200, 299), False)
    agent = user_agent.split("/")[0].lower()
    groups = rule_groups(files.where(F.col("status").between(200, 299)))
    any_agent = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(F.lit(agent), a))
    mine = groups.where(any_agent | named).groupBy("netloc").agg(F.min_by("rules", F.struct(any_agent, "place")).alias("rules"))
    return files.select("netloc", whole.alias("whole")).join(mine, "netloc", "left").select("netloc", "whole", F.coalesce("rules", F.array().cast(RULES)).alias("rules"))


def allowed(path: Column, whole: Column, rules: Column, longest: bool = False) -> Column:
    """Whether a path as judged_path() gives it may be asked for."""
    fitting = F.filter(rules, lambda r: F.startswith(path, r["pattern"]))
    if longest:  # of equal lengths the one that allows
        best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    else:
        best = F.get(fitting, 0)
    return F.coalesce(whole, best["allow"], F.lit(True))


def judge(urls: DataFrame, policy: DataFrame, longest: bool = False) -> DataFrame:
    """urls (url, ...) with `allowed`; hosts without a policy allow all."""
    named = policy.select(F.col("netloc").alias("__netloc"), F.col("whole").alias("__whole"), F.col("rules").alias("__rules"))
    joined = urls.join(named, netloc(F.col("url")) == F.col("__netloc"), "left")
    return joined.select(*urls.columns, allowed(judged_path(F.col("url")), F.col("__whole"), F.col("__rules"), longest).alias("allowed"))


def robots_allow(urls: DataFrame, robots: DataFrame, user_agent: str, longest: bool = False) -> DataFrame:
    """urls (url) with `allowed` by robots files (netloc, body); hosts without one allow all."""
    return judge(urls, policies(robots, user_agent), longest)
