"""Pages and bytes from tables, files or the web.

Offline tables are the usual source. The web source runs in mapInPandas over URLs dealt by
host, so one task owns a host and can space its requests. A task asks the host that is due first, so
one host's pauses do not hold the others. When a host was last asked goes from one stage
to the next as a table, its clock. The source needs nothing but the standard library, and one bad page
becomes a row, never a failed task.
"""

from __future__ import annotations

import hashlib
import random
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import netloc, normalize, robots_url
from ..scratch import put_file
from .robots import robots_allow

__all__ = ["Client", "fetch_bytes", "fetch_files", "fetch_pages", "fetch_robots", "image_files", "in_turn", "later", "pages_table", "retry_delays", "robots_allow"]

#: asked: when the last request for the URL was sent, in seconds since 1970.
RESULT = "url string, final_url string, status int, html string, content_type string, ok boolean, allowed boolean, asked double"
BYTES = "url string, content binary, content_type string, asked double"


def pages_table(spark: SparkSession, path: str) -> DataFrame:
    """(url, final_url, status, html, content_type, ok) of a Parquet table (url, html), one row a normalised URL."""
    rows = spark.read.parquet(path).withColumn("final_url", F.col("url")).withColumn("url", normalize(F.col("url")))
    first = rows.groupBy("url").agg(F.min_by(F.struct("final_url", "html"), F.col("final_url")).alias("p"))
    return first.select("url", "p.final_url", F.lit(200).alias("status"), "p.html", F.lit("text/html").alias("content_type"), F.lit(True).alias("ok"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, width, height, channels, data, decoded) of files: bytes, and pixels where they can be decoded."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    pixels = spark.read.format("image").option("dropInvalid", "false").load(path).select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    joined = raw.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(pixels, "path", "left")
    return joined.withColumn("decoded", F.coalesce(F.col("width") > 0, F.lit(False)))


def retry_delays(attempts: int, first: float = 0.5) -> list[float]:
    """What is waited, without the random half, before each attempt but the first."""
    return [first * 2**k for k in range(max(1, attempts) - 1)]


class Client:
    """Requests of one task: user agent, timeout, retries with growing delays, and when each host was last asked."""

    def __init__(self, user_agent: str, timeout: float = 20.0, attempts: int = 3, spacing: float = 1.0):
        self.user_agent, self.timeout, self.attempts = user_agent, timeout, max(1, attempts)
        self.spacing = spacing
        self.last: dict[str, float] = {}

    def due(self, host: str) -> float:
        """When the host may be asked again."""
        return self.last.get(host, -self.spacing) + self.spacing

    def wait(self, url: str) -> None:
        host = urlsplit(url).netloc
        time.sleep(max(0.0, self.due(host) - time.time()))
        self.last[host] = time.time()

    def get(self, url: str) -> tuple[str, int, str, bytes] | None:
        """(final url, status, content type, body); server errors and 429 are tried again, the last one is returned."""
        delays = [*retry_delays(self.attempts), None]
        for delay in delays:
            out = None
            self.last[urlsplit(url).netloc] = time.time()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.user_agent}), timeout=self.timeout) as r:
                    return r.geturl(), r.status, r.headers.get("Content-Type", ""), r.read()
            except urllib.error.HTTPError as e:
                out = (e.geturl() or url, e.code, e.headers.get("Content-Type", "") if e.headers else "", b"")
                if e.code < 500 and e.code != 429:
                    return out
            except (OSError, ValueError):
                pass
            if delay is None:
                return out
            time.sleep(delay + random.uniform(0, delay / 2))
        return None


def decode(body: bytes, content_type: str) -> str:
    charset = content_type.partition("charset=")[2].split(";")[0].strip() or "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def in_turn(urls: list[str], client: Client) -> Iterator[int]:
    """Places of the URLs in the order in which they may be asked for: the next is the first URL of the host that is due first, and is given when it is due."""
    queues: dict[str, deque[int]] = {}
    for i, url in enumerate(urls):
        queues.setdefault(urlsplit(url).netloc, deque()).append(i)
    heap = [(client.due(host), q[0], host) for host, q in queues.items()]
    heapify(heap)
    while heap:
        _, i, host = heappop(heap)
        client.wait(urls[i])
        yield i
        queue = queues[host]
        queue.popleft()
        if queue:
            heappush(heap, (client.due(host), queue[0], host))


def asked(urls: DataFrame, schema: str, client: Callable[[], Client], row: Callable[[Client, str], tuple], clock: DataFrame | None = None) -> DataFrame:
    """A row of `schema`, of which the first column is the URL and the last the time of asking, for each of (url, and `allowed` if there is one); what is not allowed is not asked for.

    clock: (netloc, last), when hosts were asked before this stage.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    n = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for pdf in batches:
            for host, last in zip(pdf["netloc"], pdf["last"], strict=True):
                if last == last and host not in c.last:  # not NaN
                    c.last[host] = last
            rows: list[tuple] = [(url, *[None] * (n - 1)) for url in pdf["url"]]
            open_ = [i for i, fine in enumerate(pdf["allowed"]) if fine]
            wanted = [pdf["url"].iloc[i] for i in open_]
            for k in in_turn(wanted, c):
                got = row(c, wanted[k])
                rows[open_[k]] = (wanted[k], *got, c.last[urlsplit(wanted[k]).netloc])
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    rows = urls.select("url", F.col("allowed") if "allowed" in urls.columns else F.lit(True).alias("allowed"), netloc(F.col("url")).alias("netloc"))
    rows = rows.join(clock.select("netloc", "last"), "netloc", "left") if clock is not None else rows.withColumn("last", F.lit(None).cast("double"))
    return rows.repartition("netloc").mapInPandas(run, schema)


def later(clock: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The clock (netloc, last) after a stage whose rows (url, asked) tell when hosts were asked."""
    times = rows.where("asked IS NOT NULL").select(netloc(F.col("url")).alias("netloc"), F.col("asked").alias("last"))
    times = times.unionByName(clock.select("netloc", "last")) if clock is not None else times
    return times.groupBy("netloc").agg(F.max("last").alias("last"))


def fetch_pages(urls: DataFrame, user_agent: str, timeout: float = 20.0, attempts: int = 3, spacing: float = 1.0, clock: DataFrame | None = None) -> DataFrame:
    """The pages of (url, and `allowed` as robots.judge() tells it), one row each: what is not allowed or not reached has no status."""

    def row(client: Client, url: str) -> tuple:
        got = client.get(url)
        if got is None:
            return url, None, "", "", False, True
        final, status, kind, body = got
        is_html = "html" in kind.lower() or not kind
        return final, status, decode(body, kind) if is_html else "", kind, 200 <= status < 300 and is_html, True

    rows = asked(urls, RESULT, lambda: Client(user_agent, timeout, attempts, spacing), row, clock)
    filled = {"final_url": F.coalesce("final_url", "url"), "html": F.coalesce("html", F.lit("")), "content_type": F.coalesce("content_type", F.lit("")), "ok": F.coalesce("ok", F.lit(False)), "allowed": F.coalesce("allowed", F.lit(False))}
    return rows.withColumns(filled)


def fetch_robots(urls: DataFrame, user_agent: str, timeout: float = 20.0, attempts: int = 1, spacing: float = 1.0, clock: DataFrame | None = None) -> DataFrame:
    """(netloc, status, body, url, asked): the robots files of the hosts of (url), each asked for once."""

    def row(client: Client, url: str) -> tuple:
        got = client.get(url)
        return (None, "") if got is None else (got[1], got[3].decode("utf-8", "replace"))

    hosts = urls.select(robots_url(F.col("url")).alias("url")).groupBy(netloc(F.col("url")).alias("netloc")).agg(F.min("url").alias("url"))
    rows = asked(hosts.select("url"), "url string, status int, body string, asked double", lambda: Client(user_agent, timeout, attempts, spacing), row, clock)
    return rows.select(netloc(F.col("url")).alias("netloc"), "status", "body", "url", "asked")


def fetch_bytes(urls: DataFrame, user_agent: str, timeout: float = 20.0, attempts: int = 3, spacing: float = 1.0, clock: DataFrame | None = None) -> DataFrame:
    """The bodies of (url) answered with 2xx; the others are null. Robots rules are not asked."""

    def row(client: Client, url: str) -> tuple:
        got = client.get(url)
        return (got[3], got[2]) if got is not None and 200 <= got[1] < 300 else (None, None)

    return asked(urls, BYTES, lambda: Client(user_agent, timeout, attempts, spacing), row, clock)


def fetch_files(urls: DataFrame, folder: str, user_agent: str, timeout: float = 20.0, attempts: int = 3, spacing: float = 1.0, clock: DataFrame | None = None) -> DataFrame:
    """(url, name, asked): the bodies of (url) answered with 2xx, as files of a shared folder that are named by their URL's digest; the name is null for others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [None if body is None else hashlib.sha256(url.encode()).hexdigest() for url, body in zip(pdf["url"], pdf["content"], strict=True)]
            for name, body in zip(names, pdf["content"], strict=True):
                if name:
                    put_file(folder, name, bytes(body))
            yield pd.DataFrame({"url": pdf["url"], "name": pd.Series(names, dtype=object), "asked": pdf["asked"]})

    return fetch_bytes(urls, user_agent, timeout, attempts, spacing, clock).mapInPandas(run, "url string, name string, asked double")
