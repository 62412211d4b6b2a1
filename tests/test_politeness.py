"""Robots rules as a table, and one clock a host over all stages."""

import random
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib import robotparser

import pytest

from strata import Config, Engine
from strata.sources import robots
from strata.sources.fetch import Client, asked, fetch_pages, fetch_robots, in_turn, later

AGENT = "StrataBot/0.1 (+https://example.com/bot)"


def judged(spark, files, urls, **k):
    """files: body by host."""
    f = spark.createDataFrame(list(files.items()), "netloc string, body string")
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    return {r["url"]: r["allowed"] for r in robots.robots_allow(u, f, AGENT, **k).collect()}


def test_random_files_equal_the_standard_library(spark):
    r = random.Random(31)
    agents = ["*", "stratabot", "StrataBot", "other", "bot", "Strata"]
    paths = ["/", "", "/a", "/a/b", "/a b", "/%61", "/a%2fb", "/ä", "/%C3%A4", "/a?x=1", "/a*", "*", "/b;c", "/b?", "/a%zz", "/+", "/~x", "b"]
    ends = ["\n", "\r\n", "\r", "\n\n", "\n \n"]

    def line():
        kind = r.random()
        if kind < 0.3:
            return r.choice(("User-agent: ", "user-agent:", " User-Agent : ")) + r.choice(agents)
        if kind < 0.85:
            return r.choice(("Disallow: ", "Allow: ", "disallow:", "ALLOW :")) + r.choice(paths) + r.choice(("", "", "  ", " # why"))
        return r.choice(("Crawl-delay: 3", "# note", "Sitemap: http://x/s.xml", "Request-rate: 1/5", "nonsense", "Host: x", ""))

    files = {f"h{i}.example": "".join(line() + r.choice(ends) for _ in range(r.randint(0, 14))) for i in range(150)}
    files["empty.example"] = ""
    urls = [f"http://{h}{p}" for h in files for p in r.sample(["", *(p for p in paths if p.startswith("/")), "/c", "/a/b/c?d#e", "/a#f", "/b;c?d"], 8)]
    got = judged(spark, files, urls)
    for h, body in files.items():
        parser = robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for u in urls:
            if u.startswith(f"http://{h}"):
                assert got[u] == parser.can_fetch(AGENT, u), (u, body)


def test_hosts_without_files_and_the_longest_rule(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /b\nAllow: /b"
    urls = ["http://a/private/open/x", "http://a/private/y", "http://b/private/y", "http://a/b"]
    assert judged(spark, {"a": body}, urls) == {urls[0]: False, urls[1]: False, urls[2]: True, urls[3]: False}
    assert judged(spark, {"a": body}, urls, longest=True) == {urls[0]: True, urls[1]: False, urls[2]: True, urls[3]: True}


def test_answers_of_hosts_decide_before_rules(spark):
    forbids = "User-agent: *\nDisallow: /"
    files = spark.createDataFrame([("h200", 200, forbids), ("h401", 401, ""), ("h404", 404, forbids), ("h500", 500, ""), ("down", None, "")], "netloc string, status int, body string")
    urls = spark.createDataFrame([(f"http://{h}/x", k) for k, h in enumerate(("h200", "h401", "h404", "h500", "down", "unknown"))], "url string, place int")
    out = robots.judge(urls, robots.policies(files, AGENT))
    assert out.columns == ["url", "place", "allowed"]
    assert [r["allowed"] for r in out.orderBy("place").collect()] == [False, False, True, False, True, True]


def test_rules_are_judged_without_python(spark):
    urls = spark.createDataFrame([("http://a/x",)], "url string")
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /")], "netloc string, body string")
    plan = robots.robots_allow(urls, files, AGENT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_host_that_is_due_first_is_asked_first():
    client = Client("bot", spacing=0.2)
    client.last = {"slow": time.time() + 0.5}
    urls = [f"http://{h}/{k}" for h, k in (("slow", 1), ("slow", 2), ("a", 1), ("a", 2), ("b", 1), ("a", 3))]
    start, times = time.time(), {}
    for i in in_turn(urls, client):
        times[urls[i][7:]] = time.time() - start
    assert [*times] == ["a/1", "b/1", "a/2", "a/3", "slow/1", "slow/2"]
    assert times["b/1"] < 0.15 and times["a/3"] < 0.6 and times["slow/1"] >= 0.69 and times["slow/2"] - times["slow/1"] >= 0.19


@pytest.fixture
def server():
    """A site of pages and images that notes when it is asked for what."""
    seen, files = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((time.time(), self.headers.get("Host"), self.path))
            code, kind, body = files.get(self.path, (404, "text/html", b""))
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_port, files, seen
    s.shutdown()


def test_one_clock_over_robots_pages_renders_images_and_levels(spark, server):
    from tests.test_operators import png

    port, files, seen = server
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    page = lambda x, links=(), more="": (200, "text/html", f"<html><body><h1>{x}</h1><p>{words(x)}.</p>{''.join(f'<a href={u}>l</a>' for u in links)}{more}</body></html>".encode())
    other = f"http://localhost:{port}"
    files |= {
        "/robots.txt": (200, "text/plain", b"User-agent: *\nDisallow: /no"), "/": page("start", ["/a", "/b", "/no", f"{other}/z"], '<img src="/i/1.png" alt="x"><img src="/i/2.png" alt="y">'),
        "/a": page("aa", ["/c"]), "/b": page("bb"), "/c": (200, "text/html", b'<body><div id="app"></div></body>'), "/z": page("zz"), "/no": page("no"),
        "/i/1.png": (200, "image/png", png(200, 200)), "/i/2.png": (500, "image/png", b""),
    }
    spacing = 0.8

    def render(urls, clock):
        def row(client, url):
            got = client.get(f"{url}?rendered")
            return ("<body><p>shown</p></body>" if got else None,)

        return asked(urls, "url string, html string, asked double", lambda: Client(AGENT, 5.0, 1, spacing), row, clock)

    cfg = Config().with_values("crawl", rate_limit_per_domain=spacing, max_retries=2, obey_robots=True, same_domain_only=False, dynamic_min_chars=50).with_values("images", min_bytes=50)
    engine = Engine(spark, cfg, render)
    kept = engine.crawled(f"http://127.0.0.1:{port}/")
    engine.judged_images(kept, engine.image_files(kept)).collect()
    paths = [p for _, _, p in seen]
    assert "/no" not in paths and paths.count("/robots.txt") == 2 and "/c?rendered" in paths and "/i/1.png" in paths and "/z" in paths
    by_host = defaultdict(list)
    for t, host, _ in seen:
        by_host[host].append(t)
    assert len(by_host) == 2
    for times in by_host.values():
        assert all(b - a > spacing - 0.3 for a, b in zip(times, times[1:], strict=False))


def test_what_is_not_allowed_is_a_row_and_not_asked_for(spark, server):
    port, files, seen = server
    files["/x"] = (200, "text/html", b"<p>x</p>")
    root = f"http://127.0.0.1:{port}"
    urls = spark.createDataFrame([(f"{root}/x", True), (f"{root}/y", False)], "url string, allowed boolean")
    out = fetch_pages(urls, AGENT, 2.0, 1, 0.0).cache()
    assert {r["url"][-1]: (r["status"], r["html"], r["ok"], r["allowed"], r["asked"] is None) for r in out.collect()} == {"x": (200, "<p>x</p>", True, True, False), "y": (None, "", False, False, True)}
    clock = later(None, out)
    assert [r["netloc"] for r in clock.collect()] == [f"127.0.0.1:{port}"]
    start = time.time()
    again = fetch_robots(urls.select("url"), AGENT, 2.0, 1, time.time() - clock.first()["last"] + 1.0, clock).collect()
    assert [(r["netloc"], r["status"]) for r in again] == [(f"127.0.0.1:{port}", 404)] and time.time() - start > 0.8
    assert [p for _, _, p in seen] == ["/x", "/robots.txt"]
