"""Crawls that fetch: on servers of our own, against the stored crawl, stopped at every level, and with servers that misbehave."""

import http.server
import socket
import threading
import time
from collections import Counter

import pytest

from textloom.operators import crawl
from textloom.plans import overlay
from textloom.plans.storage import exists
from textloom.sources import web

PAGES = 24
BODY = "</p><p>".join(overlay.SNIPPETS[0].split("\n\n"))


def page(i):
    links = "".join(f'<a href="/malaria/{k}">x</a>' for k in (2 * i + 1, 2 * i + 2, i))
    text = BODY if i % 5 else "Nothing here is of use to anybody who reads it, though it is long enough to be a block."
    return f"<html><title>Malaria {i}</title><body><p>{text}</p>{links}</body></html>"


class Site(http.server.BaseHTTPRequestHandler):
    now, most, asked, lock = Counter(), Counter(), Counter(), threading.Lock()

    def do_GET(self):
        host = self.headers["Host"]
        with self.lock:
            self.now[host] += 1
            self.most[host] = max(self.most[host], self.now[host])
            self.asked[host + self.path] += 1
        time.sleep(0.02)
        name = self.path.removeprefix("/malaria/")
        found = name.isdigit() and int(name) < PAGES and int(name) % 7 != 6
        body = page(int(name)).encode() if found else b"no"
        self.send_response(200 if found else 404)
        self.send_header("content-type", "text/html; charset=utf-8")
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)
        with self.lock:
            self.now[host] -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    for c in (Site.now, Site.most, Site.asked):
        c.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield [f"http://{host}:{server.server_port}" for host in ("127.0.0.1", "localhost")]
    server.shutdown()


def config_of(site, **more):
    return crawl.CrawlConfig(tuple(f"{s}/malaria/0" for s in site), concurrency=6, include_sitemap=False, **{"max_depth": 3, "max_pages": 100} | more)


def told_of(done):
    records = sorted((r.url, r.reject_reason, str(r.data), r.score) for r in done.records.collect())
    return records, sorted(map(str, done.visited.collect())), sorted(map(str, done.progress.collect()))


def test_a_live_crawl_is_the_stored_one(spark, site):
    config, counts = config_of(site), []
    table = spark.createDataFrame([(f"{s}/malaria/{i}", page(i)) for s in site for i in range(PAGES) if i % 7 != 6], "url string, html string")
    live = crawl.run_crawl(spark, web.live_pages(tasks=12), config, told=counts.append)
    got = told_of(live)
    stored = crawl.run_crawl(spark, table, config)
    assert got == told_of(stored) and len(got[0]) > 10
    assert {r.url for r in live.errors.collect()} == {r.url for r in stored.errors.collect()} and "404" in live.errors.first().error
    # three workers a host at most; each page once
    pages = {k: n for k, n in Site.asked.items() if "malaria" in k}
    assert len(Site.most) == 2 and all(n <= 3 for n in Site.most.values()), Site.most
    assert set(pages.values()) == {1}
    # counts of the levels as they were written are those of the whole crawl
    rows = stored.progress.collect()
    assert [c["depth"] for c in counts] == [0, 1, 2, 3]
    for name in ("discovered", "failed", "accepted", "rejected"):
        assert sum(c[name] for c in counts) == sum(r[name] for r in rows)


def test_a_host_is_dealt_to_as_many_tasks_as_it_has_workers(spark):
    """A host with nearly all URLs, and many with one each."""

    def where(url):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId()), None

    rows = [(f"https://hot.org/{i}", 3) for i in range(600)] + [(f"https://h{i}.org/", 1) for i in range(80)]
    got = web.fetch_pages(spark.createDataFrame(rows, "url string, workers int"), where, tasks=16, robots=None).collect()
    hot = Counter(r.html for r in got if "hot" in r.url)
    assert len(got) == 680 and 2 <= len(hot) <= 3 and sum(hot.values()) == 600
    assert len({r.html for r in got if "hot" not in r.url}) > 8


@pytest.mark.parametrize("how", ["pause", "error", "half-written"])
def test_a_crawl_that_stops_after_any_level_goes_on(spark, site, tmp_path, how):
    import shutil

    config, path = config_of(site[:1]), f"{tmp_path}/crawl"
    whole = told_of(crawl.run_crawl(spark, web.live_pages(tasks=6), config))
    Site.asked.clear()

    def stop(row):
        if how == "pause":
            crawl.pause(spark, path)
        else:
            raise RuntimeError("stopped")

    for depth in range(4):
        try:
            done = crawl.run_crawl(spark, web.live_pages(tasks=6), config, path=path, told=stop)
            assert how == "pause" and done.state == ("paused" if depth < 3 else "completed")
        except RuntimeError:
            pass
        assert [x["depth"] for x in crawl.CrawlLog(spark, path).levels()] == list(range(depth + 1))
        if how == "half-written" and depth == 2:  # the level is there, but nothing says that it is whole
            shutil.rmtree(f"{path}/levels/depth=2")
            next((tmp_path / "crawl/pages/depth=2").glob("*.parquet")).unlink()
            with pytest.raises(RuntimeError):
                crawl.run_crawl(spark, web.live_pages(tasks=6), config, path=path, told=stop)
    done = crawl.run_crawl(spark, web.live_pages(tasks=6), config, path=path)
    assert done.state == "completed" and told_of(done) == whole
    assert how == "half-written" or {n for k, n in Site.asked.items() if "malaria" in k} == {1}
    with pytest.raises(ValueError, match="settings"):
        crawl.run_crawl(spark, web.live_pages(), config_of(site[:1], max_pages=5), path=path)


def test_a_cancelled_crawl_leaves_nothing(spark, site, tmp_path):
    path = f"{tmp_path}/crawl"
    done = crawl.run_crawl(spark, web.live_pages(tasks=6), config_of(site[:1]), path=path, told=lambda _: crawl.cancel(spark, path))
    assert done.state == "cancelled" and done.records.count() == 0 and not exists(spark, path)
    # and one that was paused before
    crawl.run_crawl(spark, web.live_pages(tasks=6), config_of(site[:1]), path=path, told=lambda _: crawl.pause(spark, path))
    crawl.cancel(spark, path)
    assert crawl.run_crawl(spark, web.live_pages(tasks=6), config_of(site[:1]), path=path).state == "cancelled"


def test_a_live_crawl_with_sitemaps(spark, site):
    """Without sitemaps on the server, the same as without looking for them."""
    found = web.live_crawl(spark, crawl.CrawlConfig((f"{site[0]}/malaria/0",), max_depth=1), tasks=4)
    assert {r.url.rsplit("/", 1)[1] for r in found.visited.collect()} == {"0", "1", "2"}


class Odd(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        kinds = {
            "/charset": ("text/html; charset=x-foo", "é ok".encode(), 0), "/short": ("text/html", b"cut", 100), "/long": ("text/html", b"x" * 5000, 0),
            "/fine": ("text/html; charset=latin-1", "é".encode("latin-1"), 0), "/robots.txt": ("text/plain", b"\xff\xfe\nUser-agent: *\nDisallow: /secret\n", 0)
        }
        kind, body, more = kinds.get(self.path, ("text/html", b"?", 0))
        self.send_response(200)
        self.send_header("content-type", kind)
        self.send_header("content-length", str(len(body) + more))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_whatever_a_server_sends_is_a_row(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Odd)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    silent = socket.socket()  # takes a connection and never answers
    silent.bind(("127.0.0.1", 0))
    silent.listen()
    closed = socket.socket()
    closed.bind(("127.0.0.1", 0))
    base, quick = f"http://127.0.0.1:{server.server_port}", lambda url: web.fetch(url, timeout=0.5, attempts=2, sleep=lambda _: None, max_bytes=4000)
    urls = [*(base + p for p in ("/charset", "/short", "/long", "/fine", "/secret")), f"http://127.0.0.1:{silent.getsockname()[1]}/", f"http://127.0.0.1:{closed.getsockname()[1]}/", "http://[x", "https://no host/"]
    rows = spark.createDataFrame([(u, 2) for u in urls], "url string, workers int")
    began = time.time()
    got = {r.url.removeprefix(base): (r.html, r.failed) for r in web.fetch_pages(rows, quick, tasks=4).collect()}
    server.shutdown()
    silent.close()
    closed.close()
    assert len(got) == len(urls) and time.time() - began < 60
    assert got["/charset"] == ("é ok", None) and got["/fine"] == ("é", None)
    assert "IncompleteRead" in got["/short"][1] and "4000 bytes" in got["/long"][1] and "robots" in got["/secret"][1]
    assert all(html is None and error for url, (html, error) in got.items() if not url.startswith("/") )


def test_a_host_that_asks_to_wait_is_not_asked(monkeypatch):
    clock, slept, asked = [0.0], [], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    def fetch(url):
        asked.append(url)
        return (None, "rate-limited (HTTP 429), retry after about 60 seconds") if "busy" in url else ("x", None)

    visitor = web.Visitor(fetch, 2.0, None, lambda: clock[0], sleep)
    assert visitor.visit("http://a/1") == visitor.visit("http://a/2") == ("x", None) and slept == [2.0]
    assert "429" in visitor.visit("http://busy/1")[1] and "429" in visitor.visit("http://busy/2")[1] and asked[-1] == "http://busy/1"
    assert visitor.visit("http://b/1") == ("x", None)
    clock[0] += 61
    visitor.visit("http://busy/3")
    assert asked[-1] == "http://busy/3"
