"""Files in, exports out, live pages from a server of our own, and streams that stop."""

import base64
import csv
import glob
import http.server
import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import records
from textloom.sources import files, sinks, web
from textloom.streaming import incremental

from .test_golden import FULL, pages


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    doc = docx(p("One") + p("") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p("Two"))
    rows = [
        ("d/x.TXT", "ä\n\nb".encode()), ("u.txt", "ä".encode("utf-16")), ("l.txt", b"\xe4b\xff"), ("w.docx", doc),
        ("bad.docx", b"x"), ("n.md", b"x"), ("", b"x"), ("e.txt", b" \n"), ("p.pdf", b"%PDF")
    ]
    got = {r.path: r for r in files.file_blocks(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["d/x.TXT"].title, got["d/x.TXT"].blocks) == ("x", ["ä", "b"])
    assert got["u.txt"].blocks == ["ä"]
    assert got["l.txt"].blocks == ["äbÿ"]
    assert got["w.docx"].blocks == ["One", "Two", "a | b"]
    assert all(got[x].error for x in ("bad.docx", "n.md", "", "e.txt", "p.pdf"))


def test_uploads(spark):
    given = [base64.b64encode(b"text").decode(), "!!!!", "abc", None]
    got = spark.createDataFrame([(x,) for x in given], "c string").select(files.decode_upload(F.col("c")).alias("b")).collect()
    assert [r.b and bytes(r.b) for r in got] == [b"text", None, None, None]


@pytest.mark.parametrize(
    ("name", "body", "titles"),
    [
        ("a.json", '[{"title": "t"}, 5, null]', ["t"]),
        ("A.JSON", '{"records": [{"title": "t", "symptoms": ["a"]}, {}]}', ["t", ""]), ("a.txt", "[]", None),
        ("a.json", "[1", None), ("a.json", '{"x": 1}', None), ("a.json", "[{}] x", None), ("a.json", '[{"title": 5}]', None),
        ("a.json", '[{"symptoms": "a"}]', None), ("a.json", "[]", [])
    ],
)
def test_json_records(spark, name, body, titles):
    rows = files.json_records(spark.createDataFrame([(name, body.encode())], "filename string, content binary")).orderBy("pos").collect()
    assert ([r.data.title for r in rows] if not any(r.error for r in rows) else None) == titles
    for r in rows:
        if not r.error:
            assert (r.data.category, r.data.verified_from, r.data.confidence_rules.min_symptoms_match) == ("disease", "", 2)


def whole(folder, ending):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{folder}/*.{ending}")))


def test_exports(spark, tmp_path):
    rows = records.build_records(pages(spark, [("Malaria, \"so\"", "https://who.int/malaria", [FULL, FULL + "\nmore"])]).coalesce(1)).filter("reject_reason is null")
    for kind in ("jsonl", "csv", "json"):
        sinks.export(rows, str(tmp_path / kind), kind)
    line = json.loads(whole(f"{tmp_path}/jsonl", "txt"))
    assert list(line) == ["data", "raw_blocks", "language", "quality_score", "tags"]
    assert list(line["data"]) == list(files.lx.EXPORT_FIELDS)
    read = list(csv.DictReader(io.StringIO(whole(f"{tmp_path}/csv", "csv"), newline="")))
    assert len(read) == 1
    assert tuple(read[0]) == sinks.CSV_COLUMNS
    assert read[0]["title"] == 'Malaria, "so"'
    assert json.loads(read[0]["severity_levels"]) == line["data"]["severity_levels"]
    assert json.loads(whole(f"{tmp_path}/json", "txt")) == [line["data"]]
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "json"), "json", mode="append")
    sinks.export(rows, str(tmp_path / "jsonl"), "jsonl", mode="append")
    assert len(whole(f"{tmp_path}/jsonl", "txt").splitlines()) == 2
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "x"), "xml")


def test_a_json_array_in_record_order(spark, tmp_path):
    """In the given order over many parts, rows that repeat as often as they do; also of nothing."""
    some = [("who.int", f"https://who.int/malaria/{i}") for i in range(40)]
    table = spark.createDataFrame(
        [(i, t, u, [FULL]) for i, (t, u) in enumerate(reversed(some))] + [(5, *some[34], [FULL])] * 2,
        "place int, title string, source_url string, blocks array<string>"
    )
    rows = records.build_records(table.repartition(7)).filter("reject_reason is null")
    folder = str(tmp_path / "json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.export(rows, folder, "json", order=["place"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{folder}/part-*")) > 1
    sinks.one_file(spark, folder, str(tmp_path / "all.json"))
    got = json.loads((tmp_path / "all.json").read_text())
    places = sorted([r.place for r in rows.collect()])
    assert len(got) == len(places) == 42
    assert [x["source_url"] for x in got] == [some[39 - p][1] for p in places]
    sinks.export(rows.filter("false"), folder, "json", order=["place"])
    assert json.loads(whole(folder, "txt")) == []


class Site(http.server.BaseHTTPRequestHandler):
    tries: dict = {}
    more: dict = {}

    def do_GET(self):
        n = Site.tries[self.path] = Site.tries.get(self.path, 0) + 1
        code, kind, body = {
            "/ok": (200, "text/html", b"<p>ok"), "/busy": (503 if n < 2 else 200, "text/html", b"late"),
            "/pdf": (200, "application/pdf", b"x"), "/slow": (429, "text/html", b""),
            "/robots.txt": (200, "text/plain", b"User-agent: *\nDisallow: /secret\n")
        }.get(self.path, (404, "text/html", b""))
        if self.path in Site.more:
            code, kind, body = 200, Site.more[self.path][0], Site.more[self.path][1].encode()
        self.send_response(code)
        self.send_header("content-type", kind)
        if self.path == "/slow":
            self.send_header("retry-after", "60")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_live_pages(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    web.register(spark)
    paths = ("/ok", "/busy", "/pdf", "/slow", "/lost", "/secret")
    rows = {r.url.removeprefix(base): r for r in spark.read.format("web_pages").option("urls", " ".join(base + p for p in paths)).load().collect()}
    server.shutdown()
    assert (rows["/ok"].html, rows["/busy"].html) == ("<p>ok", "late")
    assert "HTML" in rows["/pdf"].error
    assert "60" in rows["/slow"].error
    assert "404" in rows["/lost"].error
    assert "robots" in rows["/secret"].error


def test_a_manifest_is_written_and_read(spark, tmp_path):
    from textloom.operators import crawl
    from textloom.sources import jobs

    table = spark.createDataFrame([("https://who.int/malaria", f"<title>Malaria</title><p>{FULL}</p><a href='/lost'>x</a>")], "url string, html string")
    config = crawl.CrawlConfig(("https://who.int/malaria", "https://cdc.gov/none"), max_pages=5, max_depth=1)
    row = jobs.snapshot(crawl.run_crawl(spark, table, config), config, "j1")
    for _ in range(2):
        jobs.write_manifests(row, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "j1").iterdir() if not p.name.startswith(".")) == ["job.json"]
    got = jobs.read_manifests(spark, str(tmp_path)).first()
    assert (got.job_id, got.status, got.discovered_pages, got.accepted_pages, got.failed_pages, got.max_pages) == ("j1", "completed", 3, 1, 2, 10)
    assert [(p.label, p.accepted_pages) for p in sorted(got.platform_states, key=lambda p: p.root_host)] == [
        ("Centers for Disease Control and Prevention", 0), ("World Health Organization", 1)
    ]
    assert len(got.errors) == 2 and got.queue_items == []


def test_urls_as_sources(spark):
    """Pages, robots.txt and nested sitemaps of a server of our own."""
    from textloom.operators import crawl

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    at = lambda name: f"<loc>{base}/{name}</loc>"
    Site.more = {
        "/sitemap.xml": ("text/xml", f"<sitemapindex><sitemap>{at('a.xml')}</sitemap></sitemapindex>"),
        "/a.xml": ("text/xml", f"<urlset><url>{at('health/one')}</url><url>{at('x.pdf')}</url></urlset>"),
        "/health/one": ("text/html", f"<title>Malaria</title><p>{FULL}</p>"),
    }
    try:
        rows = {r.source_url.removeprefix(base): r for r in web.read_urls(spark, [f"{base}/health/one", f"{base}/ok", f"{base}/lost"]).collect()}
        found = web.discover(spark, [base], 10)
        assert [(r.url.removeprefix(base), r.seq) for r in found.collect()] == [("/health/one", 1)]
        done = crawl.run_crawl(
            spark, spark.createDataFrame([(f"{base}/health/one", Site.more["/health/one"][1])], "url string, html string"),
            crawl.CrawlConfig((base,), max_depth=0), found
        )
        assert {r.url.removeprefix(base): r.depth for r in done.visited.collect()} == {"/": 0, "/health/one": 0}
    finally:
        Site.more = {}
        server.shutdown()
    assert (rows["/health/one"].title, rows["/health/one"].blocks, rows["/health/one"].error) == ("Malaria", [FULL], None)
    assert "paragraph" in rows["/ok"].error and "404" in rows["/lost"].error
    assert web.fetch_text("http://127.0.0.1:9/robots.txt") is None


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    where = str(tmp_path)
    rows = [(i, f"https://who.int/malaria/{i % 3}", f"<title>Malaria</title><p>{FULL}</p>") for i in range(6)]
    table = spark.createDataFrame(rows, incremental.PAGES)
    counts = []
    for part in (table.filter("page_id < 2"), table.filter("page_id >= 2")):
        part.write.mode("append").parquet(f"{where}/in")
        q = incremental.start_export(incremental.read_pages(spark, f"{where}/in"), f"{where}/out", f"{where}/state")
        q.awaitTermination()
        assert incremental.progress(q)["active"] is False
        counts.append(spark.read.text(f"{where}/out").count())
    assert counts == [2, 3]


def test_manifests(spark, tmp_path):
    from textloom.sources import jobs

    for name, body in (
        ("a", {"status": "running", "in_progress_urls": ["u"], "start_urls": ["https://who.int/", "https://who.int/"], "platform_max_pages": 7}),
        ("b", {"job_id": "own", "status": "completed", "queue_items": [{"url": "u"}], "errors": list(map(str, range(30)))}),
        ("c", None)
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text("{" if body is None else json.dumps(body, indent=2))
    rows = {r.job_id: r for r in jobs.read_manifests(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "own", "c"}
    assert (rows["c"].broken, rows["a"].broken, rows["c"].status) == (True, False, "queued")
    state = rows["a"].platform_states
    assert [(p.label, p.max_pages, p.root_host) for p in state] == [("World Health Organization", 7, "who.int")]
    assert [r.job_id for r in jobs.pending(jobs.read_manifests(spark, str(tmp_path))).collect()] == ["a"]
    view = {r.job_id: r for r in jobs.job_view(jobs.read_manifests(spark, str(tmp_path))).collect()}
    assert view["own"].errors == list(map(str, range(10, 30)))
    assert view["own"].download_json_url == "/api/crawl/own/download/json"
    assert view["a"].download_json_url is None
    over = {r.job_id: r for r in jobs.finished(jobs.read_manifests(spark, str(tmp_path))).collect()}
    assert (over["own"].queue_items, len(over["a"].in_progress_urls)) == ([], 1)


def test_a_cancelled_stream_starts_anew(spark, tmp_path):
    where = str(tmp_path)
    spark.createDataFrame([(1, "https://who.int/malaria", f"<title>Malaria</title><p>{FULL}</p>")], incremental.PAGES).write.parquet(f"{where}/in")
    for n in (1, 2):
        q = incremental.start_export(incremental.read_pages(spark, f"{where}/in"), f"{where}/out{n}", f"{where}/state")
        q.awaitTermination()
        incremental.cancel(q, spark, f"{where}/state")
        assert not glob.glob(f"{where}/state/*")
        assert spark.read.text(f"{where}/out{n}").count() == 1


def test_a_stream_reads_pages_as_a_crawl_does(spark, tmp_path):
    """Roots, removed classes and hidden parts count in a stream as in a crawl, and a page that is no page ends neither."""
    from textloom.operators import crawl

    body = f"<title>Malaria</title><div class='menu'><p>Menu {FULL}</p></div><main><li>{FULL} One.</li></main><p aria-hidden='true'>{FULL} Two.</p><p>{FULL} Three.</p>"
    table = spark.createDataFrame([(1, "https://who.int/malaria", body), (2, "https://who.int/malaria/b", "<![foo[ x ]]>")], incremental.PAGES)
    table.write.parquet(f"{tmp_path}/in")
    incremental.start_export(incremental.read_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    streamed = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert [r["raw_blocks"] for r in streamed] == [[f"{FULL} One."]]
    done = crawl.run_crawl(spark, table.select("url", "html"), crawl.CrawlConfig(("https://who.int/malaria",), max_depth=0))
    assert done.records.select(sinks.json_line().alias("v")).first().v == json.dumps(streamed[0], ensure_ascii=False, separators=(",", ":"))


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from textloom.plans import storage

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
