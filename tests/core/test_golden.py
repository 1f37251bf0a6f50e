"""Values worked out by hand for the quirks of the domain's rules."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import urls
from textloom.operators import crawl, dedup, html, records
from textloom.plans.lexicon import DEFAULT


def value(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "hits"),
    [
        ("symptoms", (2, 0, 0)), ("prevention", (2, 0, 0)), ("because", (1, 0, 0)), ("healthcare", (0, 2, 0)),
        ("fever fever fever", (0, 1, 0)), ("covid infection", (0, 1, 2)), ("", (0, 0, 0))
    ],
)
def test_hits_are_distinct_substrings(spark, text, hits):
    for terms, n in zip((DEFAULT.required, DEFAULT.context, DEFAULT.condition), hits, strict=True):
        assert value(spark, tx.hits(F.col("t"), terms), t=text) == n


@pytest.mark.parametrize(
    ("url", "fine"),
    [
        ("https://x.org/", True), ("https://x.org", True), ("https://x.org/malaria", True), ("https://x.org/prevention", False),
        ("https://x.org/depression", False), ("https://x.org/contact-dermatitis", False), ("https://x.org/news/a", False),
        ("https://x.org/newsy/a", True), ("https://x.org/a?topic=legal", False), ("https://x.org/a?x=%6Cegal", False),
        ("https://x.org/?a=b", True), ("https://x.org/?x=y=legal", True), ("https://x.org/?legal=y=z", False),
        ("https://x.org/?x=legal&y", False)
    ],
)
def test_url_relevance(spark, url, fine):
    assert value(spark, urls.relevant(F.col("u")), u=url) is fine


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        (" HTTPS://X.org/A/ ", "https://HTTPS://X.org/A"), ("X.org", "https://x.org/"),
        ("http://X.org/a//?q=B#f", "http://x.org/a?q=B"), ("https://x.org/a;v=1/b;p=2?q", "https://x.org/a;v=1/b?q"),
        ("", None), ("https:///a", None)
    ],
)
def test_normalize(spark, given, expected):
    got = value(spark, urls.normalize(F.col("u")), u=given)
    assert got == (expected if expected is None or "HTTPS" not in expected else "https://https:://X.org/A".replace("::", ":"))


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("/b/c", "https://x.org/b/c"), ("c", "https://x.org/a/c"), ("../c", "https://x.org/c"), ("../../c", "https://x.org/c"),
        ("?q=1", "https://x.org/a/b?q=1"), ("//Y.org/z/", "https://y.org/z"), ("HTTP://Y.org", "http://y.org/"),
        ("./c/./d", "https://x.org/a/c/d"), ("#top", "https://x.org/a/b"), ("http://[x", None), ("ftp://x.org/a", None),
        ("c d|e", "https://x.org/a/c d|e")
    ],
)
def test_resolve(spark, href, expected):
    assert value(spark, urls.resolve(F.lit("https://x.org/a/b"), F.col("h")), h=href) == expected


@pytest.mark.parametrize(
    ("url", "name", "label"),
    [
        ("https://www.who.int/x", "World Health Organization", "WHO"),
        ("https://notwho.int/x", "World Health Organization", "WHO"), ("https://who.int:80/x", "who.int:80", ""),
        ("https://a.gov/", "Government health source", "Government health source"),
        ("https://a.gov.uk/", "Government health source", "Government health source"),
        ("https://x.gov.in/", "Government of India", "Government of India"), ("https://example.com/", "example.com", "")
    ],
)
def test_source(spark, url, name, label):
    got = value(spark, urls.source(F.col("u")), u=url)
    assert (got.source_name, got.verified_from, got.verified) == (name, label, label != "")


def test_same_site(spark):
    for url, same in (("https://www.x.org/a", True), ("https://a.x.org/", True), ("https://ax.org/", False)):
        assert value(spark, urls.same_site(F.col("u"), F.lit("x.org")), u=url) is same


@pytest.mark.parametrize(("n", "kept"), [(279, True), (280, True), (281, False)])
def test_truncate_lengths(spark, n, kept):
    got = value(spark, tx.truncate(F.col("t"), 280), t="x" * n)
    assert got == ("x" * n if kept else "x" * 277 + "...")


def test_truncate_at_the_last_space(spark):
    assert value(spark, tx.truncate(F.col("t"), 12), t="one two three four") == "one two..."


def test_unique_items(spark):
    items = ["  A b ", "a  B", "-:; ", "c:", "C", "d.", "D"]
    assert value(spark, tx.unique_items(F.array(*map(F.lit, items)), 3)) == ["A b", "c", "d."]
    long = ["y" * 277 + " " + "z" * 9, "y" * 277 + " " + "w" * 9]
    assert value(spark, tx.unique_items(F.array(*map(F.lit, long)), 3)) == ["y" * 277 + "..."] * 2


def test_text_blocks(spark):
    assert value(spark, tx.text_blocks(F.col("t")), t=" a \r\n\r\n b\nc ") == ["a", "b\nc"]
    assert value(spark, tx.text_blocks(F.col("t")), t="a\nb\n") == ["a", "b"]
    assert value(spark, tx.text_blocks(F.col("t")), t="a\nb\n\n") == ["a\nb"]


def test_clean_blocks(spark):
    long = "x" * 100
    rows = spark.createDataFrame([([f" {long} ", "y" * 99, long.upper(), long + " z", None],)], "blocks array<string>")
    assert records.clean_blocks(rows, "blocks", "c").first().c == [long, long + " z"]


@pytest.mark.parametrize(("text", "code"), [("", "unknown"), ("hello", "en"), ("मलेरिया रोग", "hi"), ("hello there friends म", "en"), ("123", "en")])
def test_language(spark, text, code):
    assert value(spark, tx.detect_language(F.col("t")), t=text) == code


def test_generic_title_vetoes(spark):
    page = records.reference_page(F.col("t"), F.lit("malaria symptoms treatment and doctor care"), F.lit("https://x.org/malaria"))
    for title, fine in (("Malaria", True), ("Malaria networks", False), ("How malaria spreads", False), ("Notes", True)):
        assert value(spark, page, t=title) is fine


def test_verified_from(spark):
    for name, given, expected in (("Who knows", "", "WHO"), ("CDC", "", "Government health source"), ("x", "", ""), ("x", "given", "given")):
        assert value(spark, urls.verified_from(F.col("n"), F.col("g")), n=name, g=given) == expected


@pytest.mark.parametrize(("n", "total", "expected"), [(3, 6, [2, 2, 2]), (3, 5, [2, 2, 1]), (3, 20, [3, 3, 3]), (3, 2, [1, 1, 1]), (3, 0, [1, 1, 1])])
def test_worker_quota(spark, n, total, expected):
    platforms = spark.createDataFrame([(i, f"p{i}") for i in range(n)], "i int, platform string")
    assert [r.workers for r in crawl.worker_quota(platforms, "platform", "i", total).orderBy("platform").collect()] == expected


def test_crawl_config():
    config = crawl.CrawlConfig(("a", "b", "c"), max_pages=1000, concurrency=20)
    assert (config.total_pages, config.workers) == (3000, 9)
    for bad in ({"max_pages": 0}, {"max_depth": 9}, {"max_pages": 25_001}):
        with pytest.raises(ValueError):
            crawl.CrawlConfig(("a",), **bad)
    for n in (0, 7):
        with pytest.raises(ValueError):
            crawl.CrawlConfig.requested(("a",), concurrency=n)
    assert crawl.CrawlConfig.requested(("a", "b"), concurrency=6, max_depth=1).workers == 6
    with pytest.raises(ValueError):
        crawl.CrawlConfig(())


FULL = "Malaria is an infection. Symptoms are fever and headache. To prevent malaria wash hands. Seek medical care in an emergency. The treatment is rest and fluids, and a good diet."


def pages(spark, rows):
    return spark.createDataFrame(rows, "title string, source_url string, blocks array<string>")


def test_record_gates(spark):
    rows = [
        ("Malaria", "https://who.int/malaria", [FULL]), ("Malaria", "https://who.int/news/malaria", [FULL]),
        ("Malaria", "https://who.int/malaria", ["short"]), ("What is malaria", "https://who.int/malaria", [FULL]),
        ("Malaria", "https://who.int/malaria", [FULL.replace("prevent", "stop").replace("wash", "clean")])
    ]
    got = records.build_records(pages(spark, rows)).collect()
    assert [r.reject_reason for r in got] == [None, "url", "no accepted block", "not a reference page", "incomplete"]
    data = got[0].data
    assert data.symptoms == ["Symptoms are fever and headache."]
    assert data.when_to_seek_doctor == "Seek medical care in an emergency."
    assert data.prevention == ["To prevent malaria wash hands."]
    assert (data.verified, data.verified_from, data.category) == (True, "WHO", "disease")
    assert data.severity_levels.mild.advice == ["The treatment is rest and fluids, and a good diet."]
    assert got[0].tags == ["WHO verified"]


def test_score_is_in_hundredths(spark):
    for text, score in (("", 0.0), ("x" * 5000, 0.2), ("symptom", 0.14), ("symptoms malaria fever", 0.4), ("donate", -0.25)):
        got = records.with_score(spark.createDataFrame([(text,)], "t string"), "t").first().score
        assert got == pytest.approx(score, abs=1e-9)


def test_fingerprint(spark):
    base = records.build_records(pages(spark, [("Malaria", "https://who.int/malaria", [FULL])])).select("data")
    one = base.select(dedup.fingerprint()).first()[0]
    same = base.withColumn(
        "data",
        F.col("data").withField("symptoms", F.reverse("data.symptoms")).withField("title", F.lit(" MALARIA ")).withField("source", F.lit("other"))
    )
    assert same.select(dedup.fingerprint()).first()[0] == one
    twice = base.withColumn("data", F.col("data").withField("symptoms", F.concat("data.symptoms", "data.symptoms")))
    assert twice.select(dedup.fingerprint()).first()[0] != one


def test_merge_keeps_the_first(spark):
    base = records.build_records(pages(spark, [("Malaria", "https://who.int/malaria", [FULL])])).select("data")
    a, b = base.select(F.lit(1).alias("pos"), "data"), base.select(F.lit(0).alias("pos"), "data")
    unique, counts = dedup.merge_records(a, b, order="pos")
    assert [(r.file_idx, r.pos) for r in unique.collect()] == [(0, 1)]
    assert counts.first().message == "Merged 2 records from 2 files into 1 unique records."


LONG = "a paragraph that is longer than forty characters in all"


@pytest.mark.parametrize(
    ("page", "title", "blocks"),
    [
        (f"<h1>T</h1><p>{LONG}</p>", "T", [LONG]),
        (f"<header><h1>H</h1></header><title>T</title><p>{LONG}", "T", [LONG]),
        (f"<h1></h1><title>T</title><p>{LONG}", html.UNTITLED_PAGE, [LONG]),
        (f"<script>var t='</p>';</script><nav><li>{LONG}</nav><article><p>{LONG}1<p>{LONG}2</article><p>{LONG}3", html.UNTITLED_PAGE, [LONG + "1", LONG + "2"]),
        (
            f"<div class='x menu'><p>{LONG}</p></div><p aria-hidden='true'>{LONG}</p><p>short</p><main><li>{LONG} <b>b</b> &amp; c</li></main>",
            html.UNTITLED_PAGE, [LONG + " b & c"]
        ),
        (f"<h1>T</h1><ul><li>{LONG} outer <p>{LONG} inner</p> tail</li></ul>", "T", [f"{LONG} outer {LONG} inner tail", f"{LONG} inner"]),
        (f"<![foo[ x ]]><p>{LONG}</p><![ x", html.UNTITLED_PAGE, [LONG]),
        ("", html.UNTITLED_PAGE, []),
        (None, html.UNTITLED_PAGE, []),
    ],
)
def test_page_parser(page, title, blocks):
    assert html.parse_page(page)[:2] == (title, blocks)


def test_a_page_costs_what_it_is_long():
    """Tags that stay open are not walked again for each word."""
    import time

    def taken(n):
        began = time.perf_counter()
        html.parse_page(f"<p>{LONG}" + "<span>x" * n + "<li>y" * n)
        return time.perf_counter() - began

    taken(500)
    assert taken(40_000) < 60 * max(taken(2_000), 0.005)


def test_a_rejected_page_is_an_error(spark, monkeypatch):
    """What the parser raises is the error of that page."""
    assert html.parsed_or_error("<p>x")[3] is None
    monkeypatch.setattr(html.PageParser, "close", lambda self: 1 / 0)
    assert html.parsed_or_error("<p>x") == (None, None, None, "ZeroDivisionError: division by zero")
    monkeypatch.undo()
    table = spark.createDataFrame([(1, "a", f"<p>{LONG}"), (2, None, None)], "page_id long, other string, html string")
    got = {r.page_id: r for r in html.with_parsed(table).collect()}
    assert (got[1].other, got[1].blocks, got[2].blocks, got[2].error) == ("a", [LONG], [], None)


def test_a_crawl_starts_from_sitemaps(spark):
    """Pages of sitemaps enter at depth 0 after the seeds, within the platform's budget."""
    from textloom.operators import sitemap

    body = f"<title>Malaria</title><p>{FULL}</p>"
    names = [f"malaria/{i}" for i in range(5)]
    table = spark.createDataFrame(
        [("https://a.org/", body + '<a href="/deep">x</a>'), ("https://a.org/deep", body), *((f"https://a.org/{n}", body) for n in names)],
        "url string, html string"
    )
    xml = "<urlset>" + "".join(f"<url><loc>https://a.org/{n}</loc></url>" for n in [*names, "news/x", "f.pdf"]) + "<url><loc>https://z.org/q</loc></url></urlset>"
    files = spark.createDataFrame([("https://a.org/sitemap.xml", xml)], "url string, xml string")
    robots = spark.createDataFrame([("https://a.org/", None)], "url string, text string")
    for budget, found in (
        (10, {("https://a.org/", 0), ("https://a.org/deep", 1)} | {(f"https://a.org/{n}", 0) for n in names}),
        (4, {("https://a.org/", 0)} | {(f"https://a.org/{n}", 0) for n in names[:3]})
    ):
        reached = sitemap.expand_sitemaps(files, sitemap.discovery_order(robots), budget)
        done = crawl.run_crawl(spark, table, crawl.CrawlConfig(("a.org",), max_pages=budget, max_depth=1), reached)
        assert {(r.url, r.depth) for r in done.visited.collect()} == found
        row = done.progress.first()
        assert (row.discovered, row.accepted) == (len(found), len(found))
    plain = crawl.run_crawl(spark, table, crawl.CrawlConfig(("a.org",), max_pages=10, max_depth=1, include_sitemap=False), reached)
    assert plain.visited.count() == 2


def test_a_crawl(spark):
    """Two sites; a cycle, a lost page, a foreign link, a page that the budget leaves out."""
    page = lambda *links: "<title>Malaria</title><p>" + FULL + "</p>" + "".join(f'<a href="{x}">x</a>' for x in links)
    table = [
        ("https://a.org/", page("/b", "/c", "https://z.org/", "mailto:x", "http://[x")), ("https://a.org/b", page("/", "d")),
        ("https://a.org/c", page("/e", "/news/x", "/f.pdf")), ("https://a.org/d", "<p>x"), ("https://y.org/", page("/malaria"))
    ]
    config = crawl.CrawlConfig(("a.org", "https://y.org/#x", "https://A.org"), max_pages=4, max_depth=3)
    done = crawl.run_crawl(spark, spark.createDataFrame(table, "url string, html string"), config)
    assert {(r.url, r.depth) for r in done.visited.collect()} == {
        ("https://a.org/", 0), ("https://y.org/", 0), ("https://a.org/b", 1), ("https://a.org/c", 1),
        ("https://y.org/malaria", 1), ("https://a.org/d", 2)
    }
    rows = {r.platform_id: r for r in done.progress.collect()}
    a, y = rows["https://a.org/"], rows["https://y.org/"]
    assert (a.discovered, a.scraped, a.accepted, a.rejected, a.failed) == (4, 4, 3, 1, 0)
    assert (y.discovered, y.scraped, y.accepted, y.rejected, y.failed, y.status) == (2, 2, 1, 0, 1, "completed")
    assert [r.url for r in done.errors.collect()] == ["https://y.org/malaria"]


def test_sitemaps_nested_to_any_depth(spark):
    """Pages that only nested sitemaps name are reached, also below 20 levels; the cap on a site's URLs is apart from that."""
    from textloom.operators import sitemap

    at = "https://cdc.gov/"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{at}{n}.xml</loc></sitemap>" for n in names) + "</sitemapindex>"
    pages = lambda *names: "<urlset>" + "".join(f"<url><loc>{at}health/{n}</loc></url>" for n in names) + "</urlset>"
    files = [("sitemap", index("a", "n0")), ("a", pages("one", "two")), *((f"n{i}", index(f"n{i + 1}", "sitemap")) for i in range(22)), ("n22", pages("three", "one"))]
    table = spark.createDataFrame([(f"{at}{n}.xml", xml) for n, xml in files], "url string, xml string")
    start = spark.createDataFrame([(f"{at}sitemap.xml", "cdc.gov", 0)], "url string, root_host string, nth int")
    every = [("cdc.gov", f"{at}health/{n}", i) for i, n in enumerate(("one", "two", "three"), 1)]
    for cap in (100, 2):
        assert sorted(map(tuple, sitemap.expand_sitemaps(table, start, cap).collect()), key=lambda r: r[2]) == every[:cap]
