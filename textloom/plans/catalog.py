"""The registered queries: one for each operator that SQL can state, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import urls
from textloom.operators import crawl, dedup, html, notes, records, sitemap
from textloom.plans import overlay
from textloom.plans.lexicon import DEFAULT as LEX
from textloom.sources import files, jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.documents(spark, sf_dir)


def _joined(column: Column | str, by: str = "|") -> Column:
    return F.md5(F.array_join(column, by))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.clean_blocks(_docs(spark, sf_dir).withColumn("blocks", tx.text_blocks(F.col("text"))), "blocks", "cleaned")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("low", tx.fold(F.col("text")))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.accept_blocks(_blocks(spark, sf_dir), "cleaned")


def _records(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return records.build_records(_docs(spark, sf_dir).filter(where).withColumn("blocks", tx.text_blocks(F.col("text"))))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.match_lists(records.with_sentences(_accepted(spark, sf_dir), "accepted"), whole="joined")


# Text.


@query
def ws_normalize(spark, sf_dir):
    said = tx.ws_normalize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(said).alias("text_md5"), F.length(said).cast("long").alias("chars"))


@query
def fold_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("text_md5"))


@query
def text_block_split(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", tx.text_blocks(F.col("text")).alias("a"), tx.text_blocks(F.col("raw")).alias("b"))
    return rows.select(
        "doc_id", F.size("a").cast("long").alias("n_text"), _joined("a").alias("text_md5"),
        F.size("b").cast("long").alias("n_raw"), _joined("b").alias("raw_md5")
    )


@query
def clean_blocks(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select("doc_id", F.posexplode("cleaned").alias("pos", "block"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("block").alias("block_md5"), F.length("block").cast("long").alias("chars"))


@query
def sentence_split(spark, sf_dir):
    said = tx.sentences(F.col("text"))
    return _docs(spark, sf_dir).withColumn("s", said).select("doc_id", F.size("s").cast("long").alias("n"), _joined("s").alias("sentences_md5"))


@query
def truncate_text(spark, sf_dir):
    said = tx.ws_normalize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *(tx.truncate(said, n).alias(f"cut_{n}") for n in (140, 280, 1200)))


@query
def unique_items(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tx.unique_items(tx.sentences(F.col("text")), 10), "|").alias("items"))


@query
def detect_language(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", tx.detect_language(F.element_at(F.split("text", "\n\n", -1), -1)).alias("of_snippet"),
        tx.detect_language(F.col("raw")).alias("of_raw")
    )


@query
def retry_after_parse(spark, sf_dir):
    given = overlay.pick("doc_id", ("5", " 12 ", "-3", "soon", "", "1.5", "+7", "Wed, 21 Oct"))
    return _docs(spark, sf_dir).select("doc_id", tx.retry_after_seconds(given).alias("seconds"))


@query
def seed_list_parse(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    per = rows.groupBy("host").agg(F.array_join(
        F.sort_array(F.collect_list(F.concat_ws("", F.lit('"'), "url", F.lit('"; '), F.upper("url"), F.lit(",,\n")))), "\t"
    ).alias("given"))
    return per.select("host", F.array_join(F.transform(tx.seed_list(F.col("given")), lambda x: F.lower(x)), "|").alias("seeds"))


# Scores and filters.


@query
def keyword_hits(spark, sf_dir):
    low = F.col("low")
    return _folded(spark, sf_dir).select(
        "doc_id", tx.hits(low, LEX.required).alias("required"), tx.hits(low, LEX.context).alias("context"),
        tx.hits(low, LEX.condition).alias("condition")
    )


@query
def required_and_context(spark, sf_dir):
    low = F.col("low")
    return _folded(spark, sf_dir).select("doc_id", tx.any_of(low, LEX.required).alias("has_required"), (tx.hits(low, LEX.context) >= 2).alias("has_context"))


@query
def excluded_content(spark, sf_dir):
    rows = _folded(spark, sf_dir).withColumn("low_raw", tx.fold(F.col("raw")))
    return rows.select("doc_id", tx.any_of(F.col("low"), LEX.excluded).alias("excluded"), tx.any_of(F.col("low_raw"), LEX.excluded).alias("raw_excluded"))


@query
def strong_block(spark, sf_dir):
    rows = records.settled(_blocks(spark, sf_dir), "judged", records.strong_blocks("cleaned")).select("doc_id", F.posexplode("judged").alias("pos", "block"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("block.ok").alias("strong"))


@query
def quality_score(spark, sf_dir):
    rows = _accepted(spark, sf_dir).withColumn("low", tx.fold(F.col("text")))
    return records.with_score(rows, "low", "score_of_text").select("doc_id", "score", "score_of_text")


@query
def block_filter_counts(spark, sf_dir):
    return _accepted(spark, sf_dir).select("doc_id", F.size("accepted").cast("long").alias("accepted"), F.size("rejected").cast("long").alias("rejected"), "score")


@query
def source_filter_report(spark, sf_dir):
    return _accepted(spark, sf_dir).groupBy("src").agg(
        F.count("*").alias("documents"), F.sum(F.size("accepted").cast("long")).alias("accepted"),
        F.sum(F.size("rejected").cast("long")).alias("rejected"), F.round(F.max("score"), 2).alias("best_score")
    )


@query
def reference_page(spark, sf_dir):
    return _accepted(spark, sf_dir).select("doc_id", records.reference_page(F.col("title"), F.col("joined"), F.col("source_url")).alias("reference"))


# URLs.


def _urls(spark, sf_dir):
    return overlay.page_urls(spark, sf_dir).withColumn("u", urls.normalize(F.col("given")))


@query
def url_normalize(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", "given", F.col("u").alias("normalized"))


@query
def url_canonical(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query
def url_root_host(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.root_host(F.col("u")).alias("host"))


@query
def url_same_site(spark, sf_dir):
    host = urls.root_host(F.col("u"))
    base = F.when(F.col("page_id") % 3 == 0, host).when(F.col("page_id") % 3 == 1, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(F.lit("elsewhere.org"))
    return _urls(spark, sf_dir).select("page_id", urls.same_site(F.col("u"), base).alias("same_site"))


@query
def url_is_html(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.is_page(F.col("u")).alias("is_page"))


@query
def url_relevant(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.relevant(F.col("u")).alias("relevant")).unionByName(_docs(spark, sf_dir).select(
        (-1 - F.col("doc_id")).alias("page_id"), urls.relevant(F.col("source_url")).alias("relevant")
    ))


@query
def source_classify(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("s", urls.source(F.col("source_url")))
    return rows.select("doc_id", "s.source_name", "s.verified", "s.verified_from", F.array_join("s.tags", "|").alias("tags"))


@query
def verified_from_infer(spark, sf_dir):
    name = overlay.pick("doc_id", ("World Health Organization", "Who knows", "A government site", "CDC", "Nobody", "the NHS"))
    given = overlay.pick("doc_id", ("", "", "", "", "", "", "given"))
    return _docs(spark, sf_dir).select("doc_id", urls.verified_from(name, given).alias("verified_from"))


# Structure.


def _match(name):
    def run(spark, sf_dir):
        return _matched(spark, sf_dir).select("doc_id", F.array_join(name, "|").alias(name))

    return run


for _key, _name in (
    ("match_symptoms", "symptoms"), ("match_prevention", "prevention"), ("match_warning", "warning_signs"),
    ("match_home_care", "home_care"), ("match_lifestyle", "lifestyle_tips")
):
    QUERIES[_key] = _match(_name)


@query
def symptom_buckets(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", F.array_join("data.common_symptoms", "|").alias("common"), F.array_join("data.rare_symptoms", "|").alias("rare"))


@query
def description(spark, sf_dir):
    return _accepted(spark, sf_dir).select("doc_id", records.description("accepted").alias("description"))


@query
def infer_title(spark, sf_dir):
    return _accepted(spark, sf_dir).select("doc_id", records.title(F.col("title"), "accepted").alias("title"), records.title(F.lit(""), "accepted").alias("own_title"))


@query
def seek_doctor(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "data.when_to_seek_doctor")


@query
def severity_levels(spark, sf_dir):
    bands = [F.array_join(f"data.severity_levels.{b}.{k}", "|").alias(f"{b}_{k}") for b in ("mild", "moderate", "severe") for k in ("conditions", "advice")]
    return _records(spark, sf_dir).select("doc_id", *bands)


def _flat(name: str) -> Column:
    c = F.col(f"data.{name}")
    return (F.array_join(c, "|") if name in files.lx.LIST_FIELDS else c).alias(name)


_PLAIN = tuple(f for f in files.lx.EXPORT_FIELDS if f not in ("severity_levels", "confidence_rules"))


@query
def structured_record(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", *map(_flat, _PLAIN), "data.confidence_rules.min_symptoms_match", "data.confidence_rules.high_confidence_threshold")


@query
def complete_fields(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", records.complete().alias("complete"))


@query
def record_gate(spark, sf_dir):
    rows = _records(spark, sf_dir).filter("reject_reason is null")
    return rows.select("doc_id", "language", "score", F.array_join("tags", "|").alias("tags"), _joined("accepted").alias("blocks_md5"))


@query
def reject_reasons(spark, sf_dir):
    return _records(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def extract_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("blocks", tx.text_blocks(F.col("text")))
    docs = docs.select(
        "doc_id", "title", "blocks", F.lit("upload").alias("source_name"), F.lit("").alias("source_url"),
        F.lit(False).alias("verified"), F.lit("").alias("verified_from")
    )
    rows = records.extract_documents(docs)
    return rows.select("doc_id", "language", "score", "error", F.col("data.title").alias("title"), F.size("accepted").cast("long").alias("accepted"))


# Fingerprints and merging.


def _copies(spark, sf_dir, where="true"):
    """Complete records, of the documents with that, with a re-cased copy of every third."""
    rows = records.settled(_records(spark, sf_dir, where), "whole", records.complete()).filter("whole").select("doc_id", "data")
    again = F.col("data").withField("title", F.upper("data.title")).withField("description", F.concat(F.lit("  "), F.upper("data.description")))
    one = lambda doc_id, data: F.struct(doc_id.alias("doc_id"), data.alias("data"))
    both = F.array(one(F.col("doc_id"), F.col("data")), F.when(F.col("doc_id") % 3 == 0, one(F.col("doc_id") + 1_000_000_000, again)))
    rows = rows.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r")).select("r.doc_id", "r.data")
    # Descriptions hold the driver's text and so tell all records apart; half of them get the same one.
    return rows.withColumn("data", F.when(F.col("doc_id") % 2 == 0, F.col("data").withField("description", F.lit("same"))).otherwise(F.col("data")))


@query
def record_fingerprint(spark, sf_dir):
    return _copies(spark, sf_dir).select("doc_id", dedup.fingerprint().alias("fingerprint"))


@query
def dedup_records(spark, sf_dir):
    return dedup.deduplicate(_copies(spark, sf_dir), ["doc_id"]).select("doc_id", "fingerprint")


@query
def merge_datasets(spark, sf_dir):
    """Records of odd ids and of even ids, as two files. A copy's id is as odd as its document's, so the documents are parted before their records are made:
    a filter on the copies stays above the generators, and each half would make the records of all."""
    odd, even = (_copies(spark, sf_dir, f"doc_id % 2 = {k}") for k in (1, 0))
    return dedup.merge_records(odd, even, order="doc_id")[1]


@query
def ordered_tag_set(spark, sf_dir):
    tags = F.concat(urls.source(F.col("source_url"))["tags"], F.array(F.col("src"), F.lit("b"), F.col("src")))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(dedup.distinct_tags(tags), "|").alias("tags"))


@query
def bag_union(spark, sf_dir):
    a = _docs(spark, sf_dir).select("doc_id", F.explode(tx.text_blocks(F.col("raw"))).alias("block"))
    b = _docs(spark, sf_dir).select("doc_id", F.explode(tx.text_blocks(F.col("text"))).alias("block"))
    return a.union(b).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_distinct("block").alias("distinct_blocks"))


# HTML, sitemaps.


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query
def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.title_native(F.col("html")).alias("title"))


@query
def html_blocks(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(html.blocks_native(F.col("html"))).alias("pos", "block"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("block").alias("block_md5"))


@query
def html_links(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", "url", html.hrefs_native(F.col("html")).alias("hrefs"))
    links = html.page_links(rows.withColumnRenamed("url", "page_url"), urls.normalize(F.col("page_url")))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("url").alias("link"))


@query
def html_parsed_pages(spark, sf_dir):
    rows = html.parse_pages(_pages(spark, sf_dir).select("page_id", "html"))
    return rows.select(
        "page_id", "title", F.size("blocks").cast("long").alias("blocks"), _joined("blocks", "\n").alias("blocks_md5"),
        F.size("hrefs").cast("long").alias("links"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def html_lateral_blocks(spark, sf_dir):
    """Blocks and hrefs of pages by table functions in SQL."""
    html.register_sql(spark)
    return spark.sql(
        """SELECT page_id, 'block' AS what, pos, md5(block) AS text_md5 FROM {pages}, LATERAL page_blocks(html)
        UNION ALL SELECT page_id, 'href', pos, md5(href) FROM {pages}, LATERAL page_hrefs(html)""",
        pages=_pages(spark, sf_dir).select("page_id", "html")
    )


def _robots(spark, sf_dir):
    lines = F.concat(
        F.lit("User-agent: *\nDisallow: /x\nSITEMAP:  https://"), "host", F.lit("/a.xml \nSitemap:https://"), "host",
        F.lit("/b.xml\n sitemap: no\nsitemap:\n")
    )
    hosts = _pages(spark, sf_dir).select(F.lower(F.regexp_extract("url", "://([^/]+)", 1)).alias("host")).distinct()
    return hosts.withColumn("text", lines).withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/")))


@query
def robots_sitemaps(spark, sf_dir):
    return _robots(spark, sf_dir).select(
        "host", F.posexplode(sitemap.robots_sitemaps(F.col("text"))).alias("pos", "sitemap")
    ).withColumn("pos", F.col("pos").cast("long"))


def _sitemap_files(spark, sf_dir):
    """Of each host: sitemap.xml names two others and itself, one of them is broken, one has URLs of every kind."""
    hosts = _robots(spark, sf_dir).select("host")
    at = lambda name: F.concat(F.lit("https://"), "host", F.lit(f"/{name}.xml"))
    loc = lambda url: F.concat(F.lit("<sitemap><loc> "), url, F.lit(" </loc></sitemap>"))
    page = lambda path: F.concat(F.lit("<url><loc>https://"), "host", F.lit(f"{path}</loc></url>"))
    index = F.concat(
        F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc(at("a")),
        loc(at("b")), loc(at("sitemap")), F.lit("</sitemapindex>")
    )
    urlset = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), page("/one"), page("/two?a=1&amp;b=2"),
        page("/x.pdf"), page("/news/a"), page("/one"), F.lit("<url><loc>https://other.org/z</loc></url></urlset>")
    )
    broken = F.concat(F.lit("<urlset>"), page("/lost"), F.lit("<url>"))
    more = F.concat(F.lit("<urlset>"), page("/three"), page("/one"), F.lit("</urlset>"))
    nested = F.concat(F.lit("<sitemapindex>"), loc(at("c")), loc(at("d")), F.lit("</sitemapindex>"))
    files_ = {"sitemap": index, "a": urlset, "b": nested, "c": broken, "d": more}
    return functools.reduce(DataFrame.union, (hosts.select(at(n).alias("url"), x.alias("xml")) for n, x in files_.items()))


@query
def sitemap_urls(spark, sf_dir):
    rows = _sitemap_files(spark, sf_dir).select(F.col("url").alias("sitemap"), sitemap.parse_sitemap(F.col("xml")).alias("p"))
    return rows.select("sitemap", F.array_join("p.urls", "|").alias("urls"), F.array_join("p.nested", "|").alias("nested"))


@query
def sitemap_recursive(spark, sf_dir):
    start = sitemap.discovery_order(_robots(spark, sf_dir).select("url", "text"))
    return sitemap.expand_sitemaps(_sitemap_files(spark, sf_dir), start, 2)


# Crawls.


@query
def worker_quota(spark, sf_dir):
    hosts = _pages(spark, sf_dir).select(F.lower(F.regexp_extract("url", "://([^/]+)", 1)).alias("platform_id")).distinct()
    every = hosts.agg(F.count("*").alias("n")).first()["n"]
    return functools.reduce(
        DataFrame.union,
        (crawl.worker_quota(hosts, "platform_id", "platform_id", t).withColumn("total", F.lit(t)) for t in (1, every + 3, 3 * every, 10 * every))
    )


def _graph(spark, sf_dir):
    """Links of page i to pages 2i+1, 2i+2 and itself, all on one site; seeds are the first two pages, as two platforms."""
    n = _pages(spark, sf_dir).agg(F.count("*").alias("n"))
    at = lambda i: F.concat(F.lit("https://site.example/p/"), i.cast("string"))
    ids = _pages(spark, sf_dir).select("page_id").crossJoin(F.broadcast(n))
    to = ids.select(
        "page_id",
        F.posexplode(F.array((F.col("page_id") * 2 + 1) % F.col("n"), (F.col("page_id") * 2 + 2) % F.col("n"), F.col("page_id"))).alias("pos", "to")
    )
    links = to.select(at(F.col("page_id")).alias("src"), "pos", at(F.col("to")).alias("url"))
    start = spark.createDataFrame(
        [(f"https://site.example/p/{i}", f"https://site.example/p/{i}", "site.example", i) for i in (0, 1)],
        "url string, platform_id string, root_host string, seq long"
    )
    return links, start


@query
def crawl_frontier(spark, sf_dir):
    links, start = _graph(spark, sf_dir)
    config = crawl.CrawlConfig(("https://site.example/p/0", "https://site.example/p/1"), max_pages=25_000, max_depth=4)
    return crawl.frontier(spark, links, start, config).select("url", F.col("depth").cast("long").alias("depth"))


@query
def page_budget(spark, sf_dir):
    links, start = _graph(spark, sf_dir)
    config = crawl.CrawlConfig(("https://site.example/p/0", "https://site.example/p/1"), max_pages=9, max_depth=8)
    return crawl.frontier(spark, links, start, config).groupBy("platform_id").agg(F.count("*").alias("discovered"))


def _crawl_pages(spark, sf_dir):
    """The driver's pages on two sites, by turns, with a snippet in each; page k of a site links to 8k+1 to 8k+8, round and round."""
    pages = _pages(spark, sf_dir)
    sizes = pages.groupBy((F.col("page_id") % 2).alias("site")).agg(F.count("*").alias("m"))
    k = F.floor(F.col("page_id") / 2)
    links = F.concat(*(F.concat(F.lit('<a href="/malaria/'), ((k * 8 + j) % F.col("m")).cast("string"), F.lit('">next</a>')) for j in range(1, 9)))
    rows = pages.withColumn("site", F.col("page_id") % 2).join(F.broadcast(sizes), "site").filter("page_id % 7 <> 5")
    host = F.when(F.col("site") == 0, "https://a.example/malaria/").otherwise("https://b.example/malaria/")
    return rows.select(F.concat(host, k.cast("string")).alias("url"), overlay.page_html(links).alias("html"))


@query
def crawl_progress(spark, sf_dir):
    """Crawls every page; every seventh is lost."""
    config = crawl.CrawlConfig(("https://a.example/malaria/0", "b.example/malaria/0"), max_pages=None, max_depth=6)
    return crawl.run_crawl(spark, _crawl_pages(spark, sf_dir), config).progress


@query
def completion_message(spark, sf_dir):
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(crawl.completion_message(i % 2, i % 3, i % 5 == 0), F.lit("")).alias("message"))


@query
def note_runs(spark, sf_dir):
    """Runs of one kind of event in a user's events, the last 220 of each user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    rows = notes.tail(notes.runs(events, ["user_id"], ["ts", "event_id"], "event_type"), ["user_id"], "run", 220)
    return rows.select("user_id", "run", "event_type", "n", F.col("began.event_id").alias("first_event"), F.col("ended.event_id").alias("last_event"))


@query
def error_tail(spark, sf_dir):
    errors = _docs(spark, sf_dir).select("doc_id", F.concat("source_url", F.lit(": no page")).alias("error"))
    return crawl.error_tail(errors, "doc_id")


@query
def progress_percent(spark, sf_dir):
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", tx.progress_percent(i % 97, i % 31, i % 53, i % 80 + 1).cast("long").alias("percent"))


# Files and exports.


@query
def upload_decode(spark, sf_dir):
    good = F.base64(F.encode("text", "UTF-8"))
    given = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("!"), good)).otherwise(F.regexp_replace(good, r"\s", ""))
    return _docs(spark, sf_dir).select("doc_id", F.md5(files.decode_upload(given)).alias("content_md5"))


@query
def json_source(spark, sf_dir):
    """Two records a file, and items that are none; every third file wraps them, every fifth has another ending or is broken."""
    item = F.to_json(F.struct("title", F.col("source_url").alias("source_url"), F.array("src", F.lit("x")).alias("symptoms"), F.lit(1).alias("extra")))
    items = F.concat(F.lit("["), item, F.lit(", 5, null, \"s\", {\"title\": \"only\"}]"))
    body = F.when(F.col("doc_id") % 5 == 1, F.concat(items, F.lit("]"))).when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit('{"records": '), items, F.lit("}"))
    ).otherwise(items)
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 2, ".txt").otherwise(".JSON"))
    rows = files.json_records(_docs(spark, sf_dir).select(name.alias("filename"), body.alias("content")))
    return rows.select(
        "filename", F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"),
        F.coalesce("error", F.lit("")).alias("error"), F.coalesce("data.title", F.lit("")).alias("title"),
        F.coalesce(F.array_join("data.symptoms", "|"), F.lit("")).alias("symptoms"),
        F.coalesce("data.category", F.lit("")).alias("category")
    )


@query
def export_csv_rows(spark, sf_dir):
    rows = sinks.csv_rows(_records(spark, sf_dir).filter("reject_reason is null"))
    return rows.drop("severity_levels", "confidence_rules")


@query
def export_jsonl_rows(spark, sf_dir):
    rows = _records(spark, sf_dir).filter("reject_reason is null").select(
        "doc_id",
        F.from_json(
            sinks.json_line(),
            "data struct<title:string,symptoms:array<string>,verified:boolean>, raw_blocks array<string>, language string, quality_score double, tags array<string>"
        ).alias("j")
    )
    return rows.select(
        "doc_id", "j.data.title", F.array_join("j.data.symptoms", "|").alias("symptoms"), "j.data.verified",
        _joined("j.raw_blocks").alias("blocks_md5"), "j.language", "j.quality_score", F.array_join("j.tags", "|").alias("tags")
    )


@query
def job_views(spark, sf_dir):
    """The preview: the first ten accepted records by id. A report: the limit is the feature."""
    rows = _records(spark, sf_dir).filter("reject_reason is null").select("doc_id", "data.title", F.col("score").alias("quality_score"))
    return sinks.preview(rows.orderBy("doc_id"))


def _manifests(spark, sf_dir):
    """A manifest a document: states, queues, start URLs that repeat and platforms by doc_id, fields missing by turns."""
    i = F.col("doc_id")
    one = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    state = F.when(i % 7 == 6, F.lit(None)).otherwise(overlay.pick("doc_id", ("queued", "running", "paused", "completed", "failed")))
    item = F.struct(
        F.col("source_url").alias("url"), F.when(i % 4 == 0, F.col("src")).alias("platform_id"),
        F.when(i % 3 == 0, F.lit("host.org")).alias("root_host"), one("a", "").alias("tags")
    )
    platform = F.struct(F.col("src").alias("platform_id"), F.lit(9).alias("max_pages"))
    body = F.struct(
        i.cast("string").alias("job_id"),
        state.alias("status"),
        F.array("source_url", F.lit("https://cdc.gov/a"), "source_url", F.lit("")).alias("start_urls"),
        F.when(i % 2 == 0, i % 50).cast("int").alias("max_pages"),
        F.when(i % 3 != 1, F.array(item)).alias("queue_items"),
        F.when(i % 5 == 0, one("https://x.org/")).alias("in_progress_urls"),
        F.when(i % 2 == 1, F.array(platform, platform)).alias("platform_states"),
        F.transform(F.sequence(F.lit(1), (i % 40).cast("int") + 1), lambda x: F.concat(F.lit("e"), x.cast("string"))).alias("errors"),
    )
    return jobs.with_defaults(_docs(spark, sf_dir).select(F.from_json(F.to_json(body), jobs.MANIFEST).alias("j")).select("j.*"))


@query
def manifest_defaults(spark, sf_dir):
    rows = _manifests(spark, sf_dir)
    platform = F.try_element_at("platform_states", F.lit(1))
    item = F.try_element_at("queue_items", F.lit(1))
    return rows.select(
        "job_id", "status", "max_pages", "concurrency", F.array_join("start_urls", "|").alias("start_urls"),
        F.size("platform_states").cast("long").alias("platforms"), platform["label"].alias("label"),
        platform["max_pages"].alias("platform_pages"), item["platform_id"].alias("item_platform"),
        F.array_join(item["tags"], "|").alias("item_tags")
    )


@query
def pending_jobs(spark, sf_dir):
    return jobs.pending(_manifests(spark, sf_dir)).select("job_id", "status")


@query
def job_responses(spark, sf_dir):
    return jobs.job_view(_manifests(spark, sf_dir)).select(
        "job_id", F.array_join("errors", "|").alias("errors"), "download_csv_url",
        F.size("platform_progress").cast("long").alias("platforms")
    )


@query
def job_id_union(spark, sf_dir):
    rows = _manifests(spark, sf_dir)
    return jobs.job_ids(rows.filter("max_pages < 30"), jobs.pending(rows)).agg(F.count("*").alias("jobs"))


@query
def stream_equals_batch(spark, sf_dir):
    """Records of the pages by a stream, stopped and started again, beside those of the batch: one row of counts."""
    from textloom.plans.storage import new_path
    from textloom.streaming import incremental

    base = new_path(spark, "stream")
    pages = _pages(spark, sf_dir).select(
        "page_id", F.concat(F.lit("https://site.example/malaria/"), F.col("page_id").cast("string")).alias("url"),
        overlay.page_html().alias("html")
    )
    pages.filter("page_id % 2 = 0").write.parquet(f"{base}/in")
    for _ in range(2):
        incremental.start_export(incremental.read_pages(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    pages.filter("page_id % 2 = 1").write.mode("append").parquet(f"{base}/in")
    incremental.start_export(incremental.read_pages(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    streamed = spark.read.text(f"{base}/out").select("value")
    batch = incremental.page_records(incremental.once_per_url(pages)).filter("reject_reason is null").select(sinks.json_line().alias("value"))
    both = streamed.select("value", F.lit(1).alias("s"), F.lit(0).alias("b")).union(batch.select("value", F.lit(0), F.lit(1))).groupBy("value").agg(F.sum("s").alias("s"), F.sum("b").alias("b"))
    return both.agg(F.sum("s").alias("streamed"), F.sum("b").alias("batch"), F.count_if(F.col("s") != F.col("b")).alias("different"))


@query
def platform_counters(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("platform_id", urls.root_host(F.col("source_url")))
    return rows.groupBy("platform_id").agg(
        F.count("*").alias("scraped"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
    )


@query
def ordered_block_text(spark, sf_dir):
    """Ordered string aggregation: a conversation's texts in order of turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return rows.groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n\n")).alias("text_md5"), F.count("*").alias("blocks"))


@query
def head_limits(spark, sf_dir):
    """Head limits within a document: its first three and last two blocks."""
    rows = _blocks(spark, sf_dir)
    return rows.select(
        "doc_id", _joined(F.slice("cleaned", 1, 3)).alias("first_md5"),
        _joined(F.slice("cleaned", F.greatest(F.size("cleaned") - 1, F.lit(1)), F.lit(2))).alias("last_md5")
    )


@query
def visited_anti_join(spark, sf_dir):
    rows = _urls(spark, sf_dir).filter("u is not null").select("page_id", F.col("u").alias("url"))
    first = dedup.first_of_each(rows.filter("page_id % 2 = 0"), ["url"], ["page_id"])
    return first.join(rows.filter("page_id % 2 = 1").select("url"), "url", "left_anti").select("page_id", "url")

