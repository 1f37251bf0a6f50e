"""What must not grow faster than the input, and what must not stop before its end."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import urls
from textloom.operators import crawl, html, records
from textloom.plans import catalog
from textloom.sources import web


def test_seed_lists_of_any_length(spark):
    """Sixty thousand seeds, every one twice and in another case: the first of each, in order."""
    n = 60_000
    given = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: F.concat(
        F.lit("https://A.org/"), i.cast("string"), F.lit("; 'HTTPS://a.org/"), i.cast("string"), F.lit("'"))), ",").alias("text"))
    began = time.monotonic()
    seeds = given.select(tx.seed_list(F.col("text")).alias("seeds")).first().seeds
    assert time.monotonic() - began < 60
    assert seeds == [f"https://A.org/{i}" for i in range(n, 0, -1)]


def test_seed_list_of_nothing(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, " ,;\n"), (3, "b,B,a;A,b")], "i int, text string")
    assert [r.seeds for r in rows.orderBy("i").select(tx.seed_list(F.col("text")).alias("seeds")).collect()] == [None, [], [], ["b", "a"]]


def _admitted(spark, n, start, **config):
    """Page k of a site links to 8k+1 to 8k+8, each link twice."""
    at = lambda k: F.concat(F.lit("https://a.org/malaria/"), k.cast("string"))
    to = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.col("id") * 8 + 1 + j % 8)
    links = spark.range(n).select(at(F.col("id")).alias("src"), F.posexplode(to).alias("pos", "to")).filter(F.col("to") < n).select("src", "pos", at(F.col("to")).alias("url"))
    seeds = [(f"https://a.org/malaria/{k}", f"https://a.org/malaria/{k}", "a.org", i) for i, k in enumerate(start)]
    seeds = spark.createDataFrame(seeds, "url string, platform_id string, root_host string, seq long")
    return crawl.frontier(spark, links, seeds, crawl.CrawlConfig(tuple(s.url for s in seeds.collect()), **config))


def test_a_crawl_without_a_budget_reaches_every_page(spark):
    """More than the job model's 25 000 pages of a platform, numbered level by level with no gap."""
    every = _admitted(spark, 37_000, [0], max_pages=None, max_depth=6)
    levels = every.groupBy("depth").agg(F.count("*").alias("n"), F.count_distinct("nth").alias("places"), F.min("nth").alias("first"), F.max("nth").alias("last")).orderBy("depth").collect()
    sizes = [1, 8, 64, 512, 4096, 37_000 - 4681]
    assert [(r.n, r.places, r.first, r.last) for r in levels if r.n] == [(n, n, 1, n) for n in sizes]


def test_no_budget_is_a_large_budget(spark):
    """Below a budget, both admit the same URLs in the same order."""
    both = [_admitted(spark, 500, [0, 7], max_pages=m, max_depth=3) for m in (None, 25_000)]
    plain, budget = ([(r.url, r.platform_id, str(r.seq), r.nth, r.depth) for r in v.select("url", "platform_id", F.to_json(F.struct("seq")).alias("seq"), "nth", "depth").orderBy("url").collect()] for v in both)
    assert plain == budget
    assert {str(v.schema["nth"].dataType) for v in both} == {"IntegerType()"}


def test_only_a_table_is_crawled_without_a_budget(spark):
    config = crawl.CrawlConfig(("https://a.org/",), max_pages=None)
    assert config.total_pages == 0
    with pytest.raises(ValueError):
        web.live_crawl(spark, config)
    with pytest.raises(ValueError):
        crawl.CrawlConfig.requested(("https://a.org/",), max_pages=None)


def test_cheap_normalising_is_normalising(spark):
    """Every kind of white space, alone, doubled, at the edges and beside letters of other scripts."""
    kinds = [*tx.WS_CHARS, "​", "…", "ü", "ᚁ", "१", "a", ""]
    given = [None, ""] + [f"{e}x{a}{b}üy {b}z{e}" for a in kinds for b in kinds for e in ("", a)]
    rows = spark.createDataFrame([(g,) for g in given], "t string")
    got = rows.select("t", tx.ws_normalize(F.col("t")).alias("a"), tx.ws_normalize_cheaply(F.col("t")).alias("b"), tx.ws_normalize_each(F.array("t"))[0].alias("c"))
    assert got.filter("not (a <=> b) or not (a <=> c)").count() == 0


def test_lines_end_at_every_line_end(spark):
    ends = ("\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ")
    rows = spark.createDataFrame([(f"a{e}ü b{e}~\x1fc",) for e in (*ends, "\x1f", "\xa0", "‧")], "t string")
    got = [r.b for r in rows.coalesce(1).select(tx.text_blocks(F.col("t")).alias("b")).collect()]
    assert got == [["a", "ü b", "~\x1fc"]] * len(ends) + [["a\x1fü b\x1f~\x1fc"], ["a\xa0ü b\xa0~\x1fc"], ["a‧ü b‧~\x1fc"]]


def test_merging_makes_each_record_once(spark):
    """The two files part the documents, so each document is cleaned in one of them: the filter stands on the scan in both."""
    frame = catalog.QUERIES["merge_datasets"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "Filter" in line and "doc_id" in line and "% 2" in line and "r#" not in line]
    assert len(below) == 2 and plan.count("Relation [") == 2


def test_parted_copies_are_all_copies(spark):
    sf = "/root/testdata/sf0.001"
    whole = catalog._copies(spark, sf)
    for k in (0, 1):
        part = catalog._copies(spark, sf, f"doc_id % 2 = {k}")
        assert part.count() > 0
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.filter(f"doc_id % 2 = {k}").collect()))


def test_gates_make_what_they_search_once(spark):
    """Not once for each of the terms that are looked for in it."""
    rows = spark.createDataFrame([], "title string, source_url string, blocks array<string>")
    plan = records.build_records(rows).select("reject_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"coalesce\(title#\d+, \)", plan)) <= 2  # for the gate, and for the record's title
    assert len(re.findall(r"coalesce\(source_url#\d+, \)", plan)) == 1
    asked = spark.createDataFrame([], "u string").select(urls.relevant(F.col("u")).alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract\(u#", asked)) == 2  # path and query


def test_a_text_is_not_searched_for_terms_that_hold_another_one_that_is_missing(spark):
    """The same counts as a search for each, nulls and repeated terms too."""
    r = random.Random(3)
    texts = [None, "", *("".join(r.choice("ab ") for _ in range(r.randrange(9))) for _ in range(150))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").cache()
    for terms in (("a", "ab", "ab", "bab", "b a"), ("bb", "abb", "abba", "a"), ("ab",), (), ("cause", "causes", "b")):
        got = rows.orderBy("i").select(tx.hits(F.col("t"), terms).alias("n"), tx.any_of(F.col("t"), terms).alias("some")).collect()
        for text, row in zip(texts, got, strict=True):
            if text is None and terms:
                assert row.n is None and row.some is None
            else:
                assert (row.n, row.some) == (sum(x in (text or "") for x in terms), any(x in (text or "") for x in terms)), (text, terms)
    rows.unpersist()


def test_blocks_of_parsed_pages_need_no_normalising(spark):
    """Every kind of white space, in runs and alone, and zero-width spaces: records are the same with the pass and without."""
    space = [*tx.WS_CHARS, "\u200b", " \u200b ", "\r\n", "&nbsp;", "&#8203;", " \u3000\t"]
    told = "Malaria is an infection and its symptoms are fever and cough.{}Treatment by a doctor helps,{}{}prevention is to avoid bites. Seek care if there is severe pain.{}"
    pages = [(i, f"<h1>Mal{s}aria</h1><p>{s}{told.format(s, s, s, s)}</p><p>{told.format('', s, ' ', s)} {i}</p>") for i, s in enumerate(space)]
    rows = html.with_parsed(spark.createDataFrame(pages, "page_id long, html string")).withColumn("source_url", F.lit("https://site.example/malaria")).drop("hrefs", "error")
    plain, even = ([str(x) for x in records.build_records(rows, even=e).orderBy("page_id").collect()] for e in (False, True))
    assert plain == even and len(plain) == len(space)
    assert rows.select(F.explode("blocks").alias("b")).filter(F.col("b") != tx.ws_normalize(F.col("b"))).count() == 0


def test_length_and_blankness_without_a_whole_pass(spark):
    texts = [None, "", " ", "\u3000\t", "\u3000x ", "é" * 99, "é" * 100, "𝄞" * 99, "𝄞" * 100, "x" * 99, "x" * 100, "x" * 400]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.at_least(F.col("t"), 100).alias("long"), tx.is_said(F.col("t")).alias("said")).collect()
    assert [r.long for r in got] == [None if t is None else len(t) >= 100 for t in texts]
    assert [r.said for r in got] == [None if t is None else t.strip() != "" for t in texts]
