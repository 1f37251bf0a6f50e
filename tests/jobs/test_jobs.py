"""The jobs on copies of the tables: against their SQL, run twice, over growing input, and cut off in between."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import StreamingQueryException

from jobs import curate_documents, page_intake, queries
from jobs.common import read_config

SF = "/root/testdata/sf0.001"
ROOT = Path(queries.__file__).parent.parent


def by_sql(name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = con.sql(queries.oracle_sql()[name])
    return frame.columns, sorted(map(str, frame.fetchall()))


@pytest.mark.parametrize("name,table", [("job1_curate_documents", "documents"), ("job2_page_intake", "pages")])
def test_the_registered_query_is_its_sql(spark, name, table):
    before = spark.conf.getAll
    columns, want = by_sql(name, table)
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want and want
    assert spark.conf.getAll == before
    assert not spark.streams.active


def output(spark, path):
    return sorted(map(str, spark.read.parquet(path).collect()))


def test_curated_documents_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, copies that differ in case, a language that goes away between two runs."""
    said = "The station and the interesting thing that was said there, again and again and again."
    rows = [(i, said if i % 2 else said.upper(), "en", f"s{i % 3}", i) for i in range(40)]
    rows += [(100, None, "en", None, 0), (101, "", None, "s", 0), (102, f"{said}\n{said}\nWorthless things and the end of the station's line of thinking, all of it.", None, "s", 0), (None, said + " And more.", "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").write.parquet(f"{tmp_path}/in")
    config = queries.CONFIGS["curate_documents"]
    counts = curate_documents.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    assert counts == {"documents": 44, "without_blocks": 2, "blocks": 42, "rejected": 1, "kept": 2, "repeated": 40}
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(kept) == {0, None} and kept[0].lang == "en" and kept[None].lang == "de"
    first = output(spark, f"{tmp_path}/out")
    curate_documents.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    assert output(spark, f"{tmp_path}/out") == first
    spark.read.parquet(f"{tmp_path}/in").filter("doc_id > 100").write.parquet(f"{tmp_path}/less")
    curate_documents.run(spark, f"{tmp_path}/less", f"{tmp_path}/out", config)
    assert [r.lang for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["unknown"]
    spark.read.parquet(f"{tmp_path}/in").limit(0).write.parquet(f"{tmp_path}/none")
    assert curate_documents.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", config)["documents"] == 0


def grow(spark, folder, condition, change="url"):
    pages = spark.read.parquet(f"{SF}/pages.parquet").filter(condition).selectExpr("page_id", f"{change} AS url", "html")
    pages.coalesce(1).write.mode("append").parquet(folder)


def test_pages_are_taken_in_once_over_growing_input(spark, tmp_path):
    config, paths = queries.CONFIGS["page_intake"], [f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]
    grow(spark, paths[0], "page_id % 3 = 0")
    first = page_intake.run(spark, *paths, config)
    files = {p: p.stat().st_mtime_ns for p in Path(paths[1]).rglob("*.parquet")}
    grow(spark, paths[0], "page_id % 3 = 1")
    grow(spark, paths[0], "page_id % 6 = 0", "concat('  ', url, '#again')")  # known by another spelling
    grow(spark, paths[0], "page_id = 1", "cast(null as string)")
    second = page_intake.run(spark, *paths, config)
    third = page_intake.run(spark, *paths, config)
    assert first["written"] > 0 and second["without_url"] == 1 and third == {"batches": 0, "read": 0, "without_url": 0, "written": 0}
    assert files.items() <= {p: p.stat().st_mtime_ns for p in Path(paths[1]).rglob("*.parquet")}.items()
    # the same as all of them at once
    rest = [f"{tmp_path}/all", f"{tmp_path}/all-out", f"{tmp_path}/all-checkpoint"]
    grow(spark, rest[0], "page_id % 3 < 2")
    page_intake.run(spark, *rest, config)
    drop = lambda p: sorted(str(tuple(r)) for r in spark.read.schema(page_intake.TAKEN).parquet(p).drop("batch").collect())
    assert drop(paths[1]) == drop(rest[1])


def test_one_file_a_batch_gives_the_same_rows(spark, tmp_path):
    config, paths = queries.CONFIGS["page_intake"] | {"files_per_batch": 1}, [f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]
    for k in range(3):
        grow(spark, paths[0], f"page_id % 3 = {k}")
    grow(spark, paths[0], "page_id < 9")
    counts = page_intake.run(spark, *paths, config)
    rows = spark.read.schema(page_intake.TAKEN).parquet(paths[1]).collect()
    assert counts["batches"] == 4 and len({r.url for r in rows}) == len(rows) == counts["written"] == len(by_sql("job2_page_intake", "pages")[1])


def test_a_batch_that_was_cut_off_is_taken_again_whole(spark, tmp_path, monkeypatch):
    config, paths = queries.CONFIGS["page_intake"], [f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]
    grow(spark, paths[0], "page_id % 2 = 0")
    page_intake.run(spark, *paths, config)
    grow(spark, paths[0], "page_id % 2 = 1")
    said = page_intake.log.info

    def cut_off(text, *more):
        if "batch %d" in text:
            raise RuntimeError("cut off after the write, before the checkpoint")
        said(text, *more)

    monkeypatch.setattr(page_intake.log, "info", cut_off)
    with pytest.raises(StreamingQueryException):
        page_intake.run(spark, *paths, config)
    written = output(spark, paths[1])
    monkeypatch.undo()
    assert page_intake.run(spark, *paths, config)["batches"] == 1
    assert output(spark, paths[1]) == written and len(written) == len(by_sql("job2_page_intake", "pages")[1])


def test_the_command_line(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(20).write.parquet(f"{tmp_path}/in")
    given = ["--config", str(ROOT / "jobs/curate_documents.json"), "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"]
    done = subprocess.run([sys.executable, "-m", "jobs.curate_documents", *given], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "curate_documents: wrote" in done.stderr and spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert read_config(spark, str(ROOT / "jobs/page_intake.json")) == json.loads((ROOT / "jobs/page_intake.json").read_text())
