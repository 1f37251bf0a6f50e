"""The jobs as registered queries: each runs twice into one new folder and returns the output as it stands then. And their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import curate_documents, page_intake
from jobs.common import lexicon
from textloom.plans import oracle
from textloom.plans.lexicon import Lexicon
from textloom.plans.overlay import quoted
from textloom.plans.storage import shared_dir

HERE = Path(__file__).parent
CONFIGS = {name: json.loads((HERE / f"{name}.json").read_text(encoding="utf-8")) for name in ("curate_documents", "page_intake")}


def new_folder(spark: SparkSession, job: str) -> str:
    """A folder of its own in the shared one; its files stay."""
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_curate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "curate_documents")
    for _ in range(2):
        curate_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", CONFIGS["curate_documents"])
    return spark.read.parquet(f"{folder}/output").select(*curate_documents.COLUMNS)


def job2_page_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "page_intake")
    for _ in range(2):
        # as a pattern, the table may be one file or a folder of files
        page_intake.run(spark, f"{sf_dir}/pages.parque[t]", f"{folder}/output", f"{folder}/checkpoint", CONFIGS["page_intake"])
    return spark.read.schema(page_intake.TAKEN).parquet(f"{folder}/output").drop("batch")


def accepted_sql(blocks: str, key: str, words: Lexicon) -> str:
    """Relations from `blocks` (key, i, block) to `joined`: key, blocks, rejected, text, folded text and score."""
    hits = {name: oracle.hits("f", getattr(words, name)) if getattr(words, name) else "0" for name in ("required", "context", "condition")}
    strong = f"({hits['required']} > 0 AND NOT {oracle.any_of('f', words.excluded)} AND 2 * {hits['required']} + {hits['context']} + 2 * {hits['condition']} >= 4 AND ({hits['context']} > 0 OR {hits['condition']} > 0))"
    whole = oracle.score(hits["required"], hits["context"], hits["condition"], "length(f)", oracle.any_of("f", words.excluded), "f = ''")
    return f"""
normal AS (SELECT {key}, i, {oracle.ws('block')} AS block FROM {blocks}),
folded AS (SELECT {key}, i, block, {oracle.fold('block')} AS f FROM normal WHERE length(block) >= {words.min_block}),
cleaned AS (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY {key}, f ORDER BY i) = 1),
judged AS (SELECT *, {strong} AS strong FROM cleaned),
accepted AS (SELECT {key}, count(*) FILTER (strong) AS blocks, count(*) FILTER (NOT strong) AS rejected, coalesce(list(block ORDER BY i) FILTER (strong), []) AS a FROM judged GROUP BY {key}),
whole AS (SELECT {key}, blocks, rejected, array_to_string(a, chr(10) || chr(10)) AS text, {oracle.fold("array_to_string(a, ' ')")} AS f FROM accepted),
joined AS (SELECT *, round({whole}, 2) AS score FROM whole)"""


_DOCUMENTS = CONFIGS["curate_documents"]
JOB1_SQL = f"""
WITH parts AS (SELECT doc_id, unnest(a) AS block, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, {oracle.split_blocks("coalesce(text, '')")} AS a FROM documents)), {accepted_sql("parts", "doc_id", lexicon(_DOCUMENTS["lexicon"]))},
kept AS (SELECT d.doc_id, source, blocks, rejected, score, sha256(f) AS fingerprint, j.text, coalesce(lang, {quoted(_DOCUMENTS["default_lang"])}) AS lang FROM joined j JOIN documents d USING (doc_id) WHERE blocks > 0)
SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) = 1
"""

_PARSED = oracle.PARSED_PAGES
JOB2_SQL = f"""
WITH {_PARSED},
once AS (SELECT page_id, {oracle.normalize("url")} AS url FROM pages QUALIFY {oracle.normalize("url")} IS NOT NULL AND row_number() OVER (PARTITION BY {oracle.normalize("url")} ORDER BY page_id) = 1),
parts AS (SELECT page_id, unnest(z) AS block, generate_subscripts(z, 1) AS i FROM p), {accepted_sql("parts", "page_id", lexicon(CONFIGS["page_intake"]["lexicon"]))}
SELECT o.page_id, o.url, {oracle.root_host("o.url")} AS host, {oracle.source("o.url")[0]} AS source, CASE WHEN p.title = '' THEN {quoted(oracle.lx.UNTITLED_PAGE)} ELSE p.title END AS title, {oracle.LINKS} AS links,
    coalesce(blocks, 0) AS blocks, coalesce(rejected, 0) AS rejected, coalesce(score, 0.0) AS score, coalesce(text, '') AS text, '' AS error
FROM once o JOIN p USING (page_id) LEFT JOIN joined j USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_curate_documents": job1_curate_documents, "job2_page_intake": job2_page_intake}


def oracle_sql() -> dict[str, str]:
    return {"job1_curate_documents": JOB1_SQL, "job2_page_intake": JOB2_SQL}
