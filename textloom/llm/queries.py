"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, langid, linededup, notices, packing, pii, piece_bpe, quality, repair, topk, training_order

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.turns_of_table(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chat.TURNS)
    return chat.read_back(chat.format_turns(turns.union(probe)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.site_line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cut.select("doc_id", "lines_total", "lines_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(nullif(regexp_extract(lower(source), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2), ''), source, chr(1) || 'none') AS host, text FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
seen AS (SELECT DISTINCT doc_id, host, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
n AS (SELECT host, line, count(*) AS n FROM seen GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY ALL),
bad AS (SELECT host, list(line) AS bad FROM n JOIN t USING (host) WHERE n >= 2 AND n > 0.1 * pages GROUP BY host),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS k FROM d LEFT JOIN bad USING (host))
SELECT doc_id, coalesce(len(a), 0)::BIGINT AS lines_total, coalesce(len(a) - len(k), 0)::BIGINT AS lines_dropped, sha256(coalesce(array_to_string(k, chr(10)), '')) AS text_sha256 FROM cut
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.learn(docs))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "class_links")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_BPE)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("cleaned")


_RULES = quality.LineRules()
_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT doc_id, i, w || chr(1) || lead(w, 1) OVER p || chr(1) || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, g FROM g WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN r USING (doc_id, g), range(0, 3) t(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
o AS (SELECT doc_id, line, i, lead(line) OVER (PARTITION BY doc_id, regexp_matches(line, '[^\x20\x09-\x0D]') ORDER BY i) AS following, row_number() OVER (PARTITION BY doc_id, trim(line, {_SQL_SPACE}) ORDER BY i) AS copy FROM l),
m AS (SELECT doc_id, line, following, copy, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own, trim(line, {_SQL_SPACE}) AS bare, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS nc, len(regexp_extract_all(line, '[#*$%&|<>]')) AS ns, lower(trim(line, {_SQL_SPACE})) AS low FROM o),
v AS (SELECT doc_id, line, nw, nw > 0 AND (
    ns > {_RULES.max_symbols}::DOUBLE * nc
    OR nw <= {_RULES.navigation_words} AND list_contains({_list(_RULES.navigation)}, trim(replace(trim(low, ' .:>»|-'), '»', '')))
    OR nw <= {_RULES.boilerplate_words} AND {_any("low", _RULES.boilerplate)}
    OR {_RULES.separator_words} * len(list_filter(own, lambda x: list_contains({_list(quality._SEPARATORS)}, x))) >= nw
    OR copy > {_RULES.copies}
    OR coalesce(list_position(list_transform(list_reverse(own), lambda x: list_contains({_list(quality._ENDS)}, right(x, 1))), true) - 1, nw) > {_RULES.heading_words} AND NOT coalesce(regexp_matches(following, '^[\x20\x09-\x0D]*\p{{Ll}}'), true)) AS gone FROM m),
f AS (SELECT doc_id, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup, count(*) FILTER (gone) AS lines_removed, coalesce(sum(nw) FILTER (gone), 0)::BIGINT AS words_removed FROM v GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, lines_removed, words_removed FROM a JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)),
e AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND words_removed <= {_RULES.max_lost}::DOUBLE * n_words AS kept FROM e
"""


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan_notices(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summaries(repair.damage(_table(spark, sf_dir, "conversations")))


def _cheapest(*ways: str) -> str:
    return f"nullif(least({', '.join(f'coalesce({w}, chr(126))' for w in ways)}), chr(126))"


def _way(state: str, cost: str, edit: str, row: str) -> str:
    """A state is the cost in 8 digits, the audit, chr(1) and the repaired rows, each with a newline before it; strings in order are costs in order, then audits."""
    mark = f"strpos({state}, chr(1))"
    return f"(lpad((left({state}, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({state}, 9, {mark} - 9) || '{edit}' || substr({state}, {mark}) || {row})"


def _filled(state: str, role: str) -> str:
    return _way(state, "2", "I", f"chr(10) || '{role}:'")


def _inserted(states: str) -> str:
    """The states n(othing yet), s, u and a, with the rows that may be inserted after each."""
    a = _cheapest("a", _filled("u", "assistant"), *(_filled(_filled(x, "user"), "assistant") for x in "ns"))
    u = _cheapest("u", *(_filled(x, "user") for x in "nsa"))
    return f"(SELECT * REPLACE ({u} AS u, {a} AS a) FROM {states})"


def _row(state: str, edit: str, role: str = "") -> str:
    """What the next row makes of a state by one edit."""
    if edit == "D":
        return _way(f"b.{state}", "3", "D", "''")
    if edit == "K":
        return f"CASE WHEN fault < 2 AND left(role, 1) = '{role[0]}' THEN {_way(f'b.{state}', 'late', 'K', "chr(10) || role || ':' || text")} END"
    return f"CASE WHEN fault < 2 THEN {_way(f'b.{state}', '2 + late', 'R', f"chr(10) || '{role}:' || text")} END"


_TO_S = _cheapest(_row("s", "D"), _row("n", "K", "system"))
_TO_U = _cheapest(_row("u", "D"), *(_row(x, e, "user") for x in "nsa" for e in "KR"))
_TO_A = _cheapest(_row("a", "D"), *(_row("u", e, "assistant") for e in "KR"))
_FIRST = "(SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' || chr(1) AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM conversations)"
_STEP = f"(SELECT b.conv_id, r.i, {_row('n', 'D')} AS n, {_TO_S} AS s, {_TO_U} AS u, {_TO_A} AS a FROM steps b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1)"
_BIT = "(CASE WHEN i % 8 = 0 THEN xor(c, ascii(k[i // 8 + 1])::BIGINT) ELSE c END)"
OP12_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
damaged AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], range(8 * length(k))), lambda c, i: xor({_BIT} // 2, ({_BIT} % 2) * 3988292384))) % 20 AS kind FROM keyed),
here AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM damaged, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, {_SQL_SPACE}) AS bare FROM here),
copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faults AS (SELECT *, CASE WHEN bare = '' THEN 2 WHEN nth > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM copies),
judged AS (SELECT *, (fault = 1)::INTEGER AS late FROM faults),
steps AS (SELECT conv_id, i, n, s, u, a FROM {_inserted(_FIRST)} UNION ALL SELECT conv_id, i, n, s, u, a FROM {_inserted(_STEP)}),
ends AS (SELECT conv_id, {_cheapest('n', 'a')} AS best FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    left(best, 8)::BIGINT AS cost, substr(best, 9, strpos(best, chr(1)) - 9) AS audit, sha256(substr(best, strpos(best, chr(1)) + 2)) AS repaired_sha256
FROM ends e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_training_order": op2_training_order,
        "op3_chat_format": op3_chat_format,
        "op4_line_dedup": op4_line_dedup,
        "op5_language_id": op5_language_id,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_top_k": op7_top_k,
        "op8_pieces": op8_pieces,
        "op9_personal_data": op9_personal_data,
        "op10_quality_rules": op10_quality_rules,
        "op11_license_scans": op11_license_scans,
        "op12_conversation_repair": op12_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_top_k": OP7_SQL, "op10_quality_rules": OP10_SQL, "op12_conversation_repair": OP12_SQL}
