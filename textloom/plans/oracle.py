"""The same results in DuckDB's SQL, written by relations where the engine works on arrays."""

from __future__ import annotations

from textloom.plans import lexicon as lx
from textloom.plans import overlay
from textloom.plans.lexicon import DEFAULT as LEX
from textloom.plans.overlay import pick_sql, quoted

WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ws(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(8203), ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def fold(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"


def hits(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, {quoted(t)})::INTEGER" for t in terms) + ")"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"


def truncate(x: str, n: int) -> str:
    return rf"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substring({x}, 1, {n - 3}), ' [^ ]*\z', '') || '...' END"


def split_blocks(x: str) -> str:
    lines = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
    parts = f"CASE WHEN len(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) <= 1 THEN regexp_split_to_array({x}, '{lines}') ELSE string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10) || chr(10)) END"
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


def sentences(x: str) -> str:
    marked = rf"string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_transform(list_filter({marked}, lambda x: regexp_replace(x, '{WS}', '', 'g') <> ''), lambda x: {ws('x')})"


def score(req: str, ctx: str, cond: str, n: str, excluded: str, empty: str) -> str:
    raw = f"least({req} * 14000 + {ctx} * 4000 + {cond} * 8000 + 4 * least({n}, 5000) - CASE WHEN {excluded} THEN 25000 ELSE 0 END, 100000)"
    return f"CASE WHEN {empty} THEN 0.0 ELSE (CASE WHEN {raw} >= 0 THEN ({raw} + 500) // 1000 ELSE -((500 - {raw}) // 1000) END) / 100.0 END"


def score_of(x: str) -> str:
    return score(hits(x, LEX.required), hits(x, LEX.context), hits(x, LEX.condition), f"length({x})", any_of(x, LEX.excluded), f"{x} = ''")


EDGE = quoted(" -:;")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_PARTS}', {n})"


def path(u: str) -> str:
    return rf"regexp_replace({part(u, 3)}, ';[^/]*\z', '')"


def canonical(u: str) -> str:
    u = strip(u)
    kept = rf"regexp_replace({path(u)}, '/+\z', '')"
    asked = rf"regexp_replace({part(u, 4)}, '^\?\z', '')"
    return f"lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || CASE WHEN {kept} = '' THEN '/' ELSE {kept} END || {asked}"


def normalize(u: str) -> str:
    s = strip(u)
    full = f"CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') THEN {s} ELSE 'https://' || {s} END"
    return f"CASE WHEN {s} <> '' AND {part(full, 2)} <> '' THEN {canonical(full)} END"


def root_host(u: str) -> str:
    return rf"regexp_replace(lower({part(u, 2)}), '^www\.', '')"


def is_page(u: str) -> str:
    return rf"NOT regexp_matches(lower({path(u)}), '\.({'|'.join(lx.NON_PAGE_EXTENSIONS)})\z')"


def relevant(u: str) -> str:
    where, asked = fold(path(u)), fold(f"substring({part(u, 4)}, 2)")
    both = f"({where} || ' ' || {asked})"
    segments = "[" + ", ".join(map(quoted, LEX.url_segments)) + "]"
    pairs = f"string_split(replace({asked}, '+', ' '), '&')"
    tokens = f"flatten(list_transform({pairs}, lambda x: list_transform(CASE WHEN contains(x, '=') THEN [x[:instr(x, '=') - 1], x[instr(x, '=') + 1:]] ELSE [x] END, lambda y: url_decode(y))))"
    return f"(trim({both}, ' /') = '' OR NOT (list_has_any(string_split({where}, '/'), {segments}) OR list_has_any({tokens}, {segments}) OR {any_of(both, LEX.url_substrings)}))"


def same_site(u: str, base: str) -> str:
    return f"({root_host(u)} = {base} OR ends_with({root_host(u)}, '.' || {base}))"


def by_source(host: str, values: list[str], otherwise: str) -> str:
    tests = []
    for endings, *_ in lx.SOURCES:
        tests.append(" OR ".join(f"ends_with({host}, {quoted(e)})" + (f" OR contains({host}, '.gov.')" if e == ".gov" else "") for e in endings))
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values, strict=True)) + f" ELSE {otherwise} END"


def source(u: str) -> tuple[str, str, str]:
    """Name, label and tag."""
    h = root_host(u)
    name = by_source(h, [quoted(x[2]) for x in lx.SOURCES], f"CASE WHEN {h} = '' THEN 'Web page' ELSE {h} END")
    return name, by_source(h, [quoted(x[1]) for x in lx.SOURCES], "''"), by_source(h, [quoted(x[3]) for x in lx.SOURCES], "''")


def verified_from(name: str, given: str) -> str:
    low = fold(name)
    return f"CASE WHEN {given} <> '' THEN {given} WHEN contains({low}, 'who') OR contains({low}, 'world health organization') THEN 'WHO' WHEN {any_of(low, ('government', 'cdc', 'nih', 'nhs'))} THEN 'Government health source' ELSE '' END"


def joined(x: str, by: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {quoted(by)}), '')"


# Relations that queries build on.

_STRONG = f"NOT {any_of('f', LEX.excluded)} AND {hits('f', LEX.required)} > 0 AND 2 * {hits('f', LEX.required)} + {hits('f', LEX.context)} + 2 * {hits('f', LEX.condition)} >= 4 AND ({hits('f', LEX.context)} > 0 OR {hits('f', LEX.condition)} > 0)"
RELATIONS = {
    "o": overlay.DOCUMENTS_SQL,
    "u": overlay.PAGE_URLS_SQL,
    "n": f"n AS (SELECT page_id, url, given, {normalize('given')} AS u FROM u)",
    "b": f"b AS (SELECT doc_id, unnest(a) AS raw_block, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, {split_blocks('text')} AS a FROM o))",
    "w": f"w AS (SELECT doc_id, i, {ws('raw_block')} AS block, {fold(ws('raw_block'))} AS f FROM b)",
    "c": f"c AS (SELECT doc_id, block, f, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS nth FROM w WHERE length(block) >= {LEX.min_block}) WHERE nth = 1)",
    "s": f"s AS (SELECT *, {_STRONG} AS strong FROM c)",
    "a": "a AS (SELECT o.doc_id, o.src, o.title, o.source_url, coalesce(list(block ORDER BY pos) FILTER (strong), []) AS accepted, count(*) FILTER (strong) AS n_accepted, count(*) FILTER (NOT strong) AS n_rejected FROM o LEFT JOIN s USING (doc_id) GROUP BY ALL)",
    "j": f"j AS (SELECT *, {fold(joined('accepted', ' '))} AS joined FROM a)",
    "q": f"q AS (SELECT *, {score_of('joined')} AS score FROM j)",
    "t": f"t AS (SELECT doc_id, i, generate_subscripts(z, 1) AS k, unnest(z) AS said FROM (SELECT doc_id, i, {sentences('block')} AS z FROM (SELECT doc_id, unnest(accepted) AS block, generate_subscripts(accepted, 1) AS i FROM a)))",
}
_CLASSES = LEX.sentence_classes()
_CLASS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {quoted(n)} AS class, i, k, said FROM t WHERE {any_of(fold('said'), terms)}" + (f" AND NOT {any_of(fold('said'), without)}" if without else "")
    for n, (terms, without) in _CLASSES.items()
)
RELATIONS["m"] = (
    f"m AS (SELECT doc_id, class, list(item ORDER BY i, k) AS items FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, class ORDER BY i, k) AS r FROM (SELECT doc_id, class, i, k, {truncate('item', 280)} AS item FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY doc_id, class, {fold('item')} ORDER BY i, k) AS nth FROM (SELECT *, trim({ws('said')}, {EDGE}) AS item FROM ({_CLASS_SQL})) WHERE item <> '') WHERE nth = 1)) WHERE r <= {LEX.sentence_limit} GROUP BY ALL)"
)
_LISTS = ", ".join(f"coalesce(max(items) FILTER (class = {quoted(n)}), []) AS {n}" for n in _CLASSES)
_NAME, _LABEL, _TAG = source("source_url")
_FIRST = f"coalesce({sentences('accepted[1]')}[1], accepted[1])"
_SEEK = f"list_filter({sentences(joined('accepted', ' '))}, lambda x: contains({fold('x')}, 'seek') AND {any_of(fold('x'), ('doctor', 'medical', 'care'))})[1]"


def _title(given: str) -> str:
    return f"CASE WHEN coalesce({given}, '') <> '' THEN {truncate(given, 140)} WHEN len(accepted) = 0 THEN {quoted(lx.UNTITLED_ENTRY)} ELSE {truncate(_FIRST, 140)} END"


_DESCRIPTION = truncate(joined("accepted[1:3]", " "), 1200)
_low_title, _low_url = fold(strip("title")), fold(strip("source_url"))
REFERENCE = f"(NOT {any_of(_low_title, LEX.generic_titles)} AND ({any_of('joined', LEX.condition)} OR {any_of(_low_title, LEX.condition)}) AND {any_of('joined', LEX.required)} AND ({any_of(_low_title, LEX.condition)} OR {any_of(_low_url, LEX.condition)}) AND ({hits('joined', LEX.context)} >= 2 OR {hits('joined', LEX.required)} >= 2))"


def language(x: str) -> str:
    letters, hindi = (rf"len(regexp_extract_all({x}, '{c}'))" for c in (r"\p{L}", r"[\x{0900}-\x{097F}]"))
    return f"CASE WHEN {x} = '' THEN 'unknown' WHEN {letters} > 0 AND 5 * {hindi} > {letters} THEN 'hi' ELSE 'en' END"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


RELATIONS["r"] = (
    f"r AS (SELECT *, CASE WHEN NOT relevant THEN 'url' WHEN len(accepted) = 0 THEN 'no accepted block' WHEN NOT reference THEN 'not a reference page' WHEN NOT complete THEN 'incomplete' END AS reject_reason FROM "
    f"(SELECT *, trim(d_title) <> '' AND len(symptoms) > 0 AND description <> '' AND len(warning_signs) > 0 AND seek <> '' AND len(prevention) > 0 AS complete FROM "
    f"(SELECT *, {_title('title')} AS d_title, {_DESCRIPTION} AS description, coalesce({truncate('found', 280)}, warning_signs[1], '') AS seek, {relevant('source_url')} AS relevant, {REFERENCE} AS reference, {_NAME} AS source_name, {_LABEL} AS label, {_TAG} AS tag, {language(joined('accepted', ' '))} AS language FROM "
    f"(SELECT *, {_SEEK} AS found FROM q JOIN (SELECT o.doc_id, {_LISTS} FROM o LEFT JOIN m USING (doc_id) GROUP BY ALL) USING (doc_id)))))"
)
_NEEDS = {
    "u": "", "n": "u", "b": "o", "w": "ob", "c": "obw", "s": "obwc", "a": "obwcs", "j": "obwcsa", "q": "obwcsaj",
    "t": "obwcsa", "m": "obwcsat", "r": "obwcsajqtm", "o": ""
}


def using(names: str, select: str, *more: str) -> str:
    """A query over the named relations and what they build on."""
    need = [k for k in RELATIONS if k in names or any(k in _NEEDS[x] for x in names)]
    return f"WITH {', '.join([*(RELATIONS[k] for k in need), *more])} {select}"


def _list(name: str, by: str = "|") -> str:
    return f"{joined(name, by)} AS {name}"


_VERIFIED = f"CASE WHEN label <> '' THEN {verified_from('source_name', 'label')} ELSE '' END AS verified_from"
def _record(by: str = "|") -> str:
    """The record's columns but the two nested ones, lists joined."""
    flat = lambda name, values: f"{joined(values, by)} AS {name}"
    lists = ", ".join([
        _list("symptoms", by), flat("common_symptoms", "symptoms[1:4]"), flat("rare_symptoms", "symptoms[5:8]"),
        flat("differential_questions", array(lx.QUESTIONS)),
        *(_list(n, by) for n in ("home_care", "lifestyle_tips", "warning_signs", "prevention")),
        flat("risk_groups", array(lx.RISK_GROUPS)), flat("possible_confusions", array(lx.CONFUSIONS))
    ])
    return f"d_title AS title, 'disease' AS category, {lists}, description, seek AS when_to_seek_doctor, source_name AS source, label <> '' AS verified, {_VERIFIED}, source_url"


def _some(name: str, default) -> str:
    return joined(f"CASE WHEN len({name}) > 0 THEN {name}[1:5] ELSE {array(default)} END")


def _fingerprint(title: str, description: str) -> str:
    norm = lambda x: fold(ws_plain(x))
    lists = {
        "symptoms": "symptoms", "common_symptoms": "symptoms[1:4]", "rare_symptoms": "symptoms[5:8]",
        "warning_signs": "warning_signs", "prevention": "prevention", "home_care": "home_care",
        "lifestyle_tips": "lifestyle_tips", "risk_groups": array(lx.RISK_GROUPS)
    }
    parts = {
        f: f"list_sort(list_filter(list_transform({v}, lambda x: {norm('x')}), lambda x: x <> ''))" for f, v in lists.items()
    } | {"title": norm(title), "description": norm(description), "source_url": norm("source_url")}
    return "sha256(to_json(struct_pack(" + ", ".join(f"{k} := {parts[k]}" for k in sorted(parts)) + "))::VARCHAR)"


def ws_plain(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


_COPIES = (
    "x0 AS (SELECT * FROM r WHERE complete), "
    "x1 AS (SELECT * EXCLUDE (d_title, description, doc_id), doc_id, d_title, description FROM x0 UNION ALL SELECT * EXCLUDE (d_title, description, doc_id), doc_id + 1000000000, upper(d_title), '  ' || upper(description) FROM x0 WHERE doc_id % 3 = 0), "
    "x2 AS (SELECT * EXCLUDE (description), CASE WHEN doc_id % 2 = 0 THEN 'same' ELSE description END AS description FROM x1), "
    f"x AS (SELECT doc_id, {_fingerprint('d_title', 'description')} AS fingerprint FROM x2)"
)

ORACLE = {
    "ws_normalize": using("o", f"SELECT doc_id, md5({ws('text')}) AS text_md5, length({ws('text')})::BIGINT AS chars FROM o"),
    "fold_text": using("o", f"SELECT doc_id, md5({fold('text')}) AS text_md5 FROM o"),
    "text_block_split": using(
        "o",
        f"SELECT doc_id, len(a)::BIGINT AS n_text, md5({joined('a')}) AS text_md5, len(b)::BIGINT AS n_raw, md5({joined('b')}) AS raw_md5 FROM (SELECT doc_id, {split_blocks('text')} AS a, {split_blocks('raw')} AS b FROM o)"
    ),
    "clean_blocks": using("c", "SELECT doc_id, pos, md5(block) AS block_md5, length(block)::BIGINT AS chars FROM c"),
    "sentence_split": using("o", f"SELECT doc_id, len(z)::BIGINT AS n, md5({joined('z')}) AS sentences_md5 FROM (SELECT doc_id, {sentences('text')} AS z FROM o)"),
    "truncate_text": using(
        "o",
        "SELECT doc_id, " + ", ".join(f"{truncate('x', n)} AS cut_{n}" for n in (140, 280, 1200)) + f" FROM (SELECT doc_id, {ws('text')} AS x FROM o)"
    ),
    "unique_items": using(
        "o",
        f"SELECT o.doc_id, coalesce(items, '') AS items FROM o LEFT JOIN (SELECT doc_id, string_agg(item, '|' ORDER BY k) AS items FROM (SELECT doc_id, k, {truncate('item', 280)} AS item, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {fold('item')} ORDER BY k) AS nth FROM (SELECT doc_id, k, trim({ws('said')}, {EDGE}) AS item FROM (SELECT doc_id, unnest(z) AS said, generate_subscripts(z, 1) AS k FROM (SELECT doc_id, {sentences('text')} AS z FROM o))) WHERE item <> '') WHERE nth = 1) WHERE r <= 10 GROUP BY doc_id) USING (doc_id)",
    ),
    "detect_language": using("o", f"SELECT doc_id, {language('string_split(text, chr(10) || chr(10))[-1]')} AS of_snippet, {language('raw')} AS of_raw FROM o"),
    "retry_after_parse": f"SELECT doc_id, CASE WHEN x < 0 THEN 0 ELSE x END AS seconds FROM (SELECT doc_id, TRY_CAST(regexp_extract({strip('h')}, '^([+-]?[0-9]{{1,9}})$', 1) AS INTEGER) AS x FROM (SELECT doc_id, {pick_sql('doc_id', ('5', ' 12 ', '-3', 'soon', '', '1.5', '+7', 'Wed, 21 Oct'))} AS h FROM documents))",
    "seed_list_parse": "SELECT host, string_agg(lower(url), '|' ORDER BY url) AS seeds FROM (SELECT DISTINCT ON (host, lower(url)) url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages ORDER BY url) GROUP BY host",
    "keyword_hits": using(
        "o",
        f"SELECT doc_id, {hits('f', LEX.required)} AS required, {hits('f', LEX.context)} AS context, {hits('f', LEX.condition)} AS condition FROM (SELECT doc_id, {fold('text')} AS f FROM o)"
    ),
    "required_and_context": using(
        "o",
        f"SELECT doc_id, {any_of('f', LEX.required)} AS has_required, {hits('f', LEX.context)} >= 2 AS has_context FROM (SELECT doc_id, {fold('text')} AS f FROM o)"
    ),
    "excluded_content": using(
        "o",
        f"SELECT doc_id, {any_of('f', LEX.excluded)} AS excluded, {any_of('g', LEX.excluded)} AS raw_excluded FROM (SELECT doc_id, {fold('text')} AS f, {fold('raw')} AS g FROM o)"
    ),
    "strong_block": using("s", "SELECT doc_id, pos, strong FROM s"),
    "quality_score": using("q", f"SELECT q.doc_id, score, {score_of('f')} AS score_of_text FROM q JOIN (SELECT doc_id, {fold('text')} AS f FROM o) USING (doc_id)"),
    "block_filter_counts": using("q", "SELECT doc_id, n_accepted AS accepted, n_rejected AS rejected, score FROM q"),
    "source_filter_report": using(
        "q",
        "SELECT src, count(*) AS documents, sum(n_accepted)::BIGINT AS accepted, sum(n_rejected)::BIGINT AS rejected, round(max(score), 2) AS best_score FROM q GROUP BY src"
    ),
    "reference_page": using("j", f"SELECT doc_id, {REFERENCE} AS reference FROM j"),
    "url_normalize": using("n", "SELECT page_id, given, u AS normalized FROM n"),
    "url_canonical": f"SELECT page_id, {canonical('url')} AS canonical FROM pages",
    "url_root_host": using("n", f"SELECT page_id, {root_host('u')} AS host FROM n"),
    "url_same_site": using(
        "n",
        rf"SELECT page_id, {same_site('u', 'base')} AS same_site FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN {root_host('u')} WHEN 1 THEN regexp_replace({root_host('u')}, '^[^.]*\.', '') ELSE 'elsewhere.org' END AS base FROM n)"
    ),
    "url_is_html": using("n", f"SELECT page_id, {is_page('u')} AS is_page FROM n"),
    "url_relevant": using("no", f"SELECT page_id, {relevant('u')} AS relevant FROM n UNION ALL SELECT -1 - doc_id, {relevant('source_url')} FROM o"),
    "source_classify": using("o", f"SELECT doc_id, {_NAME} AS source_name, {_LABEL} <> '' AS verified, {_LABEL} AS verified_from, {_TAG} AS tags FROM o"),
    "verified_from_infer": f"SELECT doc_id, {verified_from('name', 'given')} AS verified_from FROM (SELECT doc_id, {pick_sql('doc_id', ('World Health Organization', 'Who knows', 'A government site', 'CDC', 'Nobody', 'the NHS'))} AS name, {pick_sql('doc_id', ('', '', '', '', '', '', 'given'))} AS given FROM documents)",
    **{
        k: using("m", f"SELECT o.doc_id, {joined('items')} AS {n} FROM o LEFT JOIN (SELECT * FROM m WHERE class = {quoted(n)}) USING (doc_id)")
        for k, n in (
            ("match_symptoms", "symptoms"), ("match_prevention", "prevention"), ("match_warning", "warning_signs"),
            ("match_home_care", "home_care"), ("match_lifestyle", "lifestyle_tips")
        )
    },
    "symptom_buckets": using("r", f"SELECT doc_id, {joined('symptoms[1:4]')} AS common, {joined('symptoms[5:8]')} AS rare FROM r"),
    "description": using("a", f"SELECT doc_id, {_DESCRIPTION} AS description FROM a"),
    "infer_title": using("a", f"SELECT doc_id, {_title('title')} AS title, {_title(quoted(''))} AS own_title FROM a"),
    "seek_doctor": using("r", "SELECT doc_id, seek AS when_to_seek_doctor FROM r"),
    "severity_levels": using(
        "r",
        f"SELECT doc_id, {joined(array(lx.MILD_CONDITIONS))} AS mild_conditions, {_some('home_care', lx.MILD_ADVICE)} AS mild_advice, {joined(array(lx.MODERATE_CONDITIONS))} AS moderate_conditions, {joined(array(lx.MODERATE_ADVICE))} AS moderate_advice, {_some('warning_signs', lx.SEVERE_CONDITIONS)} AS severe_conditions, {joined(array(lx.SEVERE_ADVICE))} AS severe_advice FROM r"
    ),
    "structured_record": using("r", f"SELECT doc_id, {_record()}, 2 AS min_symptoms_match, 0.7::DOUBLE AS high_confidence_threshold FROM r"),
    "complete_fields": using("r", "SELECT doc_id, complete FROM r"),
    "record_gate": using("r", f"SELECT doc_id, language, score, tag AS tags, md5({joined('accepted')}) AS blocks_md5 FROM r WHERE reject_reason IS NULL"),
    "reject_reasons": using("r", "SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM r GROUP BY ALL"),
    "extract_documents": using(
        "r",
        "SELECT doc_id, language, score, CASE WHEN len(accepted) = 0 THEN 'rejected: no block with required terms' WHEN NOT complete THEN 'incomplete: a required field is empty' END AS error, d_title AS title, len(accepted)::BIGINT AS accepted FROM r"
    ),
    "record_fingerprint": using("r", "SELECT doc_id, fingerprint FROM x", _COPIES),
    "dedup_records": using("r", "SELECT min(doc_id) AS doc_id, fingerprint FROM x GROUP BY fingerprint", _COPIES),
    "merge_datasets": using(
        "r",
        "SELECT count(DISTINCT fingerprint) AS merged_count, (count(*) - count(DISTINCT fingerprint))::BIGINT AS duplicate_count, 2::BIGINT AS source_file_count, 'Merged ' || count(*) || ' records from 2 files into ' || count(DISTINCT fingerprint) || ' unique records.' AS message FROM x",
        _COPIES
    ),
    "ordered_tag_set": using(
        "o",
        f"SELECT doc_id, {joined('list_sort(list_distinct(list_filter([' + _TAG + ', src, ' + quoted('b') + ', src], lambda x: x <> ' + quoted('') + ')))')} AS tags FROM o"
    ),
    "bag_union": using(
        "o",
        f"SELECT doc_id, count(*) AS blocks, count(DISTINCT x) AS distinct_blocks FROM (SELECT doc_id, unnest({split_blocks('raw')}) AS x FROM o UNION ALL SELECT doc_id, unnest({split_blocks('text')}) FROM o) GROUP BY doc_id"
    ),
    "error_tail": using("o", "SELECT * FROM (SELECT doc_id, source_url || ': no page' AS error FROM o ORDER BY doc_id DESC LIMIT 20) ORDER BY doc_id"),
    "completion_message": f"SELECT doc_id, CASE WHEN doc_id % 2 > 0 THEN '' WHEN doc_id % 5 = 0 THEN {quoted(lx.RATE_LIMITED)} WHEN doc_id % 3 > 0 THEN {quoted(lx.NOT_FETCHED)} ELSE {quoted(lx.NONE_PASSED)} END AS message FROM documents",
    "progress_percent": "SELECT doc_id, least(100, round(greatest(doc_id % 97, doc_id % 31, doc_id % 53) * 100.0 / (doc_id % 80 + 1)))::BIGINT AS percent FROM documents",
    "ordered_block_text": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5, count(*) AS blocks FROM conversations GROUP BY conv_id",
    "head_limits": using(
        "c",
        f"SELECT doc_id, md5({joined('z[1:3]')}) AS first_md5, md5({joined('z[greatest(len(z) - 1, 1):len(z)]')}) AS last_md5 FROM (SELECT o.doc_id, coalesce(list(block ORDER BY pos) FILTER (block IS NOT NULL), []) AS z FROM o LEFT JOIN c USING (doc_id) GROUP BY o.doc_id)"
    ),
    "visited_anti_join": using(
        "n",
        "SELECT min(page_id) AS page_id, u AS url FROM n WHERE page_id % 2 = 0 AND u IS NOT NULL AND u NOT IN (SELECT u FROM n WHERE page_id % 2 = 1 AND u IS NOT NULL) GROUP BY u"
    ),
    "platform_counters": using(
        "r",
        f"SELECT {root_host('source_url')} AS platform_id, count(*) AS scraped, count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason IS NOT NULL) AS rejected FROM r GROUP BY ALL"
    ),
    "export_csv_rows": using(
        "r",
        f"SELECT {_record(' | ')}, language, score AS quality_score, {joined('accepted', chr(10) * 2)} AS raw_text FROM r WHERE reject_reason IS NULL"
    ),
    "export_jsonl_rows": using(
        "r",
        f"SELECT doc_id, d_title AS title, {_list('symptoms')}, label <> '' AS verified, md5({joined('accepted')}) AS blocks_md5, language, score AS quality_score, tag AS tags FROM r WHERE reject_reason IS NULL"
    ),
    "job_views": using("r", "SELECT doc_id, d_title AS title, score AS quality_score FROM r WHERE reject_reason IS NULL ORDER BY doc_id LIMIT 10"),
}

# Pages, sitemaps, crawls and files.


def bare(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in lx.REMOVED_TAGS:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return out


def plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {quoted(entity)}, {quoted(char)})"
    return ws(out)


_TITLE_OF = rf"CASE WHEN regexp_matches(x, '(?i)<h1\b') THEN {plain(chr(39).join(['regexp_extract(x, ', r'(?is)<h1\b[^>]*>(.*?)</h1>', ', 1)']))} ELSE {plain(chr(39).join(['regexp_extract(x, ', r'(?is)<title\b[^>]*>(.*?)</title>', ', 1)']))} END"
_PARAGRAPHS = rf"list_filter(list_transform(regexp_extract_all(regexp_replace(x, '(?i)<p\b', chr(1) || '<p', 'g'), '(?is)<p\b[^>]*>([^\x{{01}}]*?)(?:</p\s*>|\x{{01}}|\z)', 1), lambda y: {plain('y')}), lambda y: length(y) >= 40)"
_HOST = "lower(regexp_extract(url, '://([^/]+)', 1))"
_HOSTS = f"h AS (SELECT DISTINCT {_HOST} AS host FROM pages)"

# The driver's links are absolute addresses or paths from the root.
_ABSOLUTE = f"CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN lower({part('base', 1)}) || ':' || href WHEN starts_with(href, '/') THEN lower({part('base', 1)}) || '://' || {part('base', 2)} || href WHEN starts_with(href, '#') THEN base END"


def parsed_pages(table: str) -> str:
    """Relations up to p: page_id, html, title and paragraphs (z) of each page of the table."""
    return f"""
pe AS (SELECT page_id, html, regexp_replace({bare('html')}, '&(amp|lt|gt|quot)([^;a-zA-Z0-9])', '&\\1;\\2', 'g') AS x FROM {table}),
pb AS (SELECT page_id, html, regexp_replace(x, '&(amp|lt|gt|quot)([^;a-zA-Z0-9])', '&\\1;\\2', 'g') AS x FROM pe),
pt AS (SELECT page_id, html, {_TITLE_OF} AS title, CASE WHEN regexp_matches(x, '(?i)<article\\b') THEN regexp_extract(x, '(?is)<article\\b[^>]*>(.*)</article>', 1) ELSE x END AS x FROM pb),
p AS (SELECT page_id, html, title, {_PARAGRAPHS} AS z FROM pt)"""


PARSED_PAGES = parsed_pages("pages")
LINKS = """len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"'))::BIGINT"""
ORACLE |= {
    "html_title": f"SELECT page_id, CASE WHEN t = '' THEN {quoted(lx.UNTITLED_PAGE)} ELSE t END AS title FROM (SELECT page_id, {_TITLE_OF} AS t FROM (SELECT page_id, {bare('html')} AS x FROM pages))",
    "html_parsed_pages": f"""
WITH {PARSED_PAGES}
SELECT page_id, CASE WHEN title = '' THEN {quoted(lx.UNTITLED_PAGE)} ELSE title END AS title, len(z)::BIGINT AS blocks, md5(array_to_string(z, chr(10))) AS blocks_md5,
    {LINKS} AS links, '' AS error FROM p
""",
    "html_blocks": f"SELECT page_id, (generate_subscripts(z, 1) - 1)::BIGINT AS pos, md5(unnest(z)) AS block_md5 FROM (SELECT page_id, {_PARAGRAPHS} AS z FROM (SELECT page_id, {bare('html')} AS x FROM pages))",
    "html_links": rf"""WITH a AS (SELECT page_id, {normalize('url')} AS base, unnest(z) AS h, generate_subscripts(z, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS z FROM pages)), b AS (SELECT page_id, pos::BIGINT AS pos, base, trim(h) AS href FROM a), c AS (SELECT page_id, pos, {_ABSOLUTE} AS x FROM b WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:)')), d AS (SELECT page_id, pos, {canonical('x')} AS link FROM c WHERE regexp_matches(x, '^(?i)https?://[^/?#]')) SELECT * FROM d WHERE {is_page('link')}""",
    "robots_sitemaps": f"WITH {_HOSTS} SELECT host, k - 1 AS pos, 'https://' || host || CASE k WHEN 1 THEN '/a.xml' ELSE '/b.xml' END AS sitemap FROM h, range(1, 3) r(k)",
    "sitemap_urls": f"""WITH {_HOSTS}, f AS (SELECT 'https://' || host AS s FROM h)
        SELECT s || '/sitemap.xml' AS sitemap, '' AS urls, s || '/a.xml|' || s || '/b.xml|' || s || '/sitemap.xml' AS nested FROM f
        UNION ALL SELECT s || '/a.xml', s || '/one|' || s || '/two?a=1&b=2|' || s || '/x.pdf|' || s || '/news/a|' || s || '/one|https://other.org/z', '' FROM f
        UNION ALL SELECT s || '/b.xml', '', s || '/c.xml|' || s || '/d.xml' FROM f
        UNION ALL SELECT s || '/c.xml', '', '' FROM f
        UNION ALL SELECT s || '/d.xml', s || '/three|' || s || '/one', '' FROM f""",
    "sitemap_recursive": rf"WITH {_HOSTS}, p AS (SELECT host, k, 'https://' || host || CASE k WHEN 1 THEN '/one' WHEN 2 THEN '/two?a=1&b=2' ELSE '/three' END AS url FROM h, range(1, 4) r(k)), g AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY k) AS seq FROM p WHERE {relevant('url')}) SELECT regexp_replace(host, '^www\.', '') AS root_host, url, seq FROM g WHERE seq <= 2",
    "worker_quota": f"WITH {_HOSTS}, n AS (SELECT host, row_number() OVER (ORDER BY host) - 1 AS i, count(*) OVER () AS n FROM h), t AS (SELECT unnest([1, n + 3, 3 * n, 10 * n]) AS total FROM (SELECT count(*) AS n FROM h)) SELECT host AS platform_id, (CASE WHEN total // n = 0 THEN 1 ELSE least({lx.WORKERS_PER_PLATFORM}, total // n + CASE WHEN i < total % n THEN 1 ELSE 0 END) END)::INTEGER AS workers, total::INTEGER AS total FROM n, t",
    "crawl_frontier": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), g AS (SELECT page_id AS i, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n, page_id]) AS j FROM pages, n), f AS (SELECT i, 0 AS depth FROM (VALUES (0), (1)) v(i) UNION SELECT g.j, depth + 1 FROM f JOIN g ON f.i = g.i WHERE depth < 4) SELECT 'https://site.example/p/' || i AS url, min(depth)::BIGINT AS depth FROM f GROUP BY i",
    "page_budget": "SELECT 'https://site.example/p/' || i AS platform_id, 9::BIGINT AS discovered FROM (VALUES (0), (1)) v(i)",
    "upload_decode": using("o", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN md5(text) END AS content_md5 FROM o"),
    "json_source": using(
        "o",
        """SELECT f.filename, pos, CASE WHEN pos >= 0 THEN '' WHEN txt THEN 'not a .json file' ELSE 'not valid JSON' END AS error, CASE pos WHEN 0 THEN title WHEN 4 THEN 'only' ELSE '' END AS title, CASE WHEN pos = 0 THEN src || '|x' ELSE '' END AS symptoms, CASE WHEN pos >= 0 THEN 'disease' ELSE '' END AS category
        FROM (SELECT *, 'f' || doc_id || CASE WHEN doc_id % 5 = 2 THEN '.txt' ELSE '.JSON' END AS filename, doc_id % 5 = 2 AS txt, doc_id % 5 = 1 AS broken FROM o) f, (VALUES (-1), (0), (4)) v(pos) WHERE (pos < 0) = (txt OR broken)""",
    ),
}

_STATE = "CASE WHEN doc_id % 7 = 6 THEN 'queued' ELSE " + pick_sql("doc_id", ("queued", "running", "paused", "completed", "failed")) + " END"
_PAGES = "CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 ELSE 1000 END"
_PENDING = f"{_STATE} IN ('queued', 'running') AND (doc_id % 3 <> 1 OR doc_id % 5 = 0)"
ORACLE |= {
    "manifest_defaults": using(
        "o",
        f"SELECT doc_id::VARCHAR AS job_id, {_STATE} AS status, ({_PAGES})::INTEGER AS max_pages, 4 AS concurrency, source_url || '|https://cdc.gov/a' AS start_urls, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS platforms, CASE WHEN doc_id % 2 = 1 THEN '' ELSE {_NAME} END AS label, CASE WHEN doc_id % 2 = 1 THEN 9 ELSE doc_id % 50 END::INTEGER AS platform_pages, CASE WHEN doc_id % 3 <> 1 THEN CASE WHEN doc_id % 4 = 0 THEN src WHEN doc_id % 3 = 0 THEN 'host.org' ELSE source_url END END AS item_platform, CASE WHEN doc_id % 3 <> 1 THEN 'a' END AS item_tags FROM o"
    ),
    "pending_jobs": f"SELECT doc_id::VARCHAR AS job_id, {_STATE} AS status FROM documents WHERE {_PENDING}",
    "job_responses": f"SELECT doc_id::VARCHAR AS job_id, array_to_string(list_transform(range(greatest(1, doc_id % 40 - 18), doc_id % 40 + 2), lambda x: 'e' || x), '|') AS errors, CASE WHEN {_STATE} = 'completed' THEN '/api/crawl/' || doc_id || '/download/csv' END AS download_csv_url, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS platforms FROM documents",
    "job_id_union": f"SELECT count(*) AS jobs FROM documents WHERE {_PAGES} < 30 OR ({_PENDING})",
}


def using_pages(url: str, select: str, *more: str) -> str:
    """A query over the records (r) of the pages with a snippet in each; doc_id is the page's."""
    with_snippet = f"sp AS (SELECT page_id, {overlay.PAGE_SQL} AS html FROM pages)"
    as_documents = f"o AS (SELECT page_id AS doc_id, '' AS src, html AS raw, array_to_string(z, chr(10) || chr(10)) AS text, CASE WHEN title = '' THEN {quoted(lx.UNTITLED_PAGE)} ELSE title END AS title, {url} AS source_url FROM p)"
    need = [k for k in RELATIONS if k in _NEEDS["r"] and k != "o"] + ["r"]
    return f"WITH RECURSIVE {', '.join([with_snippet, parsed_pages('sp'), as_documents, *(RELATIONS[k] for k in need), *more])} {select}"


_SITE = "CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END"
ORACLE |= {
    "stream_equals_batch": using_pages(
        "'https://site.example/malaria/' || page_id",
        "SELECT count(*) AS streamed, count(*) AS batch, 0::BIGINT AS different FROM r WHERE reject_reason IS NULL"
    ),
    "crawl_progress": using_pages(
        f"'https://' || {_SITE} || '.example/malaria/' || page_id // 2",
        """SELECT 'https://' || site || '.example/malaria/0' AS platform_id, discovered, discovered AS scraped, accepted, rejected, failed, CASE WHEN accepted = 0 THEN 'empty' ELSE 'completed' END AS status,
            CASE WHEN accepted > 0 THEN 'Completed.' ELSE 'No accepted medical pages.' END AS message
        FROM (SELECT site, count(*) AS discovered, count(*) FILTER (lost) AS failed, count(*) FILTER (NOT lost AND reject_reason IS NULL) AS accepted, count(*) FILTER (NOT lost AND reject_reason IS NOT NULL) AS rejected
            FROM (SELECT DISTINCT site, k FROM reached) JOIN pl USING (site, k) JOIN r ON r.doc_id = pl.page_id GROUP BY site)""",
        f"pl AS (SELECT page_id, {_SITE} AS site, page_id // 2 AS k, page_id % 7 = 5 AS lost, count(*) OVER (PARTITION BY page_id % 2) AS m FROM pages)",
        "reached AS (SELECT site, 0::BIGINT AS k, 0 AS depth FROM pl WHERE k = 0 UNION SELECT pl.site, (8 * pl.k + j) % m, depth + 1 FROM reached JOIN pl USING (site, k), range(1, 9) v(j) WHERE NOT lost AND depth < 6)"
    ),
    "note_runs": """
        WITH a AS (SELECT user_id, ts, event_id, event_type, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, (sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS run FROM a),
        c AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n, min_by(event_id, (ts, event_id)) AS first_event, max_by(event_id, (ts, event_id)) AS last_event FROM b GROUP BY user_id, run)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run DESC) <= 220""",
    "html_lateral_blocks": f"""
        WITH {PARSED_PAGES}
        SELECT page_id, 'block' AS what, (generate_subscripts(z, 1) - 1)::INTEGER AS pos, md5(unnest(z)) AS text_md5 FROM p
        UNION ALL SELECT page_id, 'href', (generate_subscripts(h, 1) - 1)::INTEGER, md5(trim(unnest(h))) FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages)""",
}
