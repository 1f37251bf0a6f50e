"""From blocks of a document to a validated record: narrow transforms on arrays, no shuffle.

Each step is a projection of its own, so what a later step uses twice is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import urls
from textloom.plans import lexicon as lx
from textloom.plans.lexicon import DEFAULT, Lexicon

STRINGS = "array<string>"


def strings(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(STRINGS)


def folded_blocks(df: DataFrame, blocks: str, out: str, lexicon: Lexicon = DEFAULT, even: bool = False) -> DataFrame:
    """array(struct(b, f)): normalised blocks of min_block characters at least with their folded form, the first of each form, in order. even: they are normalised already.

    Sorted by folded form and place, a block that differs from the one before it is the first of its form. The neighbour
    comes from the same array moved by one: within its own lambda the array would be sorted again for each element.
    The sorted array and the result are settled, so a filter or an explode above computes neither of them twice."""
    long = F.filter(F.col(blocks) if even else tx.ws_normalize_each(blocks), lambda x: tx.at_least(x, lexicon.min_block))
    df = settled(df, "__sorted", F.array_sort(F.transform(long, lambda x, i: F.struct(tx.fold_cheaply(x).alias("fold"), i.alias("i"), x.alias("b")))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("__sorted", lambda x: x["fold"]))
    marked = F.zip_with(
        F.slice(before, 1, F.size("__sorted")), "__sorted", lambda was,
        x: F.when(~was.eqNullSafe(x["fold"]), F.struct(x["i"].alias("i"), x["b"].alias("b"), x["fold"].alias("f")))
    )
    placed = F.array_sort(F.filter(marked, lambda x: x.isNotNull()))
    return settled(df, out, F.transform(placed, lambda x: F.struct(x["b"].alias("b"), x["f"].alias("f")))).drop("__sorted")


def clean_blocks(df: DataFrame, blocks: str, out: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Normalised blocks of min_block characters at least, the first of each folded form, in order."""
    return folded_blocks(df, blocks, "__folded", lexicon).withColumn(out, F.transform("__folded", lambda x: x["b"])).drop("__folded")


def evidence(folded: Column, lexicon: Lexicon = DEFAULT) -> tuple[Column, Column, Column, Column]:
    """Required, context and condition hits, and whether an excluded term is there."""
    return tx.hits(folded, lexicon.required), tx.hits(folded, lexicon.context), tx.hits(folded, lexicon.condition), tx.any_of(folded, lexicon.excluded)


def strong_folded(folded: Column, required: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether a block with so many required hits is strong: none excluded, some context or condition, and 2 * required + context + 2 * condition of 4 at least.
    The last two are one bound on the same sum, so within a lambda each search is made once."""
    _, context, condition, excluded = evidence(folded, lexicon)
    return (required > 0) & ~excluded & (context + condition * 2 >= F.greatest(F.lit(1), 4 - required * 2))


def strong_blocks(blocks: str, lexicon: Lexicon = DEFAULT) -> Column:
    """array(struct(ok, b)): each block folded once, its required terms counted once, then judged."""
    return strong_of_folded(F.transform(blocks, lambda x: F.struct(x.alias("b"), tx.fold_cheaply(x).alias("f"))), lexicon)


def strong_of_folded(folded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """strong_blocks of an array(struct(b, f)): blocks with their folded form."""
    counted = F.transform(folded, lambda x: F.struct(x["b"].alias("b"), x["f"].alias("f"), tx.hits(x["f"], lexicon.required).alias("required")))
    return F.transform(counted, lambda y: F.struct(strong_folded(y["f"], y["required"], lexicon).alias("ok"), y["b"].alias("b")))


_COUNTS = ("__required", "__context", "__condition", "__excluded")


def with_score(df: DataFrame, folded: str, out: str = "score", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds the quality in hundredths by whole numbers: 0.14 a required term, 0.04 context, 0.08 condition, up to 0.2 for length, 0.25 off for excluded terms, 1 at most; 0 for no text."""
    return _score_and_counts(df, folded, out, lexicon).drop(*_COUNTS)


def _score_and_counts(df: DataFrame, folded: str, out: str, lexicon: Lexicon) -> DataFrame:
    df = df.withColumns(dict(zip(_COUNTS, evidence(F.col(folded), lexicon), strict=True)))
    raw = F.col("__required") * 14000 + F.col("__context") * 4000 + F.col("__condition") * 8000 + F.least(F.length(folded), F.lit(5000)) * 4 - F.when(F.col("__excluded"), 25000).otherwise(0)
    df = df.withColumn("__raw", F.least(raw, F.lit(100000)))
    hundredths = F.when(F.col("__raw") >= 0, F.floor((F.col("__raw") + 500) / 1000)).otherwise(-F.floor((-F.col("__raw") + 500) / 1000))
    score = F.when(F.coalesce(F.col(folded), F.lit("")) == "", F.lit(0.0)).otherwise(hundredths / 100.0)
    return df.withColumn(out, score).drop("__raw")


def accept_blocks(df: DataFrame, cleaned: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds accepted, rejected (arrays), joined (folded text of the accepted) and score."""
    return _accept(df, strong_blocks(cleaned, lexicon), lexicon).drop("__said", *_COUNTS)


def _accept(df: DataFrame, marked: Column, lexicon: Lexicon) -> DataFrame:
    """Adds what accept_blocks does, the accepted blocks' text and the counts of its terms."""
    df = df.withColumn("__marked", marked)
    pick = lambda ok: F.transform(F.filter("__marked", lambda x: x["ok"] == ok), lambda x: x["b"])
    df = df.withColumn("accepted", pick(F.lit(True))).withColumn("rejected", pick(F.lit(False))).drop("__marked")
    df = df.withColumn("__said", F.array_join("accepted", " "))
    return _score_and_counts(df.withColumn("joined", tx.fold_cheaply(F.col("__said"))), "joined", "score", lexicon)


def reference_page(title: Column, joined: Column, url: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A condition named in the title or URL, no generic title, and evidence in the blocks."""
    return reference_by_counts(title, url, *(tx.hits(joined, terms) for terms in (lexicon.required, lexicon.context, lexicon.condition)), lexicon)


def reference_by_counts(title: Column, url: Column, required: Column, context: Column, condition: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """reference_page by the hits in the blocks. Folded title, URL and hits are fields of a lambda's variable, as they would be made again for each use otherwise."""
    values = {
        "low": tx.fold(tx.strip_ws(F.coalesce(title, F.lit("")))), "where": tx.fold(tx.strip_ws(F.coalesce(url, F.lit("")))),
        "required": required, "context": context, "condition": condition
    }

    def judge(x):
        named = tx.any_of(x["low"], lexicon.condition)
        return (
            ~tx.any_of(x["low"], lexicon.generic_titles)
            & ((x["condition"] > 0) | named)
            & (x["required"] > 0)
            & (named | tx.any_of(x["where"], lexicon.condition))
            & ((x["context"] >= 2) | (x["required"] >= 2))
        )

    return F.exists(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), judge)


def with_sentences(df: DataFrame, blocks: str) -> DataFrame:
    """Adds said: the sentences of each block in order, with their folded form."""
    flat = F.flatten(F.transform(blocks, tx.sentences))
    return df.withColumn("said", F.transform(flat, lambda x: F.struct(x.alias("s"), tx.fold_cheaply(x).alias("f"))))


def matching(said: str, terms, without=(), limit: int = 8, length: int = 280) -> Column:
    """said: sentences, normalised, with their folded form. Folding changes no character that strip_edge takes off, so it need not be done again."""
    kept = F.filter(said, lambda x: tx.any_of(x["f"], terms) & ~tx.any_of(x["f"], without))
    return tx.first_distinct(F.transform(kept, lambda x: F.struct(tx.strip_edge(x["f"]).alias("fold"), tx.strip_edge(x["s"]).alias("item"))), limit, length)


def match_lists(df: DataFrame, lexicon: Lexicon = DEFAULT, whole: str | None = None) -> DataFrame:
    """Adds symptoms, prevention, warning_signs, home_care and lifestyle_tips from said.

    whole: folded text that holds all sentences; where it lacks a class's terms, no sentence of it is looked at."""
    for name, (terms, without) in lexicon.sentence_classes().items():
        found = matching("said", terms, without, lexicon.sentence_limit, lexicon.item_length)
        df = df.withColumn(name, F.when(tx.any_of(F.col(whole), terms), found).otherwise(F.array().cast(STRINGS)) if whole else found)
    return df


def description(blocks: str, lexicon: Lexicon = DEFAULT) -> Column:
    return tx.truncate(F.array_join(F.slice(blocks, 1, lexicon.description_blocks), " "), lexicon.description_length)


def title(given: Column, blocks: str, lexicon: Lexicon = DEFAULT) -> Column:
    first = F.try_element_at(F.col(blocks), F.lit(1))
    own = F.coalesce(F.try_element_at(tx.sentences(first), F.lit(1)), first)
    return F.when(
        F.coalesce(given, F.lit("")) != "", tx.truncate(given, lexicon.title_length)
    ).when(F.size(blocks) == 0, lx.UNTITLED_ENTRY).otherwise(tx.truncate(own, lexicon.title_length))


def seek_doctor(blocks: str, warnings: str, whole: str | None = None) -> Column:
    """The first sentence of the joined blocks that says to seek a doctor, medical help or care; else the first warning. whole: their folded text, if it is there."""
    said = F.transform(tx.sentences(F.array_join(blocks, " ")), lambda x: F.struct(x.alias("s"), tx.fold(x).alias("f")))
    asks = F.filter(said, lambda x: F.contains(x["f"], F.lit("seek")) & tx.any_of(x["f"], ("doctor", "medical", "care")))
    found = F.try_element_at(asks, F.lit(1))["s"]
    if whole:
        found = F.when(F.contains(F.col(whole), F.lit("seek")), found)
    return F.coalesce(tx.truncate(found, 280), F.try_element_at(F.col(warnings), F.lit(1)), F.lit(""))


def severity(warnings: str, home_care: str) -> Column:
    some = lambda c, default: F.when(F.size(c) > 0, F.slice(c, 1, 5)).otherwise(strings(*default))
    band = lambda conditions, advice: F.struct(conditions.alias("conditions"), advice.alias("advice"))
    return F.struct(
        band(strings(*lx.MILD_CONDITIONS), some(home_care, lx.MILD_ADVICE)).alias("mild"),
        band(strings(*lx.MODERATE_CONDITIONS), strings(*lx.MODERATE_ADVICE)).alias("moderate"),
        band(some(warnings, lx.SEVERE_CONDITIONS), strings(*lx.SEVERE_ADVICE)).alias("severe"),
    )


def structure(
    df: DataFrame, blocks: str, given_title: Column, source_name: Column, source_url: Column, verified: Column,
    given_from: Column, lexicon: Lexicon = DEFAULT, whole: str | None = None
) -> DataFrame:
    """Adds data: the record of 20 fields. whole: the blocks' folded text, if it is there."""
    df = match_lists(with_sentences(df, blocks), lexicon, whole)
    values = {
        "title": title(given_title, blocks, lexicon),
        "category": F.lit(lx.CATEGORY),
        "common_symptoms": F.slice("symptoms", 1, 4),
        "rare_symptoms": F.slice("symptoms", 5, lexicon.sentence_limit),
        "description": description(blocks, lexicon),
        "differential_questions": strings(*lx.QUESTIONS),
        "severity_levels": severity("warning_signs", "home_care"),
        "when_to_seek_doctor": seek_doctor(blocks, "warning_signs", whole),
        "risk_groups": strings(*lx.RISK_GROUPS),
        "possible_confusions": strings(*lx.CONFUSIONS),
        "confidence_rules": F.struct(F.lit(2).alias("min_symptoms_match"), F.lit(0.7).alias("high_confidence_threshold")),
        "source": source_name,
        "verified": verified,
        "verified_from": F.when(verified, urls.verified_from(source_name, given_from)).otherwise(""),
        "source_url": source_url,
    }
    data = F.struct(*(values.get(f, F.col(f)).alias(f) for f in lx.EXPORT_FIELDS))
    return df.withColumn("data", data).drop("said", *lexicon.sentence_classes())


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column as a generator's output, so that filters on it stay above it; pushed below, they would compute all that it is made of again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def complete(data: str = "data") -> Column:
    texts = [F.col(f"{data}.{f}") for f in ("title", "category", "description", "when_to_seek_doctor")]
    lists = [F.col(f"{data}.{f}") for f in ("symptoms", "warning_signs", "prevention")]
    out = F.lit(True)
    for t in texts:
        out = out & tx.is_said(t)
    for a in lists:
        out = out & (F.size(a) > 0)
    return out


def _accepted_records(rows: DataFrame, lexicon: Lexicon, even: bool) -> DataFrame:
    df = folded_blocks(rows, "blocks", "__folded", lexicon, even)
    df = _accept(df.withColumn("cleaned", F.transform("__folded", lambda x: x["b"])), strong_of_folded(F.col("__folded"), lexicon), lexicon).drop("__folded")
    return df.withColumn("language", tx.detect_language(F.col("__said"))).drop("__said")


def build_records(pages: DataFrame, lexicon: Lexicon = DEFAULT, even: bool = False) -> DataFrame:
    """Of rows with title, source_url and blocks: adds accepted, rejected, score, language, data, tags and reject_reason (null where accepted).

    even: the blocks are normalised already, as those of `html.with_parsed` are. Gates in order: the URL, accepted blocks, the reference page, completeness."""
    df = _accepted_records(pages, lexicon, even)
    df = df.withColumn("__source", urls.source(F.col("source_url")))
    df = structure(
        df, "accepted", F.col("title"), F.col("__source.source_name"), F.col("source_url"), F.col("__source.verified"),
        F.col("__source.verified_from"), lexicon, "joined"
    )
    reason = (
        F.when(~urls.relevant(F.col("source_url"), lexicon), "url")
        .when(F.size("accepted") == 0, "no accepted block")
        .when(~reference_by_counts(F.col("title"), F.col("source_url"), *map(F.col, _COUNTS[:3]), lexicon), "not a reference page")
        .when(~complete(), "incomplete")
    )
    return settled(df.withColumn("tags", F.col("__source.tags")), "reject_reason", reason).drop("__source", "joined", *_COUNTS)


def extract_documents(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The single-source form, of rows with title, source_name, source_url, verified, verified_from and blocks: no gate on URL or page; failures are told in `error`."""
    df = _accepted_records(docs, lexicon, False).drop(*_COUNTS)
    df = structure(df, "accepted", F.col("title"), F.col("source_name"), F.col("source_url"), F.col("verified"), F.col("verified_from"), lexicon, "joined")
    error = F.when(F.size("accepted") == 0, "rejected: no block with required terms").when(~complete(), "incomplete: a required field is empty")
    return settled(df, "error", error).drop("joined")
