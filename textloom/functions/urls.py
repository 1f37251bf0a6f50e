"""Column functions on URLs, by regular expressions: parse_url would be null for spaces and pipes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import any_of, fold, strip_ws
from textloom.plans.lexicon import DEFAULT, NON_PAGE_EXTENSIONS, SOURCES, Lexicon

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    """Without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 3), r";[^/]*\z", "")


def query(url: Column) -> Column:
    return F.substring(F.regexp_extract(url, PARTS, 4), 2, 1 << 30)


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased, no fragment, no parameters, no slashes at the end of a path; a path at least."""
    u = strip_ws(url)
    kept = F.regexp_replace(path(u), r"/+\z", "")
    asked = F.regexp_replace(F.regexp_extract(u, PARTS, 4), r"^\?\z", "")
    return F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), F.when(kept == "", "/").otherwise(kept), asked)


def normalize(url: Column) -> Column:
    """Canonical, with https:// where no scheme is written; null where there is no host."""
    u = strip_ws(url)
    full = F.when(F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when((u != "") & (netloc(full) != ""), canonical(full))


def root_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def same_site(url: Column, base: Column) -> Column:
    host = root_host(url)
    return (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def is_page(url: Column) -> Column:
    return ~F.rlike(F.lower(path(url)), F.lit(r"\.(" + "|".join(NON_PAGE_EXTENSIONS) + r")\z"))


def relevant(url: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The bare root is; a path or query with an excluded segment, token or substring is not.

    The folded parts are fields of a lambda's variable, as they would be made again for each term otherwise."""
    segments = F.array(*(F.lit(s) for s in lexicon.url_segments))
    parts = F.array(F.struct(fold(path(url)).alias("where"), fold(query(url)).alias("asked")))
    joined = F.transform(parts, lambda x: F.struct(x["where"].alias("where"), x["asked"].alias("asked"), F.concat(x["where"], F.lit(" "), x["asked"]).alias("both")))

    def judge(x):
        pairs = F.transform(F.split(F.replace(x["asked"], F.lit("+"), F.lit(" ")), "&", -1), lambda y: F.split(y, "=", 2))
        tokens = F.transform(F.flatten(pairs), lambda y: F.coalesce(F.try_url_decode(y), y))
        out = F.arrays_overlap(F.split(x["where"], "/", -1), segments) | F.arrays_overlap(tokens, segments) | any_of(x["both"], lexicon.url_substrings)
        return (F.btrim(x["both"], F.lit(" /")) == "") | ~out

    return F.exists(joined, judge)


def _first(host: Column, values, otherwise: Column) -> Column:
    out = None
    for (endings, *_), value in zip(SOURCES, values, strict=True):
        hit = F.lit(False)
        for e in endings:
            hit = hit | F.endswith(host, F.lit(e)) | (F.contains(host, F.lit(".gov.")) if e == ".gov" else F.lit(False))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def source(url: Column) -> Column:
    """struct(source_name, verified, verified_from, tags) by the first matching ending of the host."""
    host = root_host(url)
    label = _first(host, [F.lit(x[1]) for x in SOURCES], F.lit(""))
    name = _first(host, [F.lit(x[2]) for x in SOURCES], F.when(host == "", "Web page").otherwise(host))
    tag = _first(host, [F.lit(x[3]) for x in SOURCES], F.lit(""))
    return F.struct(name.alias("source_name"), (label != "").alias("verified"), label.alias("verified_from"), F.filter(F.array(tag), lambda x: x != "").alias("tags"))


def verified_from(source_name: Column, given: Column) -> Column:
    low = fold(source_name)
    return F.when(given != "", given).when(F.contains(low, F.lit("who")), "WHO").when(any_of(low, ("world health organization",)), "WHO").when(
        any_of(low, ("government", "cdc", "nih", "nhs")), "Government health source"
    ).otherwise("")


def skip_href(href: Column) -> Column:
    return (href == "") | F.rlike(href, F.lit("^(mailto:|tel:|javascript:)"))


def resolve(base: Column, href: Column) -> Column:
    """A link as seen from a canonical page URL, canonical itself; dot segments are taken out of relative paths.

    Null where the result has no host, or the href is a broken literal address."""
    h = strip_ws(href)
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(F.regexp_extract(base, PARTS, 3), r"[^/]*\z", "")
    bare = F.regexp_replace(h, r"[?#].*\z", "")
    rest = F.regexp_replace(h, r"^[^?#]*", "")
    joined = F.when(F.startswith(h, F.lit("/")), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    parts = F.filter(F.split(joined, "/", -1), lambda x, i: (i > 0) & (x != "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    relative = F.concat(root, F.lit("/"), F.array_join(walked, "/"), rest)
    absolute = (
        F.when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, path(base), h))
        .when(F.startswith(h, F.lit("#")), base)
        .otherwise(relative)
    )
    good = F.rlike(absolute, F.lit("^(?i)https?://[^/?#]")) & ~F.rlike(netloc(absolute), F.lit(r"\[[^\]]*\z"))
    return F.when(good, canonical(absolute))
