"""Column functions on text. All are built-in expressions; none needs Python on the executors."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: the code points of Unicode's property, with the four separators U+001C-1F.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EDGE = " -:;"
#: A run that is not one plain space already; most gaps between words are, and are passed over. The look-aheads turn plain characters away at once.
_UNEVEN = f"(?=[^ -~]){WS}+| (?=[^!-~]){WS}+"
#: White space below U+0100 but for the plain space, as single characters: a class without ranges is one look into a table.
_ODD = r"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x85\xA0]"
#: All white space above, zero-width spaces, and more.
_HIGH = r"[\x{1680}-\x{3000}]"
#: Line ends. None is a plain character, which one look turns away.
_LINE_END = r"(?=[^ -~])(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}])"


def ws_normalize(text: Column) -> Column:
    """Runs of white space as one space, none at the edges; zero-width spaces removed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u200b"), F.lit("")), _UNEVEN, " "))


def ws_normalize_cheaply(text: Column) -> Column:
    """ws_normalize of a column or a lambda's variable: only trimmed where there is no white space but single plain spaces."""
    high = (F.octet_length(text) != F.length(text)) & F.rlike(text, F.lit(_HIGH))
    uneven = F.contains(text, F.lit("  ")) | F.rlike(text, F.lit(_ODD)) | high
    return F.when(~uneven, F.trim(text)).otherwise(ws_normalize(text))


def ws_normalize_each(texts: Column) -> Column:
    """ws_normalize of each element. Line feeds, which paragraphs hold, are plain spaces first, in a pass of their own, so that they alone need no regular expression."""
    return F.transform(F.transform(texts, lambda x: F.replace(x, F.lit("\n"), F.lit(" "))), ws_normalize_cheaply)


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def is_said(text: Column) -> Column:
    """strip_ws(text) != "", by the beginning alone: a trim at the end looks at the whole text."""
    return F.ltrim(text, F.lit(WS_CHARS)) != ""


def at_least(text: Column, chars: int) -> Column:
    """Whether a text has so many characters. They are counted only where the bytes, four a character at most, do not tell."""
    return F.when(F.octet_length(text) >= 4 * chars, True).otherwise(F.length(text) >= chars)


def fold(text: Column) -> Column:
    """Case-folded text: lower case, with sharp s, long s and final sigma as their plain forms."""
    out = F.lower(text)
    for a, b in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_cheaply(text: Column) -> Column:
    """fold of a column or a lambda's variable: the searches for what is beyond ASCII are left out where there is nothing beyond it."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold(text))


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters; what is cut ends at the last space before, then three dots."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), r" [^ ]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def text_blocks(text: Column) -> Column:
    """Paragraphs at blank lines, or lines where there is no blank line; stripped, empty ones dropped."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    paragraphs = F.split(unix, "\n\n", -1)
    lines = F.split(text, _LINE_END, -1)
    chosen = F.when(F.size(paragraphs) <= 1, lines).otherwise(paragraphs)
    return F.filter(F.transform(chosen, strip_ws), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space; normalised, blank ones dropped."""
    parts = F.filter(F.split(text, f"(?<=[.!?]){WS}+", -1), is_said)
    return ws_normalize_each(parts)


def strip_edge(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE))


def unique_items(items: Column, limit: int, length: int = 280) -> Column:
    """The first `limit` items that differ in their folded, normalised form, truncated. One pass, whatever the number of items."""
    plain = F.transform(ws_normalize_each(items), strip_edge)
    return first_distinct(F.transform(plain, lambda x: F.struct(fold_cheaply(x).alias("fold"), x.alias("item"))), limit, length)


def first_distinct(prepared: Column, limit: int, length: int = 280) -> Column:
    """The first `limit` items, truncated, of an array of (fold, item) that differ in fold; empty ones are none. Prepared before, as what is computed within the
    pass is computed again for each comparison."""
    none = F.array().cast("array<struct<fold:string,item:string>>")

    def add(found, new):
        full = (F.size(found) >= limit) | (new["item"] == "") | F.exists(found, lambda y: y["fold"] == new["fold"])
        return F.when(full, found).otherwise(F.array_append(found, new))

    return F.transform(F.aggregate(prepared, none, add), lambda x: truncate(x["item"], length))


def hits(folded: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are in the text; each counts once. A term that holds another is looked for only where that one is."""
    below: dict[int, list[int]] = {}
    for i, term in enumerate(terms):
        held = [k for k, other in enumerate(terms) if len(other) < len(term) and other in term]
        below.setdefault(max(held, key=lambda k: len(terms[k])) if held else -1, []).append(i)

    def count(i: int) -> Column:
        found = F.contains(folded, F.lit(terms[i]))
        return F.when(~found, 0).otherwise(_balanced([F.lit(1), *map(count, below[i])], operator.add, F.lit(0))) if i in below else found.cast("int")

    return _balanced([count(i) for i in below.get(-1, ())], operator.add, F.lit(0))


def any_of(folded: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms is in the text. A term that holds another need not be looked for."""
    least = [t for t in terms if not any(o != t and o in t for o in terms)]
    return _balanced([F.contains(folded, F.lit(term)) for term in least], operator.or_, F.lit(False))


def _balanced(parts: list[Column], join, none: Column) -> Column:
    """All parts joined as a tree of little depth, which the code generator takes where it gives up on a long chain."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else none


def detect_language(text: Column) -> Column:
    """unknown for empty text; hi where over a fifth as many Devanagari characters as letters; else en. Nothing is counted in ASCII."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    devanagari = F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]"))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(F.octet_length(text) == F.length(text), "en").when((letters > 0) & (devanagari * 5 > letters), "hi").otherwise("en")


def fingerprint_text(value: Column) -> Column:
    return fold(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"{WS}+", " ")))


def fingerprint_list(values: Column) -> Column:
    """The normalised items, sorted; empty ones dropped, repeated ones kept."""
    return F.array_sort(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), fingerprint_text), lambda x: x != ""))


def retry_after_seconds(header: Column) -> Column:
    """Whole seconds, 0 at least; null for anything else."""
    seconds = F.regexp_extract(strip_ws(header), r"^([+-]?[0-9]{1,9})\z", 1).try_cast("int")
    return F.when(seconds < 0, 0).otherwise(seconds)


def seed_list(text: Column) -> Column:
    """Seeds between line ends, commas, semicolons and tabs; quotes stripped; the first of each, whatever its case.

    Sorted by lower case and place, a seed that differs from the one before it is the first of its kind, so a list costs n log n. The sorted
    list is a lambda's variable, as it would be made again for each of its uses otherwise."""
    parts = F.filter(F.transform(F.split(text, r"[\r\n,;\t]+", -1), lambda x: F.btrim(strip_ws(x), F.lit("\"'"))), lambda x: x != "")
    by_case = F.sort_array(F.transform(parts, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("seed"))))

    def firsts(found):
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(found, lambda x: x["low"]))
        first = F.zip_with(
            F.slice(before, 1, F.size(found)), found, lambda was, x: F.when(~was.eqNullSafe(x["low"]), F.struct(x["i"].alias("i"), x["seed"].alias("seed")))
        )
        return F.transform(F.sort_array(F.filter(first, lambda x: x.isNotNull())), lambda x: x["seed"])

    return F.flatten(F.transform(F.array(by_case), firsts))


def progress_percent(scraped: Column, accepted: Column, rejected: Column, max_pages: Column) -> Column:
    most = F.greatest(scraped, accepted, rejected)
    return F.least(F.lit(100), F.floor((most * 200 + max_pages) / F.nullif(max_pages * 2, F.lit(0))).cast("int"))
