"""Blocks, titles and links of HTML.

Two forms. `parse_pages` builds on the standard library's parser, on Arrow batches, and honours nesting,
removed tags and classes, and content roots; a new p or li ends an open one, and void or unclosed
tags do no harm. It serves crawls and streams alike; a page that it rejects is a row with an error. The `*_native` columns do the plain cases by regular expressions without
Python, and are what the SQL checks are held against.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.functions.text import ws_normalize
from textloom.plans.lexicon import REMOVED_CLASSES, REMOVED_TAGS, UNTITLED_PAGE

MIN_BLOCK = 40
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ROOT_CLASSES = frozenset(("content", "entry-content", "article-body"))
_REMOVED = frozenset(REMOVED_TAGS)


def spaced(text: str) -> str:
    return " ".join(text.replace("​", "").split())


_CLOSES_NONE = ("ul", "ol", "article", "main", "section", "div", "body", "table")


class PageParser(HTMLParser):
    """Collects title, heading, blocks in document order, inside content roots and outside, and links.

    What is open is counted by tag, so a page costs time in proportion to its length however many tags it leaves open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, starts a removed part, starts a root
        self.places: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.removed = self.roots = 0
        self.title: list[str] = []
        self.headings: list[list[str]] = []
        self.said: list[str] = []  # all text that is not removed; a block is a stretch of it
        self.open_blocks: list[int] = []
        self.blocks: list[tuple[bool, int, int]] = []  # inside a root, stretch
        self.links: list[str] = []
        self.rooted = False

    def parse_marked_section(self, i, report=1):
        """A section of unknown kind is a comment, as browsers take it."""
        return self.parse_bogus_comment(i)

    def updatepos(self, i, j):
        """Lines are not counted: nobody asks where a tag stands."""
        return j

    def handle_starttag(self, tag, attrs):
        gone, root = tag in _REMOVED, tag in ("article", "main")
        if attrs:
            given = {k: v or "" for k, v in attrs}
            if tag == "a" and "href" in given:
                self.links.append(given["href"].strip())
            classes = given.get("class", "").split()
            gone = gone or given.get("aria-hidden") == "true" or any(c in REMOVED_CLASSES for c in classes)
            root = root or given.get("role") == "main" or any(c in _ROOT_CLASSES for c in classes)
        if tag in _VOID:
            return
        root = root and not gone and not self.removed
        if tag in ("p", "li"):
            self._close(tag)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, gone, root))
        self.removed += gone
        self.roots += root
        self.rooted |= root
        if self.removed:
            return
        if tag == "h1":
            self.headings.append([])
        if tag in ("p", "li"):
            self.open_blocks.append(len(self.blocks))
            self.blocks.append((self.roots > 0, len(self.said), -1))

    def _last(self, tag):
        return self.places[tag][-1] if self.places.get(tag) else -1

    def _close(self, tag):
        """End an open p (or li) before a sibling of its kind; a list inside an item keeps the item open."""
        at = self._last(tag)
        if at >= 0 and at > max(map(self._last, _CLOSES_NONE)):
            self._pop(at)

    def _pop(self, at):
        for tag, gone, root in reversed(self.stack[at:]):
            self.places[tag].pop()
            if tag in ("p", "li") and not self.removed and self.open_blocks:
                k = self.open_blocks.pop()
                inside, start, _ = self.blocks[k]
                self.blocks[k] = (inside, start, len(self.said))
            self.removed -= gone
            self.roots -= root
        del self.stack[at:]

    def handle_endtag(self, tag):
        if (at := self._last(tag)) >= 0:
            self._pop(at)

    def handle_data(self, data):
        if self.removed or not self.stack and not data.strip():
            return
        if self.places.get("title"):
            self.title.append(data)
        if self.places.get("h1") and self.headings:
            self.headings[-1].append(data.strip())
        if self.open_blocks:
            self.said.append(data.strip())

    def close(self):
        super().close()
        self._pop(0)

    def texts(self):
        """The blocks of the content roots, of the whole page where it has none, in the order in which they begin."""
        every = (spaced(" ".join(self.said[a:b])) for inside, a, b in self.blocks if inside or not self.rooted)
        return [x for x in every if len(x) >= MIN_BLOCK]


def parse_page(html: str | None) -> tuple[str, list[str], list[str]]:
    """Title, blocks and hrefs. A heading names the page even if empty of text: then the default."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    name = spaced(" ".join(parser.headings[0])) if parser.headings else spaced("".join(parser.title))
    return name or UNTITLED_PAGE, parser.texts(), parser.links


def parsed_or_error(html: str | None) -> tuple[str | None, list[str] | None, list[str] | None, str | None]:
    """parse_page, and why there is no result: one page that the parser rejects must not end a job."""
    try:
        return *parse_page(html), None
    except Exception as e:  # whatever the parser raises is this page's error
        return None, None, None, f"{type(e).__name__}: {e}"[:200]


PARSE_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about PARSE_BYTES of HTML, one page at least, so that no more than that is held as Python text with all that is found in it."""
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > PARSE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows:
        yield batch.slice(start)


PARSED = "title string, blocks array<string>, hrefs array<string>, error string"


def with_parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, blocks, hrefs and error in place of the HTML; works on streams as well. A null page is empty."""
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [*(f.name for f in kept), "title", "blocks", "hrefs", "error"]
    at = pages.columns.index(html)

    def run(batches):
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        for batch in (x for given in batches for x in _slices(given, at)):
            found = [parsed_or_error(x) for x in batch.column(at).to_pylist()]
            own = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], names)

    given = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.mapInArrow(run, given + PARSED)


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, blocks, hrefs, error of each page."""
    return with_parsed(pages.select(key, html), html)


class PageBlocks:
    """A row per block of a page, for SQL: `FROM pages, LATERAL page_blocks(html)`. A page that the parser rejects has none."""

    def eval(self, html: str):
        yield from enumerate(parsed_or_error(html)[1] or ())


class PageHrefs:
    """A row per href of a page as it is written, for SQL: `FROM pages, LATERAL page_hrefs(html)`."""

    def eval(self, html: str):
        yield from enumerate(parsed_or_error(html)[2] or ())


def register_sql(spark: SparkSession) -> None:
    """page_blocks and page_hrefs for this session's SQL: rows as they are found, instead of arrays in a row that are exploded."""
    spark.udtf.register("page_blocks", F.udtf(PageBlocks, returnType="pos int, block string", useArrow=True))
    spark.udtf.register("page_hrefs", F.udtf(PageHrefs, returnType="pos int, href string", useArrow=True))


def _bare(html: Column) -> Column:
    """Without comments and the content of removed tags."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in REMOVED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags as spaces, the common entities as characters."""
    out = F.regexp_replace(fragment, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return ws_normalize(out)


def title_native(html: Column) -> Column:
    bare = _bare(html)
    heading = F.regexp_extract(bare, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    named = F.when(F.rlike(bare, F.lit(r"(?i)<h1\b")), plain(heading)).otherwise(plain(F.regexp_extract(bare, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    return F.when(named == "", UNTITLED_PAGE).otherwise(named)


def blocks_native(html: Column) -> Column:
    """Paragraphs up to the next p or its end."""
    found = F.regexp_extract_all(F.regexp_replace(_bare(html), r"(?i)<p\b", "\u0001<p"), F.lit(r"(?is)<p\b[^>]*>([^\x{01}]*?)(?:</p\s*>|\x{01}|\z)"), F.lit(1))
    return F.filter(F.transform(found, plain), lambda x: F.length(x) >= MIN_BLOCK)


def hrefs_native(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)), F.trim)


def page_links(df: DataFrame, base: Column, hrefs: str = "hrefs") -> DataFrame:
    """Adds a row per usable link: pos, url (canonical, of a page, on any site)."""
    rows = df.withColumn("__base", base).select(*df.columns, "__base", F.posexplode(hrefs).alias("pos", "href"))
    rows = rows.filter(~urls.skip_href(F.col("href"))).withColumn("url", urls.resolve(F.col("__base"), F.col("href")))
    return rows.filter(F.col("url").isNotNull() & urls.is_page(F.col("url"))).drop("__base", "href")
