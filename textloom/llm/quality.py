"""Quality rules, line first (10).

Each line of a document is judged by itself and by where it stands:

- navigation: a short line that is one of a language's phrases ("Home", "Weiter lesen"), or items between
  separators (`a | b | c`): separators are words of their own, one in four words or more;
- symbols: marks of `#*$%&|<>` for more than max_symbols of its characters;
- punctuation: more than `heading_words` words
  at its end after the last that ends in punctuation, unless the next line with words begins in lower case, so that the sentence
  goes on there, or there is none, as texts are cut off at their end;
- boilerplate: one of a language's phrases ("all rights reserved", "alle Rechte vorbehalten") in a line of moderate length,
  or the third and later copies of a line in the document.

Lines that fail are removed. A document is rejected
if its base figures fail, or if the removed lines held more than `max_lost` of its words.

Words are runs of anything but space and \\x09-\\x0D. Defined results for odd input:
a null or empty text has no words, so it is rejected; repeated rows are judged alike;
an empty table gives an empty result; other columns are passed over by `quality_rules`
and kept as they are by `clean_documents`.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, strings, text_of, with_text
from .words import WordHashes, grams

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


# Phrases by language, lower-cased.
BOILERPLATE = {
    "en": (
        "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
        "cookie policy", "accept cookies", "subscribe to our newsletter", "sign up for our newsletter", "click here",
        "enable javascript", "copyright ©", "copyright (c)"
    ),
    "de": (
        "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "cookies akzeptieren",
        "newsletter abonnieren", "hier klicken", "javascript aktivieren", "lizenziert unter"
    ),
    "fr": (
        "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales",
        "accepter les cookies", "abonnez-vous à notre", "cliquez ici", "activer javascript", "sous licence"
    ),
    "es": (
        "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies",
        "suscríbete a nuestro", "haga clic aquí", "activar javascript", "bajo licencia"
    ),
}
NAVIGATION = {
    "en": (
        "home", "menu", "login", "log in", "sign in", "sign up", "search", "share", "next", "previous", "back to top",
        "read more", "contact", "about", "skip to content"
    ),
    "de": (
        "startseite", "menü", "anmelden", "suche", "suchen", "teilen", "weiter", "zurück", "nach oben", "weiterlesen",
        "weiter lesen", "mehr lesen", "kontakt", "impressum", "über uns", "zum inhalt springen"
    ),
    "fr": (
        "accueil", "menu", "connexion", "se connecter", "rechercher", "partager", "suivant", "précédent", "haut de page",
        "lire la suite", "contact", "à propos", "aller au contenu"
    ),
    "es": (
        "inicio", "menú", "iniciar sesión", "acceder", "buscar", "compartir", "siguiente", "anterior", "volver arriba",
        "leer más", "contacto", "acerca de", "ir al contenido"
    ),
}


def _all(phrases: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for own in phrases.values() for p in own))


@dataclass(frozen=True)
class LineRules:
    """max_symbols: share of a line's characters other than white space; separator_words: words a separator at most;
    copies: of a line that stay; max_lost: share of a document's words in removed lines."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols: float = 0.08
    max_lost: float = 0.5
    navigation_words: int = 6
    separator_words: int = 4
    heading_words: int = 12
    boilerplate_words: int = 30
    copies: int = 2
    boilerplate: tuple[str, ...] = _all(BOILERPLATE)
    navigation: tuple[str, ...] = _all(NAVIGATION)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = tuple(".!?…:;,\"'”’»)]}。！？")
_SEPARATORS = ("|", "»", "›", "•", "·", ">", "::")


def _goes_on(following: str | None) -> bool:
    return following is None or unicodedata.category(following.lstrip(SPACE)[0]) == "Ll"


def line_verdict(line: str, rules: LineRules, following: str | None = None, before: int = 0) -> str:
    """Why a line goes, or '' if it stays. following: the next line with words, None for the last; before: how many equal lines stood before it.
    A line without words stays and counts for nothing."""
    words = _WORD.findall(line)
    if not words:
        return ""
    bare = line.strip(SPACE)
    low = bare.lower()
    if len(words) <= rules.navigation_words and low.strip(" .:>»|-").replace("»", "").strip() in rules.navigation:
        return "navigation"
    if rules.separator_words * sum(map(words.count, _SEPARATORS)) >= len(words):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * sum(map(len, words)):
        return "symbols"
    if before >= rules.copies or len(words) <= rules.boilerplate_words and any(x in low for x in rules.boilerplate):
        return "boilerplate"
    open_words = next((k for k, w in enumerate(reversed(words)) if w.endswith(_ENDS)), len(words))
    if open_words > rules.heading_words and not _goes_on(following):
        return "punctuation"
    return ""


def line_verdicts(text: str, rules: LineRules) -> list[tuple[str, str]]:
    """Each line with its verdict. Lines are equal if they are but for white space at their ends."""
    lines, seen = text.split("\n"), Counter()
    out = [(line, "") for line in lines]
    full = [i for i, line in enumerate(lines) if line.strip(SPACE)]
    for i, after in zip(full, [*full[1:], None]):
        bare = lines[i].strip(SPACE)
        out[i] = (lines[i], line_verdict(lines[i], rules, None if after is None else lines[after], seen[bare]))
        seen[bare] += 1
    return out


def base_figures(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n, repeated = len(words), 0
    if n > 3:
        _, which, counts = np.unique(grams(hashes.of(words), 3), return_inverse=True, return_counts=True)
        again = counts[which] > 1
        if again.any():
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= again
            repeated = int(covered.sum())
    return n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def clean(text: str, rules: LineRules) -> tuple[str, int, int]:
    """The text without the lines that fail, how many lines went, and how many words."""
    judged = line_verdicts(text, rules)
    gone = [line for line, why in judged if why]
    if not gone:
        return text, 0, 0
    return "\n".join(line for line, why in judged if not why), len(gone), sum(len(_WORD.findall(x)) for x in gone)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, words_removed long, cleaned string"


def quality_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: its base figures, the verdict and the cleaned text."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in strings(batch.column("text")):
                n, chars, symbols, dup, rep = base_figures(text, hashes)
                cleaned, lines, lost = clean(text, rules)
                failed = n < rules.min_words or 100 * rep > rules.max_repeat_percent * n
                rows.append((n, chars, symbols, dup, rep, failed, not failed and lost <= rules.max_lost * n, lines, lost, cleaned))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                [x.split()[0] for x in SCHEMA.split(", ")]
            )

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "text", make, SCHEMA)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, without the lines that fail; same columns, n_chars counted anew."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, texts = [], []
            for text in strings(batch.column("text")):
                n, _, _, _, rep = base_figures(text or "", hashes)
                cleaned, _, lost = clean(text or "", rules)
                keep.append(n >= rules.min_words and 100 * rep <= rules.max_repeat_percent * n and lost <= rules.max_lost * n)
                texts.append(cleaned)
            return with_text(batch, pa.array(texts, pa.string())).filter(pa.array(keep, pa.bool_()))

        return work

    return map_chunks(docs, "text", make, docs.schema)
