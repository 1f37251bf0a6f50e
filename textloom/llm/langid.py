"""Language of whole texts by a linear-chain conditional random field over words (5).

Each word gets scores from its prefixes and suffixes, its character n-grams and a lexicon;
transitions are learned, and forward-backward gives each word's posterior, so text that
switches language is labelled word by word. A document's language is the one with the
highest mean posterior.

The classifier is fitted on the driver from a bounded sample: at most `per_lang` labelled
documents of each language, whole, drawn in the order of a hash of doc_id over all
labelled documents of at most `max_chars` characters, so the sample's size is bounded for a given number of languages. Predictions use nothing but the text and cover every word of it.

Defined results: null text, or text without a letter, is `und` with score 0; null doc_id is
never held out and never learned from; null lang is never learned from; a table without
labelled rows gives `und` for all; ties go to the language first by name; rows that repeat are each predicted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_chunks, strings, text_of
from .crf import marginals, train

BUCKETS = 1 << 16
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Prefixes and suffixes of one to three characters, n-grams of two and three, hashed; and the lexicon's language."""
    marked = f"^{word}$".encode("utf-8", "surrogatepass")
    n = len(word)
    parts = [f"{kind}{x}".encode("utf-8", "surrogatepass") for k in range(1, min(3, n) + 1) for kind, x in (("<", word[:k]), (">", word[-k:]))]
    parts += [marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)]
    out = [zlib.crc32(x) % BUCKETS for x in dict.fromkeys(parts)]
    if (known := lexicon.get(word)) is not None:
        out.append(BUCKETS + known)
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit(rows: list[tuple[str, str]], line_words: int = 48, min_count: int = 3, purity: float = 0.9, epochs: int = 4) -> LanguageModel | None:
    """rows: (text, lang). A word is in the lexicon if it was seen min_count times and this share of them in one language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    counts: dict[str, Counter] = {}
    sequences: list[tuple[list[str], int]] = []
    for text, lang in rows:
        words, label = words_of(text), languages.index(lang)
        for w in words:
            counts.setdefault(w, Counter())[label] += 1
        sequences += [(words[i : i + line_words], label) for i in range(0, len(words), line_words)]
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if (n := c.total()) >= min_count and c.most_common(1)[0][1] >= purity * n}
    if not sequences:
        return LanguageModel(languages, lexicon, np.zeros((BUCKETS + len(languages), len(languages)), np.float32), np.eye(len(languages)))
    known: dict[str, np.ndarray] = {}
    features = [known[w] if w in known else known.setdefault(w, np.array(word_features(w, lexicon))) for words, _ in sequences for w in words]
    labels = np.repeat([x for _, x in sequences], [len(w) for w, _ in sequences])
    weights, trans = train(features, labels, np.array([len(w) for w, _ in sequences]), BUCKETS + len(languages), len(languages), epochs=epochs, stickiness=1.0)
    return LanguageModel(languages, lexicon, weights.astype(np.float32), trans)


def learn(docs: DataFrame, per_lang: int = 60, max_chars: int = 200_000) -> LanguageModel | None:
    """Fit on at most per_lang documents of each language, of at most max_chars characters, that are labelled and not held out."""
    usable = docs.filter((F.length("text") <= max_chars) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * per_lang / n + 10.0 / n))))[F.col("lang")]
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = usable.filter(draw < share).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_lang).orderBy("lang", "nth").select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


class Scorer:
    """Word scores by a fitted model; those of up to `limit` words are kept."""

    def __init__(self, model: LanguageModel, limit: int = 250_000):
        self.model, self.rows, self.limit = model, {}, limit
        self.scores = np.empty((4096, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.rows.clear()
        rows, model = self.rows, self.model
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            at = len(rows)
            ids = [word_features(w, model.lexicon) for w in new]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[at : at + len(new)] = sums
            rows.update(zip(new, range(at, at + len(new)), strict=True))
        return self.scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]


def label_words(texts: list[str | None], scorer: Scorer) -> tuple[list[list[str]], list[np.ndarray]]:
    """The words of each text and their posteriors."""
    words = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    full = lengths[lengths > 0]
    post = marginals(scorer.of([w for x in words for w in x]).astype(np.float64), full, scorer.model.trans) if len(full) else np.empty((0, len(scorer.model.languages)))
    ends = np.cumsum(lengths)
    return words, [post[e - n : e] for e, n in zip(ends, lengths, strict=True)]


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """A row per document; n_switches: how often the most likely language changes from a word to the next."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    if model is None:
        return rows.select(
            "doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches")
        )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, posts = label_words(strings(batch.column("text")), scorer)
            names, scores, switches = [], [], []
            for p in posts:
                if not len(p):
                    names.append("und")
                    scores.append(0.0)
                    switches.append(0)
                    continue
                mean, best = p.mean(0), p.argmax(1)
                top = int(mean.argmax())
                names.append(scorer.model.languages[top])
                scores.append(min(1.0, max(0.0, float(mean[top]))))
                switches.append(int((best[1:] != best[:-1]).sum()))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                    pa.array([len(w) for w in words], pa.int64()), pa.array(switches, pa.int64())
                ],
                [x.split()[0] for x in SCHEMA.split(", ")]
            )

        return work

    return map_chunks(rows, "text", make, SCHEMA)
