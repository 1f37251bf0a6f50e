"""Token ids of whole texts by a tokenizers file whose pre-tokenizer drops white space, word by word.

No piece of such a tokenizer spans ASCII white space, so a text's ids are those of its
words one after the other; the ids of words seen before are kept, up to a limit. Words of
Latin letters, alone or before ASCII punctuation, give one pre-token for the letters and
one for what follows. The letters go to the file's BPE model many words at a time, lower-cased and
written in its byte alphabet; the last id of each is marked as a word's end. Other words go
through the whole tokenizer.

Defined results: no texts give no ids; an empty text, or one of white space, has no ids but end_id; repeated words and texts have the same ids each time.
A word of any length is a single word; what is kept of words seen before is bounded by their number.
"""

from __future__ import annotations

import functools
import os
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged


@functools.lru_cache(maxsize=1)
def shared_coder(path: str, end_id: int) -> WordTokens:
    """One coder for all tasks of a Python worker: words that an earlier task met are known to the next."""
    return WordTokens(path, end_id)


END_OF_WORD = "</w>"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_STOP = b" "  # no word: stands for the id at a document's end
_NONE = b""  # what white space at a text's end leaves: no ids


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the others from 256 on. Spaces are left, as they part words."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest) if b != 32}


class _Index(dict):
    """Numbers words as they are asked for; `new` gathers those numbered since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class WordTokens:
    def __init__(self, path: str, end_id: int, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = byte_alphabet()
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if max(size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith(END_OF_WORD)
        self.end_id, self.limit = end_id, limit
        self.marks: dict[bytes, np.ndarray] = {}
        self._reset()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _reset(self) -> None:
        self.index = _Index()
        self.index.update({_STOP: 0, _NONE: 1})
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.sizes[0] = 1
        self.flat, self.used = np.full(1 << 16, self.end_id, self.dtype), 1

    def _add(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the words with these numbers, one after the other."""
        while len(self.index) > len(self.starts):
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[rows] = self.used + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.used += len(ids)

    def _tails(self, marks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each distinct run of marks, and which of them each word has."""
        distinct = {mark: n for n, mark in enumerate(dict.fromkeys(marks))}
        if len(self.marks) > 10_000:
            self.marks.clear()
        for mark in distinct:
            if mark not in self.marks:
                self.marks[mark] = self._encode(mark.decode())
        return [self.marks[mark] for mark in distinct], np.fromiter(map(distinct.__getitem__, marks), np.int64, len(marks))

    def _learn(self, new: list[bytes]) -> None:
        """Encode the words numbered last and keep their ids."""
        base = len(self.index) - len(new)
        odd: list[int] = []
        letters = [word.isalpha() for word in new]
        numbers = list(compress(range(base, base + len(new)), letters))
        lows = b" ".join(compress(new, letters)).lower().split()
        marks: list[bytes] = [b""] * len(lows)  # what follows the letters
        others = list(compress(zip(range(base, base + len(new)), new), map(not_, letters)))
        stems = [word.rstrip(_MARKS) for _, word in others]
        lowered = b"\n".join(stems).decode("utf-8").lower()  # words hold no line end, and one parts them for lower() as an end does
        narrow = not lowered or max(lowered) < "\u0300"
        for (i, word), stem, text in zip(others, stems, lowered.split("\n"), strict=False):
            if text.isalpha() and (narrow or max(text) < "\u0300"):
                numbers.append(i)
                lows.append(text.encode())
                marks.append(word[len(stem) :])
            else:
                odd.append(i)
        if lows:
            ascii = np.fromiter(map(bytes.isascii, lows), bool, len(lows))
            order = np.r_[np.flatnonzero(ascii), np.flatnonzero(~ascii)]
            parts = []
            for own, low in ((ascii, list(compress(lows, ascii))), (~ascii, list(compress(lows, ~ascii)))):
                # in parts: the library holds some hundred bytes a token until a call is over
                for k in range(0, len(low), 1 << 15):
                    joined = b" ".join(low[k : k + (1 << 15)]).decode("latin-1")
                    coded = self.model.encode_batch_fast([joined if own is ascii else joined.translate(self.alphabet)], add_special_tokens=False)[0]
                    parts.append(np.array(coded.ids, self.dtype))
            ids = np.concatenate(parts)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(lows):
                raise ValueError("a word of letters gave other than one pre-token")
            body = np.diff(np.r_[-1, last])
            tails, which = self._tails(list(compress(marks, ascii)) + list(compress(marks, ~ascii)))
            extra = np.array([len(t) for t in tails])[which]
            sizes = body + extra
            ends = np.cumsum(sizes)
            out = np.empty(int(ends[-1]), self.dtype)
            out[np.arange(len(ids)) + np.repeat(np.cumsum(extra) - extra, body)] = ids
            out[ragged(np.arange(len(out)), ends - extra, extra)] = ragged(np.concatenate(tails), np.cumsum([0, *map(len, tails[:-1])])[which], extra)
            self._add(np.array(numbers)[order], out, sizes)
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([new[i - base].decode("utf-8") for i in part], add_special_tokens=False)]
            self._add(np.array(part), np.array([t for x in found for t in x], self.dtype), np.array([len(x) for x in found], np.int64))

    def _renew(self, words: list[bytes]) -> None:
        """Forget all but those of words that are known, and the words that the most calls have asked for, half of the limit at most."""
        names = list(self.index)
        hits = self.hits[: len(names)]
        least = 2
        while (hits >= least).sum() > self.limit // 2:
            least *= 2
        keep = hits >= least
        keep[[i for i in map(self.index.get, dict.fromkeys(words)) if i is not None]] = True
        keep[:2] = False
        rows = np.flatnonzero(keep)
        ids, sizes, hits = ragged(self.flat, self.starts[rows], self.sizes[rows]), self.sizes[rows], hits[rows] // 2
        self._reset()
        self.index.update(zip([names[i] for i in rows.tolist()], range(2, len(rows) + 2), strict=True))
        self._add(np.arange(2, len(rows) + 2), ids, sizes)
        self.hits[2 : len(rows) + 2] = hits

    def encode(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and how many each text has."""
        if not len(texts):
            return self.flat[:0], np.empty(0, np.int64)
        column = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.index) > self.limit:
            self._renew(words)
        own = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._learn(new)
        self.hits[own] += 1
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = lengths + 1
        # a text's words, then the stop
        rows = np.zeros(int(counts.sum()), np.int64)
        inside = np.ones(len(rows), bool)
        inside[np.cumsum(counts) - 1] = False
        rows[inside] = own[coded.indices.to_numpy()]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = (self.starts[rows] - (ends - sizes)).astype(np.int32)
        ids = self.flat[np.arange(total, dtype=np.int32) + np.repeat(shift, sizes)]
        edge = np.cumsum(counts) - 1
        per = np.diff(np.r_[0, ends[edge]]) if len(edge) else np.empty(0, np.int64)
        return ids, per
