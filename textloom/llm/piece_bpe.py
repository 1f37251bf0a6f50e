"""SentencePiece BPE encoding and decoding (8) by vectorised merge rounds.

A text is one space mark and the text with its spaces as marks. It is cut where no piece
of the vocabulary holds the two neighbouring characters, so that no merge could cross; each distinct
unit is merged once. Merging runs on flat arrays over all new units at once: find each
unit's least pair rank, merge its leftmost pairs of that rank together, close the gaps, until no
pair is left. Merging several pairs of a unit in one round is exact unless a pair that
arises on the way ranks as low; a unit where one does merges its leftmost pair only.
Units over `long_unit` characters go through the same rounds with their places kept by rank, so that a round costs
what it merges and not the length of the unit.

Characters outside the vocabulary become byte pieces. Decoding gathers the pieces' bytes, with spaces
for marks and without the first mark; bytes that are no UTF-8 give U+FFFD each.

Covers models of type BPE with identity normalisation, a dummy prefix, byte fallback and no user-defined
pieces; others are refused. Defined results: null text is empty; an empty text has no
ids; rows that repeat are each encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, ragged, strings, text_of

MARK = "▁"
_NONE = np.int32(2**31 - 1)
_NEAR = 1024


class PieceCoder:
    def __init__(self, path: str, limit: int = 250_000, long_unit: int = 512):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)])
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.known = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        probe = " a  b\né"
        if not all(sp.is_byte(int(i)) for i in self.bytes) or sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only BPE models with byte fallback and identity normalisation are covered")
        self.unknown, self.limit, self.long_unit = sp.unk_id(), limit, long_unit
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        # A symbol is a piece, or a character of pieces that is no piece itself.
        chars = sorted({c for p in self.known for c in p})
        self.symbols = dict(self.known)
        for c in chars:
            self.symbols.setdefault(c, size + len(self.symbols))
        self.span = size + len(self.symbols) + 1
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = self.symbols[c]
        table = {}
        for p, i in self.known.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    table[a * self.span + b] = i
        self.pair_keys = np.array(sorted(table), np.int64)
        self.pair_ids = np.array([table[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_ranks = rank[self.pair_ids]
        made = np.full(self.span, -1, np.int64)  # the rank of a symbol's own merge; none for a character
        made[[i for p, i in self.known.items() if len(p) > 1]] = rank[[i for p, i in self.known.items() if len(p) > 1]]
        #: Ranks of merges whose piece may at once be part of a merge that ranks no later, as in runs of spaces, whose pieces all rank alike.
        self.dependent = {int(r) for part in (self.pair_keys // self.span, self.pair_keys % self.span) for r in np.unique(made[part][made[part] >= self.pair_ranks])}
        self.ranks: dict[int, tuple[int, int]] = {}
        # Characters below _NEAR, and the mark in a place of its own, that stand side by side in a piece.
        self.place = np.full(0x110000, -1, np.int16)
        self.place[:_NEAR] = np.where(self.of_char[:_NEAR] >= 0, np.arange(_NEAR), -1)
        self.place[ord(MARK)] = _NEAR
        together = np.zeros((_NEAR + 2, _NEAR + 2), bool)
        far = (_NEAR + 1) * np.ones(0x110000, np.int16)
        far[self.of_char < 0] = -1
        self.place = np.where(self.place >= 0, self.place, far).astype(np.int16)
        for p in self.known:
            at = [int(self.place[ord(c)]) for c in p]
            for x, y in zip(at, at[1:]):
                together[x, y] = True
        self.together = together.ravel()
        # What a piece decodes to.
        shown = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.leads = np.array([p.startswith(MARK) and not special[i] for i, p in enumerate(pieces)])
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the id of each pair's merge; no rank where there is none."""
        keys = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        there = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(there, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merge_rounds(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each unit after all merges. sym: flat symbols, those outside the vocabulary below 0; sizes: of units, 1 at least."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.arange(len(sizes))
        unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        rank[inner], into[inner] = self._look_up(sym[inner], sym[inner + 1])
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            over = best == _NONE
            if over.any():  # these units are finished
                gone = over[unit]
                done.append((which[over], sym[gone], sizes[over]))
                keep = ~gone
                sym, rank, into = sym[keep], rank[keep], into[keep]
                which, sizes, best = which[~over], sizes[~over], best[~over]
                if not len(sizes):
                    break
                unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.flatnonzero(rank == best[unit])
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            take = at[nth % 2 == 0]
            while True:
                merged = sym.copy()
                merged[take] = into[take]
                keep = np.ones(len(sym), bool)
                keep[take + 1] = False
                place = np.cumsum(keep) - 1
                new_sym, new_unit = merged[keep], unit[keep]
                new_rank, new_into = rank[keep], into[keep]
                here = place[take]
                touched = np.unique(np.concatenate([here, here[here > 0] - 1]))
                new_rank[touched] = _NONE
                touched = touched[touched + 1 < len(new_sym)]
                touched = touched[new_unit[touched] == new_unit[touched + 1]]
                new_rank[touched], new_into[touched] = self._look_up(new_sym[touched], new_sym[touched + 1])
                owner = unit[take]
                several = np.bincount(owner, minlength=len(sizes)) > 1
                if not several.any():
                    break
                early = new_unit[touched][new_rank[touched] <= best[new_unit[touched]]]
                close = np.flatnonzero((take[1:] == take[:-1] + 2) & (owner[1:] == owner[:-1]))
                between, _ = self._look_up(into[take[close]], sym[take[close] + 2])
                bad = np.zeros(len(sizes), bool)
                bad[early] = True
                bad[owner[close][between <= best[owner[close]]]] = True
                bad &= several
                if not bad.any():
                    break
                first = np.r_[True, owner[1:] != owner[:-1]]
                take = take[first | ~bad[owner]]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            sym, rank, into, unit = new_sym, new_rank, new_into, new_unit
        order = np.concatenate([w for w, _, _ in done])
        flat, counts = np.concatenate([s for _, s, _ in done]), np.concatenate([k for _, _, k in done])
        begin = np.cumsum(counts) - counts
        back = np.argsort(order)
        return ragged(flat, begin[back], counts[back]), counts[back]

    def merge_ranked(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same rounds for long units, each at the cost of what it merges.

        Places wait by rank. A round takes the least rank of all, which is the least of every unit that has
        it, and merges its leftmost pairs together; neighbours are kept as links, so the gaps are closed once, at the end.
        Where a merge can give a pair that ranks no later, the round's merges depend on each other and are taken one by one.
        What a round leaves ranks after it, so there are at most as many rounds as the vocabulary has ranks."""
        n = len(sym)
        sym = sym.astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(sizes) - 1
        after[last], before[last - sizes + 1] = -1, -1
        alive = np.ones(n, bool)
        rank, into = np.full(n, _NONE, np.int32), np.zeros(n, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def offer(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places and let them wait by rank."""
            right = after[at]
            rank[at[right < 0]] = _NONE
            at, right = at[right >= 0], right[right >= 0]
            rank[at], into[at] = self._look_up(sym[at], sym[right])
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for own in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(own):
                    r = int(rank[own[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(queue, r)
                    waiting[r].append(own)

        offer(np.arange(n))
        while queue:
            least = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(least)))
            at = at[alive[at] & (rank[at] == least)]
            if not len(at):
                continue
            if least in self.dependent:
                offer(self._one_by_one(at, least, sym, after, before, alive))
                continue
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            take = at[nth % 2 == 0]
            gone = after[take]
            sym[take], alive[gone] = into[take], False
            follow = after[gone]
            after[take] = follow
            before[follow[follow >= 0]] = take[follow >= 0]
            ahead = before[take]
            offer(np.unique(np.r_[take, ahead[ahead >= 0]]))
        return sym[alive].astype(np.int32), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[alive], minlength=len(sizes))

    def _one_by_one(self, at: np.ndarray, most: int, sym: np.ndarray, after: np.ndarray, before: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Merge the pairs at these places and those that arise up to rank `most`, least rank first, then leftmost. Returns the places whose pair is a later one."""
        if not self.ranks:
            self.ranks = {int(k): (int(r), int(i)) for k, r, i in zip(self.pair_keys, self.pair_ranks, self.pair_ids, strict=True)}
        later: set[int] = set()
        heap = [(most, int(a)) for a in at]
        while heap:
            r, a = heapq.heappop(heap)
            b = int(after[a])
            found = self.ranks.get(int(sym[a]) * self.span + int(sym[b])) if alive[a] and b >= 0 else None
            if found is None or found[0] != r:
                continue
            sym[a], alive[b] = found[1], False
            follow = int(after[b])
            after[a] = follow
            if follow >= 0:
                before[follow] = a
            for x in (int(before[a]), a):
                if x >= 0 and after[x] >= 0 and sym[x] >= 0 and sym[after[x]] >= 0:
                    near = self.ranks.get(int(sym[x]) * self.span + int(sym[after[x]]))
                    if near and near[0] <= most:
                        heapq.heappush(heap, (near[0], x))
                        continue
                if x >= 0:
                    later.add(x)
        places = np.array(sorted(later), np.int64)
        return places[alive[places]]

    def _learn(self, new: list[str]) -> None:
        """Encode new units and keep their ids. Characters outside the vocabulary are units of their own."""
        text = "".join(new)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        sym = self.of_char[points]
        starts = np.cumsum(sizes) - sizes
        flat, counts = np.empty(0, np.int32), np.zeros(len(new), np.int64)
        begin = np.zeros(len(new), np.int64)
        for rows, merge in ((np.flatnonzero(sizes <= self.long_unit), self.merge_rounds), (np.flatnonzero(sizes > self.long_unit), self.merge_ranked)):
            if len(rows):
                own, counts[rows] = merge(ragged(sym, starts[rows], sizes[rows]), sizes[rows])
                begin[rows] = len(flat) + np.cumsum(counts[rows]) - counts[rows]
                flat = np.concatenate([flat, own])
        flat = ragged(flat, begin, counts)
        # What is no piece becomes its bytes.
        wild = (flat < 0) | (flat >= len(self.shown_sizes))
        if wild.any():
            owner = np.repeat(np.arange(len(new)), counts)
            chars = {s: c for c, s in self.symbols.items() if s >= len(self.shown_sizes)}
            out = []
            for s, o in zip(flat.tolist(), owner.tolist(), strict=True):
                if s < 0:
                    out.append(self.bytes[list(new[o].encode())])
                elif s >= len(self.shown_sizes):
                    out.append(self.bytes[list(chars[s].encode())])
                else:
                    out.append(np.array([s], np.int32))
            lengths = np.array([len(x) for x in out])
            flat, counts = np.concatenate(out), np.bincount(owner, weights=lengths, minlength=len(new)).astype(np.int64)
        at = len(self.index)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        while at + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[at : at + len(new)] = self.used + np.cumsum(counts) - counts
        self.sizes[at : at + len(new)] = counts
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.index) > self.limit or self.used > 16 * self.limit:
            self._reset()
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        place = self.place[np.frombuffer(whole.encode("utf-32-le"), "<u4")].astype(np.int32)
        cut = np.empty(len(place), bool)
        cut[1:] = ~self.together[place[:-1] * (_NEAR + 2) + place[1:]] | (place[:-1] < 0) | (place[1:] < 0)
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        cut[np.r_[0, ends[:-1]][np.r_[0, ends[:-1]] < len(cut)]] = True
        edges = np.flatnonzero(cut)
        stops = np.r_[edges[1:], len(place)].tolist()
        units = [whole[a:b] for a, b in zip(edges.tolist(), stops, strict=True)]
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        sizes = self.sizes[rows]
        ids = ragged(self.flat, self.starts[rows], sizes)
        upto = np.r_[0, np.cumsum(sizes)]
        per = np.diff(upto[np.searchsorted(edges, np.r_[0, ends])])
        return ids, per

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        sizes = self.shown_sizes[ids]
        data = ragged(self.shown, self.shown_starts[ids], sizes).tobytes()
        upto = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(counts)
        out = []
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            text = data[upto[a] : upto[b]]
            first = next((i for i in ids[a:b].tolist() if self.shown_sizes[i]), None) if a < b else None
            if first is not None and self.leads[first]:
                text = text[1:]
            try:
                out.append(text.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(_lenient(text))
        return out


def _lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, at = [], 0
    while at < len(data):
        for k in (1, 2, 3, 4):
            try:
                out.append(data[at : at + k].decode("utf-8"))
                at += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


SCHEMA = "doc_id long, ids array<int>, decoded string"


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """A row per document: its ids, and the text that they decode to."""

    def make():
        coder = PieceCoder(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = coder.encode(strings(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(coder.decode(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "text", make, SCHEMA)
