"""Conversation structure repair (12): each distinct signature is solved once.

A row's letter tells its role's initial (s, u, a or another) and its first fault: blank (no character but white space), duplicate (role and text
seen earlier in the conversation) or truncated (the last such character is no `.`, `!` or `?`). A conversation's letters in the order of its
rows are its signature. The cheapest edits that give roles `(s?(ua)+)?` depend on it alone:

    K keep 0; R another role, user or assistant 2; D delete 3, a must for blank and duplicate rows;
    I insert an empty user or assistant row 2; a truncated row that is not deleted 1 more.

Signatures are solved by memoised recursion on their halves: `costs` is the table of least costs from each state before a piece to each after it,
`edits` writes the edits of a piece that are least by cost, then by ASCII. Audits are joined back by signature, and the edits are replayed
on the rows.

How it is spread: rows without their texts (digests stand for them) settle faults and signatures. Equal rows are counted before they are
shuffled; which of them are duplicates comes from the least turn of each role and text, joined back, so that Spark can split it where one
is hot. Rows are then sorted by ranges of conversation and turn, which splits a conversation that holds a third of them, and put into pieces of
up to 4096 letters. A conversation's signature has a letter a row, as its audit has, which the result holds in one row. The texts are
shuffled once, for the replay, where a task reads them in order and holds one row and the edits of one conversation.

Order within a conversation: turn (nulls first), role, digest of the text. Defined results: a null role or text is one space; a null conv_id is a
conversation of its own; a role that is empty or begins otherwise can't be kept; a conversation without rows needs no edits; gaps beyond a long are 0; an empty table gives an
empty result; other columns are passed over.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_chunks, materialise, small_batches

INITIALS, FAULTS = "sua-", ("", "truncated", "blank", "duplicate")
#: A letter for each initial and fault, as in "sua-" + "SUA=" + ...: fixed by place.
LETTERS = ("sua-", "tvb_", "SUA=", "TVB+")
_MEANING = {c: (i, f) for f, row in enumerate(LETTERS) for i, c in enumerate(row)}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: States: nothing yet, after a system row, after a user row, after an assistant row. What may follow, and what that leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
_FILLED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted row or a new role
_AT_END = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
_FAR = 1 << 60
Table = tuple[tuple[int, ...], ...]


def _moves(letter: str, state: int) -> Iterator[tuple[int, str, int]]:
    """Cost, edits and next state of all ways to deal with one row, with up to two rows inserted before it."""
    initial, fault = _MEANING[letter]
    late = int(fault == 1)
    for inserted in range(3):
        paid, said = 2 * inserted, "I" * inserted
        yield paid + 3, said + "D", state
        if fault < 2:
            if initial in _NEXT[state]:
                yield paid + late, said + "K", _NEXT[state][initial]
            yield paid + late + 2, said + "R", _FILLED[state]
        state = _FILLED[state]


def _costs(piece: str) -> Table:
    if len(piece) == 1:
        out = [[_FAR] * 4 for _ in range(4)]
        for state in range(4):
            for cost, _, to in _moves(piece, state):
                out[state][to] = min(out[state][to], cost)
        return tuple(map(tuple, out))
    left, right = costs(piece[: len(piece) // 2]), costs(piece[len(piece) // 2 :])
    return tuple(tuple(min(left[a][b] + right[b][c] for b in range(4)) for c in range(4)) for a in range(4))


def _edits(piece: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The piece's edits from this state, where each state after it costs as much, and the state they lead to."""
    if len(piece) == 1:
        least = min(cost + after[to] for cost, _, to in _moves(piece, state))
        return min((said, to) for cost, said, to in _moves(piece, state) if cost + after[to] == least)
    left, right = piece[: len(piece) // 2], piece[len(piece) // 2 :]
    table = costs(right)
    between = tuple(min(table[b][c] + after[c] for c in range(4)) for b in range(4))
    first, middle = edits(left, state, _from_least(between))
    second, end = edits(right, middle, _from_least(after))
    return first + second, end


def _from_least(after: tuple[int, ...]) -> tuple[int, ...]:
    """The same costs from 0 on, so that pieces met under like costs are solved once."""
    least = min(after)
    return tuple(x - least for x in after)


#: Short pieces recur in many signatures; long ones do not, and would only fill the memory.
_known_costs, _known_edits = functools.lru_cache(100_000)(_costs), functools.lru_cache(100_000)(_edits)


def costs(piece: str) -> Table:
    return (_known_costs if len(piece) <= 64 else _costs)(piece)


def edits(piece: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    return (_known_edits if len(piece) <= 64 else _edits)(piece, state, after)


def solve(signature: str) -> tuple[int, str]:
    """The least cost, and of the audits that have it the ASCII-least."""
    if not signature:
        return 0, ""
    after = tuple(_AT_END[s][0] for s in range(4))
    audit, end = edits(signature, START, after)
    cost = min(a + b for a, b in zip(costs(signature)[START], after, strict=True))
    return cost, audit + _AT_END[end][1]


def illegal(signature: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = [_MEANING[c][0] for c in signature]
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solve_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for s in batch.column("signature").to_pylist():
        faults = [sum(map(s.count, LETTERS[f])) for f in (2, 3, 1)]
        rows.append((s, *faults, illegal(s), *solve(s)))
    names = [x.split()[0] for x in SOLVED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("signature", "audit") else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


def damage(table: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage, by crc32 of `conv_id:turn`; a row that is dropped stays with `here` false, so that its conversation does."""
    space, kind = F.lit(" "), F.col("kind")
    rows = table.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("kind")
    )
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("here"), kind)
    return out.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def as_they_are(table: DataFrame) -> DataFrame:
    """The rows of a table that is to be repaired as it is, in the form of `damage`."""
    space = F.lit(" ")
    return table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(True).alias("here"))


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def _letters(rows: DataFrame) -> DataFrame:
    """A row for each turn, role and text of a conversation, with the letters of all its copies; no letters for rows that are not here."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"), "here")
    counted = narrow.groupBy("conv_id", "turn", "role", "digest", "fault", "here").agg(F.count("*").cast("int").alias("copies"))
    # the first turn of each role and text that comes more than once: nulls are least
    least = counted.filter("here").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"), F.count("*").alias("times"))
    least = least.filter("times > 1").select(*(F.col(c).alias(f"first_{c}") for c in ("conv_id", "role", "digest")), F.col("least.turn").alias("first_turn"), F.lit(True).alias("again"))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("conv_id", "role", "digest")]
    joined = counted.join(least, same[0] & same[1] & same[2], "left")
    later = F.coalesce(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first_turn")), F.lit(False))
    own = F.substring("role", 1, 1)
    initial = F.when(own == "s", 1).when(own == "u", 2).when(own == "a", 3).otherwise(4)

    def letter(f: Column) -> Column:
        return F.substring(F.element_at(F.array(*map(F.lit, LETTERS)), f + 1), initial, F.lit(1))

    copied = F.when(F.col("fault") == 2, 2).otherwise(3)
    first = letter(F.when(later, copied).otherwise(F.col("fault")))
    said = F.when(F.col("here"), F.concat(first, F.repeat(letter(copied), F.col("copies") - 1))).otherwise("")
    return joined.select("conv_id", "turn", "role", "digest", said.alias("letters"))


PIECES = "conv_id long, place long, letters string, low long, high long, turns long"


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Neighbouring letters of a conversation as one row, with the least and the greatest turn among them and how many there are; a new piece after `most` letters."""
    out: list[tuple] = []
    now, place, said, size, low, high, turns = None, 0, [], 0, None, None, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "letters" else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)
        out.clear()

    for batch in batches:
        for conv, turn, letters, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letters", "place")), strict=True):
            if now is None or now[0] != conv or size >= most:
                if now is not None:
                    out.append((now[0], place, "".join(said), low, high, turns))
                now, place, said, size, low, high, turns = (conv,), at, [], 0, None, None, 0
            said.append(letters)
            size += max(1, len(letters))
            if letters and turn is not None:
                turns += turn != high
                low, high = turn if low is None else low, turn
        if len(out) >= 10_000:
            yield from flushed()
    if now is not None:
        out.append((now[0], place, "".join(said), low, high, turns))
    if out:
        yield from flushed()


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and gaps of every conversation."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    ordered = _letters(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    small_batches(rows.sparkSession)
    pieces = ordered.select("conv_id", "turn", "letters", F.monotonically_increasing_id().alias("place")).mapInArrow(_pieces, PIECES)
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "letters", "low", "high", "turns"))).alias("p"))
    # a turn on both sides of a border was counted twice
    turns = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")),
        lambda so, x: F.struct(
            (so["n"] + x["turns"] - F.when(x["low"] == so["last"], 1).otherwise(0)).alias("n"), F.coalesce(x["high"], so["last"]).alias("last")
        ),
        lambda so: so["n"]
    )
    wide = lambda c: c.cast("decimal(21,0)")
    gaps = wide(F.array_max("p.high")) - wide(F.array_min("p.low")) + 1 - wide(turns)
    return whole.select("conv_id", F.array_join("p.letters", "").alias("signature"), F.coalesce(gaps.try_cast("long"), F.lit(0)).alias("gaps"))


def audits(rows: DataFrame) -> DataFrame:
    """A row per conversation: gaps, faults, cost and audit. Each distinct signature is solved once."""
    # read twice, for the distinct ones and for the join, so written once
    found = materialise(signatures(rows), "signatures")
    solved = map_chunks(found.select("signature").distinct(), "signature", lambda: _solve_batch, SOLVED, 1 << 20)
    return found.join(solved, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


HEAD = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPLAYED = f"{HEAD}, head boolean, seat long, edit string, role string, text string"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's row of figures, then its repaired rows, as they come; figures stand before rows."""
    names = [x.split()[0] for x in REPLAYED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
    audit, at, state, seat, conv = "", 0, START, 0, None
    out: list[tuple] = []

    def put(edit: str, role: str, text: str, to: int) -> None:
        nonlocal state, seat
        out.append((conv, *[None] * 7, False, seat, edit, role, text))
        state, seat = to, seat + 1

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", "user" if state != USER else "assistant", "", _FILLED[state])
            at += 1

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            for row in zip(*(part.column(c).to_pylist() for c in (*names[:9], "role", "text")), strict=True):
                if row[8]:
                    insert()
                    conv, audit, at, state, seat = row[0], row[7], 0, START, 0
                    out.append((*row[:9], *[None] * 4))
                    continue
                insert()
                edit, (role, text) = audit[at], row[9:]
                at += 1
                if edit == "K":
                    put(edit, role, text, _NEXT[state]["sua".index(role[0])])
                elif edit == "R":
                    put(edit, "user" if state != USER else "assistant", text, _FILLED[state])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
    insert()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def replay(rows: DataFrame) -> DataFrame:
    """Per conversation a row of figures (`head`), followed by its repaired rows: seat, edit, role, text. Each conversation is in one partition, in order."""
    heads = audits(rows).select("*", F.lit(True).alias("head"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    nothing = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in heads.columns[1:8]]
    texts = rows.filter("here").select("conv_id", *nothing, F.lit(False).alias("head"), "turn", "role", _digest().alias("digest"), "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("head").desc(), *(F.col(c).asc_nulls_first() for c in ("turn", "role", "digest"))]
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")
    small_batches(rows.sparkSession)
    return both.mapInArrow(_replay, REPLAYED)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, seat from 0, the edit that put the row there, role and text."""
    return replay(rows).filter("not head").select("conv_id", "seat", "edit", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(x.split()[0] for x in HEAD.split(", ")), "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    figures, told = None, hashlib.sha256()
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*names[:8], "head", "seat", "role", "text")), strict=True):
            if row[8]:
                if figures:
                    out.append((*figures, told.hexdigest()))
                figures, told = row[:8], hashlib.sha256()
            else:
                told.update(("\n" if row[9] else "").encode() + f"{row[10]}:{row[11]}".encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if figures:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*figures, told.hexdigest()), kinds, strict=True)], names)


def summaries(rows: DataFrame) -> DataFrame:
    """A row per conversation: its figures, its audit, and the digest of the repaired `role:text`, joined by newlines."""
    return replay(rows).mapInArrow(_digests, f"{HEAD}, repaired_sha256 string")
