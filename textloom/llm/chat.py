"""Chat formatting by schema fingerprints (3).

A record's nested field paths, sorted and hashed, are its fingerprint. A registry maps
fingerprints to declarative mappings, which say where turns, roles and texts are; so tables and
JSON records of many layouts become canonical turns (role, text) without code for each.

A turn is written between control strings of its role. Where a text holds a control
string, a backslash is put behind its first character (one more where there are some
already), so no control string is left in a text and reading takes the backslash out again. A
conversation is the concatenation of its segments, one row each, so a conversation of any
length is never held at once. The loss mask covers assistant texts without control strings.

Defined results: null text and null role are empty; null conversation ids form one
conversation; turns are ordered by number (null first), ties by role, then text; rows that
repeat are turns each; records of unknown layout or broken JSON give a row with their
fingerprint and no turns; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fingerprints and mappings.


def paths_of(value, prefix: str = "") -> set[str]:
    """The nested field paths of a JSON value; elements of a list share the path with []."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{prefix}.{k}" if prefix else str(k)) for k, v in value.items())) if value else {f"{prefix}.{{}}"}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def paths_of_schema(kind: T.DataType, prefix: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(set(), *(paths_of_schema(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, f"{prefix}[]")
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """fields: (role, path) written one after the other, empty ones left out. turns: a list whose elements hold role and text; names: roles by other names.

    rows: the table has a row per turn, with columns (conversation, order, role, text)."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "content"
    rows: tuple[str, str, str, str] | tuple[()] = ()


NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

#: Layouts with the paths that tell them. Optional fields give a layout more than one set of paths.
LAYOUTS: tuple[tuple[Mapping, tuple[frozenset[str], ...]], ...] = (
    (Mapping("turn rows", rows=("conv_id", "turn", "role", "text")), (frozenset({"conv_id", "turn", "role", "text"}),)),
    (Mapping("prompt and completion", (("user", "prompt"), ("assistant", "completion"))), (frozenset({"prompt", "completion"}),)),
    (
        Mapping("prompt and response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
        (frozenset({"prompt", "response"}), frozenset({"system", "prompt", "response"}))
    ),
    (
        Mapping("instruction", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
        (frozenset({"instruction", "output"}), frozenset({"instruction", "input", "output"}))
    ),
    (Mapping("question and answer", (("user", "question"), ("assistant", "answer"))), (frozenset({"question", "answer"}),)),
    (Mapping("messages", turns="messages"), (frozenset({"messages[].role", "messages[].content"}), frozenset({"id", "messages[].role", "messages[].content"}))),
    (
        Mapping("conversations", turns="conversations", role="from", text="value"),
        (frozenset({"conversations[].from", "conversations[].value"}), frozenset({"id", "conversations[].from", "conversations[].value"}))
    ),
    (Mapping("nested chat", turns="chat.turns", role="author.role", text="body.text"), (frozenset({"chat.turns[].author.role", "chat.turns[].body.text"}),)),
)


def registry() -> dict[str, Mapping]:
    return {fingerprint(set(paths)): mapping for mapping, every in LAYOUTS for paths in every}


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    if mapping.turns:
        return [(NAMES.get(r := _said(_get(t, mapping.role)), r), _said(_get(t, mapping.text))) for t in _get(record, mapping.turns) or []]
    out: list[tuple[str, str]] = []
    for role, path in mapping.fields:
        if text := _said(_get(record, path)):
            if out and out[-1][0] == role:
                out[-1] = (role, f"{out[-1][1]}\n\n{text}")
            else:
                out.append((role, text))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def turns_of_records(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSON records of any known layout as rows: conv_id, turn, role, text, layout (fingerprint where unknown; turn is null then)."""

    def run(batches):
        known = registry()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                mark = fingerprint(paths_of(record)) if isinstance(record, dict) else "broken"
                mapping = known.get(mark)
                turns = turns_of(record, mapping) if mapping and not mapping.rows else []
                rows += [(i, k, role, said, mapping.name) for k, (role, said) in enumerate(turns)] if mapping else [(i, None, None, None, mark)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, f"{TURNS}, layout string")


def turns_of_table(table: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rows conv_id, turn, role, text of a table, by the mapping that its schema's fingerprint selects. Where no layout has just these columns, those beyond the layout
    that has the most of them (the first of such) are passed over."""
    there = paths_of_schema(table.schema) - ({id_col} if id_col else set())
    mapping = registry().get(fingerprint(there))
    if mapping is None:
        within = [(len(paths), -i, paths) for i, (_, every) in enumerate(LAYOUTS) for paths in every if paths <= there]
        if not within:
            raise ValueError(f"no mapping for the layout {sorted(there)}")
        own = max(within, key=lambda x: x[:2])[2]
        mapping = registry()[fingerprint(set(own))]
        tops = {re.split(r"\.|\[", p)[0] for p in own} | ({id_col} if id_col else set())
        table = table.select(*(c for c in table.columns if c in tops))
    if mapping.rows:
        conv, turn, role, text = (F.col(c) for c in mapping.rows)
        return table.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    key = F.col(id_col).cast("long") if id_col else F.xxhash64(*table.columns)
    if mapping.turns:
        one = table.select(key.alias("conv_id"), F.posexplode(mapping.turns).alias("turn", "t"))
        said = F.col(f"t.{mapping.role}")
        names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
        return one.select("conv_id", F.col("turn").cast("long"), F.coalesce(names[said], said).alias("role"), F.col(f"t.{mapping.text}").alias("text"))
    present = [(r, p) for r, p in mapping.fields if p in table.columns]
    merged: dict[str, list[str]] = {}
    for r, p in present:
        merged.setdefault(r, []).append(p)
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(p) != "", F.col(p)) for p in ps)).alias("text")) for r, ps in merged.items()))
    return table.select(
        key.alias("conv_id"), F.posexplode(F.filter(turns, lambda x: x["text"] != "")).alias("turn", "t")
    ).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


# The template.

OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER, NAMED, END = "[TURN]", "[/TURN]", "[END]"
_REST = r"(/?(?:s>|INST\]|SYS\]|TURN\]|END\]))"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1$2\\$3")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
_CONTROL = re.compile(r"<s>|</s>|\[/?INST\]|\[/?SYS\]|\[/?TURN\]|\[END\]")


def _escaped(column):
    return F.regexp_replace(F.coalesce(column, F.lit("")), *(F.lit(x) for x in ESCAPE))


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn_no (from 1), segment, and for assistant turns mask_start, mask_end: code points from the conversation's start."""
    role = F.coalesce("role", F.lit(""))
    known = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[role]
    before = F.coalesce(known(OPEN), F.concat(F.lit(OTHER), _escaped(role), F.lit(NAMED)))
    after = F.coalesce(known(CLOSE), F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text", before.alias("open"), _escaped(F.col("text")).alias("said"), after.alias("close"))
    rows = rows.withColumn("segment", F.concat("open", "said", "close")).withColumn("turn_no", F.row_number().over(order).cast("long"))
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("open")
    mask = lambda x: F.when(F.col("role") == "assistant", x)
    return rows.withColumn("start", start).select(
        "conv_id", "turn_no", "segment", mask(F.col("start")).alias("mask_start"),
        mask(F.col("start") + F.length("said")).alias("mask_end")
    )


def read_segment(segment: str) -> list[tuple[str, str]]:
    """The turns written in a formatted text: (role, text)."""
    roles = {v: k for k, v in OPEN.items()}
    out, at = [], 0
    while m := _CONTROL.match(segment, at):
        role, at = roles.get(m[0]), m.end()
        if role is None:
            named = _CONTROL.search(segment, at)
            role, at = unescaped(segment[at : named.start()]), named.end()
        closing = _CONTROL.search(segment, at)
        out.append((role, unescaped(segment[at : closing.start()])))
        at = closing.end()
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation, read from its segments in order: turns, what the loss mask holds, and digests. Segments stream by; none are kept."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        conv, state, done = None, None, []
        finish = lambda c, s: (c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])
        for batch in batches:
            for c, segment, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segment", "mask_start", "mask_end")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(finish(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_segment(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    under = unescaped(segment[a - state[4] : b - state[4]])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finish(conv, state), kinds, strict=True)], names)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(run, DIGEST)
