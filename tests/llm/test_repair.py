"""Conversation repair, against SQL, a plain search over all edits and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import pytest

from textloom.llm import repair
from textloom.llm.queries import OP12_SQL, op12_conversation_repair

from .common import SF

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())) for c, x in out.items()}


def faults_by_hand(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest_by_hand(rows, faults):
    """Dijkstra's way over (rows done, roles so far as a state), by cost and then by audit; the repaired rows come along."""
    import heapq

    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        ways = [(2, "I", i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                late = faults[i] == "truncated"
                ways += [(late, "K", i + 1, role, f"{role}:{text}"), *((2 + late, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for more, edit, j, role, row in ways:
            if (state, role[:1]) in follow:
                heapq.heappush(heap, (cost + more, audit + edit, j, follow[state, role[:1]], (*out, row)))
    raise AssertionError


def summary_by_hand(rows):
    faults, initials = faults_by_hand(rows), [r[1][:1] for r in rows]
    turns = {r[0] for r in rows} - {None}
    cost, audit, text = cheapest_by_hand(rows, faults)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()
    )


def compare(spark, rows):
    got = {r[0]: tuple(r[1:]) for r in repair.summaries(repair.damage(spark.createDataFrame(rows, TURNS))).collect()}
    by_hand = damaged_by_hand(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == summary_by_hand(by_hand.get(conv, [])), conv


def test_every_signature_of_up_to_four_letters_by_search():
    """All roles and faults: cost and audit are those of a plain search."""
    roles, texts = {0: "s", 1: "u", 2: "a", 3: "x"}, {0: "t.", 1: "t", 2: "", 3: "d."}
    letters = [c for row in repair.LETTERS[:3] for c in row]
    for n in range(5):
        for picked in product(letters, repeat=n) if n < 3 else random.Random(n).sample(list(product(letters, repeat=n)), 1500):
            signature = "".join(picked)
            rows = [(i, roles[repair._MEANING[c][0]], texts[repair._MEANING[c][1]] and f"{i}{texts[repair._MEANING[c][1]]}") for i, c in enumerate(picked)]
            assert repair.solve(signature) == cheapest_by_hand(rows, [repair.FAULTS[repair._MEANING[c][1]] for c in picked])[:2], signature


def test_long_signatures():
    r = random.Random(2)
    for n in (50, 300):
        signature = "".join(r.choice("".join(repair.LETTERS)) for _ in range(n))
        rows = [(i, "suax"[repair._MEANING[c][0]], "") for i, c in enumerate(signature)]
        assert repair.solve(signature) == cheapest_by_hand(rows, [repair.FAULTS[repair._MEANING[c][1]] for c in signature])[:2]
    cost, audit = repair.solve("ua" * 200_000 + "u")
    assert cost == 2 and len(audit) == 400_002


def test_the_whole_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.sql(OP12_SQL).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in op12_conversation_repair(spark, SF).collect()}
    assert got == want and len(got) >= 20


@pytest.mark.parametrize("seed", range(3))
def test_made_up_conversations_by_search(spark, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "", None, " \n", "cut off", "Again?  \n", "Ü.", "ends with next line.\u0085", "x "]
    rows = [
        (r.choice([1, 2, 3, None, 5, 6, 7]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None, "User"]), r.choice(texts))
        for _ in range(120)
    ]
    compare(spark, rows + rows[:15])


def test_one_conversation_over_many_partitions(spark):
    """A third of all rows in one conversation, one turn said again and again, and copies without a turn."""
    r = random.Random(9)
    hot = [(0, i, r.choice(["user", "assistant"]), r.choice(["Same.", f"Row {i}.", f"cut {i}"])) for i in range(700)]
    rows = hot + [(0, None, "user", "Same.")] * 50 + [(None, 3, "user", "Copy.")] * 300 + [(c, t, "ua"[t % 2] + "x", f"{c} {t}.") for c in range(1, 200) for t in range(5)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = repair.signatures(repair.damage(spark.createDataFrame(rows, TURNS)))
        assert pieces.count() == 201
        compare(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_repaired_rows_and_odd_tables(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "Hi.", "x"), (1, 1, "assistant", "y" * 3_000_000 + ".", "x"), (2, None, "system", "S.", None)], TURNS + ", Role_ string")
    rows = repair.repaired(repair.as_they_are(table)).orderBy("conv_id", "seat").collect()
    assert [(x.conv_id, x.seat, x.edit, x.role, x.text[:3]) for x in rows] == [(1, 0, "R", "user", "Hi."), (1, 1, "K", "assistant", "yyy")]
    none = spark.createDataFrame([], TURNS)
    assert repair.summaries(repair.damage(none)).count() == 0 and repair.repaired(repair.as_they_are(none)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.summaries(repair.damage(spark.createDataFrame([(gone, 0, "user", "a")], TURNS))).collect()
    assert tuple(row[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    (row,) = repair.summaries(repair.as_they_are(spark.createDataFrame([(1, 2**63 - 1, "user", "a."), (1, -(2**63), "user", "a")], TURNS))).collect()
    assert row.gaps == 0
