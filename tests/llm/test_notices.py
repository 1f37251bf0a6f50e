"""License notices, against a plain dynamic programme and plain word search."""

import random
import re

from textloom.llm import notices
from textloom.llm.queries import op11_license_scans

from .common import SF, docs, none, odd, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_by_hand(text):
    words = WORD.findall(lowered(text))
    found = []
    for phrase, label in notices.PHRASES:
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def distance(notice, text):
    """Edits between the notice and the part of the text that is nearest to it."""
    column = list(range(len(notice) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(notice, 1):
            new.append(min(column[i] + 1, new[i - 1] + 1, column[i - 1] + (p != c)))
        column, best = new, min(best, new[-1])
    return best


def labels_by_hand(text, rules=notices.Rules()):
    """Labels within the edits; which of several that overlap stays is another matter, so this is what may be there."""
    form = " " + " ".join(WORD.findall(lowered(text))) + " "
    return {label for n, label in rules.notices if distance(n, form) <= min(rules.most_edits, len(n) // rules.chars_an_edit)}


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(out)), r.random()
        if kind < 0.33:
            out[i] = r.choice("abcé z")
        elif kind < 0.66:
            out.insert(i, r.choice("abcü x"))
        else:
            del out[i]
    return "".join(out)


def test_the_whole_query_by_hand(spark):
    rows = {r.doc_id: r for r in op11_license_scans(spark, SF).collect()}
    small = docs(spark).collect()
    assert len(rows) == len(small)
    for d in small:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    # documents without any notice at all stay clean; those with one have it
    some = [d for d in small if re.search("licen[sc]e", d.text or "", re.I)] + small[:20]
    for d in some:
        may = labels_by_hand(d.text)
        got = set(filter(None, rows[d.doc_id].labels.split(",")))
        assert got <= may | set(filter(None, rows[d.doc_id].base_labels.split(","))) and bool(got) >= bool(may)
    assert sum(bool(r.labels) for r in rows.values()) >= sum(bool(r.base_labels) for r in rows.values()) > 0


def test_every_notice_within_its_edits_is_found():
    r = random.Random(5)
    scanner = notices.Scanner(notices.Rules())
    for _ in range(300):
        notice, _ = r.choice(notices.NOTICES)
        form = notices.plain(f"Für this, {edited(r, notice, r.randint(0, 7))}. Bar lé end".encode())
        want = {}
        for which, (n, _) in enumerate(notices.NOTICES):
            if (e := distance(n, form.decode())) <= scanner.edits[which]:
                want[which] = e
        got = {}
        for which, at in scanner.candidates(form):
            a, b = max(0, at - 4 * scanner.edits[which]), at + len(notices.NOTICES[which][0]) + 4 * scanner.edits[which]
            if found := scanner.verify(which, form[a:b]):
                got[which] = min(found[2], got.get(which, 99))
        assert got == want


def test_the_version_with_the_fewest_edits_stays():
    scanner = notices.Scanner(notices.Rules())
    for notice, label in notices.NOTICES:
        for text in (notice, edited(random.Random(1), notice[:6], 0) + notice[6:].replace("licens", "lisens", 1)):
            form = notices.plain(text.encode())
            found = scanner.matches(form)
            assert label in {m[0] for m in found} and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_spans_are_of_the_text_itself():
    scanner = notices.Scanner(notices.Rules())
    text = "Ünlike\n\n** Released -- under the MIT Licence!! **  and (Licensed under CC BY-NC 4.0)."
    *_, where = notices.scan_row(text.encode(), scanner)
    got = [(k, text[int(a) : int(b)], int(e)) for k, a, b, e in (x.split(":") for x in where.split(","))]
    assert got == [("mit", "Released -- under the MIT Licence", 1), ("cc-by-nc", "Licensed under CC BY-NC 4.0", 0)]


def test_repeated_parts_take_linear_time():
    import time

    scanner = notices.Scanner(notices.Rules())
    began = time.process_time()
    assert notices.scan_row(b"license the licensed under " * 40_000, scanner)[0] == 160_000
    assert time.process_time() - began < 20


def test_odd_tables(spark):
    rows = notices.scan_notices(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert by_id[i][1:] == (0, 0, None, None, "", "", 0.0, "")
    for i, text in enumerate(x[1] for x in odd_rows()[:19]):
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(text)
    assert notices.scan_notices(none(spark)).count() == 0
