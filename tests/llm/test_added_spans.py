"""The spans that the field adds to the patterns', against a plain decoding of each line and all ways to split a run of words."""

import re

import numpy as np

from textloom.llm import pii

from .common import docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels_by_hand(scores, trans):
    """The best labels, word by word; of equal ones the smaller."""
    best, came = scores[0].astype(float), []
    for row in scores[1:]:
        options = best[:, None] + trans
        came.append(options.argmax(0))
        best = options.max(0) + row
    out = [int(best.argmax())]
    for back in reversed(came):
        out.append(int(back[out[-1]]))
    return out[::-1]


def bounds(kind, text, words, i, j):
    start, end = words[i].start(), words[j - 1].end()
    if kind != "email" and (lead := pii._LEAD.match(text, start, end)):
        start = lead.end()
    while end > start and text[end - 1] in ".,;:!?":
        end -= 1
    return start, end


def fits(kind, piece):
    return len(piece) <= pii._LONGEST[kind] and not (kind == "phone" and "+" in piece.lstrip("(")[1:]) and pii._sane(kind, piece)


def splits(kind, text, words):
    """All splits of a run that have the best score (words covered, then few pieces, then even ones)."""
    n = len(words)
    if pii._sane(kind, text[slice(*bounds(kind, text, words, 0, n))]):
        return [[bounds(kind, text, words, 0, n)]]
    at = {n: (0, 0, 0, [[]])}
    for i in range(n - 1, -1, -1):
        options = [at[i + 1]]
        for j in range(i + 1, n + 1):
            a, b = bounds(kind, text, words, i, j)
            if fits(kind, text[a:b]):
                covered, pieces, even, ways = at[j]
                options.append((covered + j - i, pieces - 1, even - (j - i) ** 2, [[(a, b), *w] for w in ways]))
        top = max(o[:3] for o in options)
        at[i] = (*top, [w for o in options if o[:3] == top for w in o[3]])
    return at[0][3]


def added_by_hand(text, weights, trans):
    """For each run of one label of each line: the splits it may have."""
    out, at = [], 0
    for line in text.split("\n"):
        words = list(WORD.finditer(text, at, at + len(line)))
        at += len(line) + 1
        if not words:
            continue
        scores = np.array([weights[f].sum(0) for f in pii._features([w[0] for w in words])])
        own, i = labels_by_hand(scores, trans.astype(float)), 0
        while i < len(own):
            j = i + 1
            while own[i] and j < len(own) and own[j] == own[i]:
                j += 1
            if own[i]:
                kind = pii.LABELS[own[i]]
                ways = splits(kind, text, words[i:j])
                for a, b in ((i, j + 1), (i - 1, j), (i - 1, j + 1)):
                    if not any(ways) and a >= 0 and b <= len(own):
                        ways = [[s for s in w if s[0] <= words[i].start() or s[1] > words[j - 1].start()] for w in splits(kind, text, words[a:b])]
                out.append([[(kind, *s) for s in w] for w in ways])
            i = j
    return out


def check(texts):
    weights, trans = pii.model()
    base, every = pii.find_spans(texts, weights, trans)
    added = 0
    for text, own, found in zip(texts, base, every, strict=True):
        if len(text) > 20_000:
            continue
        free = lambda s: all(s[2] <= b[1] or b[2] <= s[1] for b in own)  # noqa: E731, B023
        got, may = set(found) - set(own), added_by_hand(text, weights, trans)
        # each run has one of its best splits, and nothing is there beside them
        assert all(any({s for s in way if free(s)} <= got for way in ways) for ways in may), text[:200]
        assert got <= {s for ways in may for way in ways for s in way}, (text[:200], got)
        added += len(got)
    return added


def test_lines_of_disguised_items():
    lines = [" ".join(w for w, _ in line) for line in pii.training_table(500, seed=5)]
    assert check(lines) > 100


def test_documents(spark):
    check([r.text or "" for r in docs(spark).collect()] + [r[1] or "" for r in odd_rows()])


def test_runs_of_many_items():
    lines = ["5 " * 40, "1 . 2 . 3 . 4 " * 6, "030 1234567 " * 5, "x at y dot z " * 5, "4111 1111 1111 1111 " * 3, "+49 30 123456 +49 30 654321 ", ". " * 30, "(5) " * 20]
    check(lines)
