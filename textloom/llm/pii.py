"""Personal data in whole texts (9): fixed patterns, and a linear-chain conditional random field beside them.

The patterns find e-mail addresses, IP addresses, card and phone numbers; their spans always
stay. The field labels the words of every line that can hold a span: one with a digit, an @,
an `at` or `dot` between marks, a `dot` between spaces, or an `at` between spaces before a name with a dot.
The check of a span accepts nothing without one of these, so no other line is
decoded; it asks for what a span of the kind cannot lack (the parts of an address, a card's Luhn sum, a phone's
count of digits), whatever marks stand between, and the field decides the rest. The features are of word shape, also with all marks alike, of
the run of numbers that a word is in, and of the words around. It is
trained on the driver from a small labelled table, made here by rule, and decoded by
Viterbi in numpy batches. Neighbours of one label are one span if it passes the check, else they are
split into pieces that pass and cover the most words. Spans are added where they touch no pattern's span.

Bounds of the field, which the patterns do not have: features are made of a word's first 64 characters, of runs of up to 12 numbers and their first 8
groups, and of up to 4 spelled marks a word; an added span has at most `_LONGEST` characters, so that the work is linear in a line.

Offsets are code points, ends exclusive. Defined results: null text is empty, an empty
text has no spans; rows that repeat are each treated; an empty table gives an empty
result; `redact` keeps all columns and only changes text and n_chars.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks, strings, text_of, with_text
from .crf import train, viterbi

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start. For each @ the address begins where its run of local characters does, which is the leftmost match."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(g := x.lstrip("0")) <= 3 and int(g or 0) <= 255 for x in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# The field: words, features, training table.

LABELS = ("", *KINDS)
BUCKETS = 1 << 14
#: An @ or a dot as it may be written: itself or spelled out, between any marks; a bare word stands between spaces.
_MARK = r"[^A-Za-z0-9\x20\x09-\x0D]"
_AT = rf"(?:\x20?{_MARK}?@{_MARK}?\x20?|\x20?{_MARK}at{_MARK}\x20?|\x20at\x20)"
_DOT = rf"(?:\x20?{_MARK}?\.{_MARK}?\x20?|\x20?{_MARK}dot{_MARK}\x20?|\x20dot\x20)"
_NAME, _LABEL = r"[a-z0-9](?:[a-z0-9._%+-]{0,62}[a-z0-9])?", r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_AT_WHOLE = re.compile(_AT)
_ADDRESS = re.compile(rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_HEX = re.compile(r"[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){2,7}")
_QUAD = re.compile(rf"([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}})")
#: What every span that _sane accepts holds.
_EVIDENCE = re.compile(rf"[0-9@]|\x20dot\x20|{_MARK}(?:dot|at){_MARK}|\x20at\x20[a-z0-9-]++\x20?{_MARK}?\.{_MARK}?\x20?[a-z0-9]", re.IGNORECASE)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPELLED = re.compile(rf"{_MARK}(at|dot|@|\.){_MARK}")
_LEAD = re.compile(r"[A-Za-z]+[.:=#]+(?=[0-9(+])")
_CUES = frozenset("at dot (at) [at] {at} (dot) [dot] {dot} phone tel telephone mobile cell fax call contact email e-mail mail card visa credit debit ip host server address number no. ref order invoice version isbn total page year chapter since until eur usd id".split())


def shape(word: str) -> str:
    """Upper-case letters as X, lower-case as x, digits as 9; a run of letters once, a run of digits with its length up to 5."""
    out: list[str] = []
    run = 0
    for c in word[:64]:
        k = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if out and out[-1][0] == k and k in "Xx9":
            run += 1
            if k == "9":
                out[-1] = f"9{min(run, 5)}"
        else:
            run = 1
            out.append("91" if k == "9" else k)
    return "".join(out)


def general(word: str) -> str:
    """The shape with every mark alike, so that a number between marks never seen is like one between others."""
    return "".join(c if c.isalnum() else "_" for c in shape(word))


def _numeric(word: str) -> bool:
    return any("0" <= c <= "9" for c in word) and not any(c.isalpha() for c in word)


def _runs(words: list[str]) -> list[list[str]]:
    """Features of the run of numbers that a word is in: its groups, digits, and whether they pass Luhn's check."""
    out: list[list[str]] = [[] for _ in words]
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and j - i < 12 and (_numeric(words[j]) or j > i and j + 1 < len(words) and len(words[j]) == 1 and not words[j].isalnum() and _numeric(words[j + 1])):
            j += 1
        if j > i:
            groups = [_digits(w[:64]) for w in words[i:j]]
            digits = "".join(groups)
            said = [f"rd:{min(len(digits), 24)}", "rg:" + "-".join(str(min(len(g), 8)) for g in groups[:8] if g)]
            if 13 <= len(digits) <= 19:
                said.append(f"rl:{luhn(digits)}")
            out[i:j] = [said] * (j - i)
        i = max(j, i + 1)
    return out


def _own(word: str) -> list[str]:
    digits, low = _digits(word[:64]), word[:64].lower()
    bare = low.strip(".,;:!?")
    out = [
        f"s:{shape(word)}", f"g:{general(word)}", f"d:{min(len(digits), 20)}", f"l:{min(len(word), 20) // 2}",
        f"@:{'@' in word}", f"dots:{min(word.count('.'), 4)}", f"colons:{min(word.count(':'), 4)}"
    ]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if bare in _CUES:
        out.append(f"w:{bare}")
    if len(low) > 5 and (spelled := _SPELLED.findall(low)):
        out += [f"in:{x}" for x in spelled[:4]]
    if (only := low.strip("()[]{}<>*-_|/#~=\"'")) in ("at", "dot", "@", "."):
        out.append(f"is:{only}:{only != low}")
    return out


def _features(words: list[str]) -> list[np.ndarray]:
    """Hashed features of each word of a line: its own, the shapes of the two words on either side, and cues among them."""
    own = [_own(w) for w in words]
    brief = [x[1] + "".join(y for y in x if y[:2] in ("w:", "is")) for x in own]
    runs = _runs(words)
    out = []
    for i, parts in enumerate(own):
        parts = parts + runs[i]
        near = [f"{k}:{brief[i + k] if 0 <= i + k < len(words) else '-'}" for k in (-2, -1, 1, 2)]
        both = [f"{parts[0]}|{near[1]}", f"{parts[0]}|{near[2]}"]
        out.append(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (*parts, *near, *both)]))
    return out


def training_table(n: int = 2400, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Labelled lines: personal data as written and as disguised, and numbers that are none."""
    r = random.Random(seed)
    syllables = "an er the tion ou la qu ch ei ver sch ado ción el mi ra den ti".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def filler() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return (w.capitalize() if r.random() < 0.15 else w) + r.choice(["", "", "", "", ",", "."])

    def name() -> str:
        return "".join(r.choice(syllables) for _ in range(2)) + r.choice(["", "", ".x", f"{r.randint(1, 99)}", f".{digits(2)}"])

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([14, 14, 14, 15, 17]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fours(x: str, by: str) -> str:
        return by.join(x[i : i + 4] for i in range(0, len(x), 4))

    def private() -> tuple[str, int]:
        kind = r.choice([1, 1, 2, 3, 4, 4, 4])
        host = r.choice(syllables) + r.choice(syllables)
        if kind == 1:
            a, d = r.choice([
                ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" @ ", "."),
                ("(@)", "(.)"), ("*at*", "*dot*")
            ])
            if r.random() < 0.7:
                a = r.choice([" at ", " at ", " (at) ", " [at] ", " {at} ", "(at)", "[at]", "{at}", " *at* ", "(@)"])
                d = r.choice([".", ".", " dot ", " dot ", "(dot)", "[dot]", "{dot}", " (dot) ", " {dot} ", "*dot*", "(.)", " . "])
                if r.random() < 0.25:
                    a, d = a.upper(), d.upper()
            return f"{name()}{a}{host}{d}{r.choice(['com', 'org', 'net', 'de', 'example'])}", 1
        if kind == 2:
            six = ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
            four = r.choice([".", ".", "(.)", " dot "]).join(str(r.randint(0, 255)) for _ in range(4))
            short = "::".join(":".join(f"{r.randint(1, 65535):x}" for _ in range(r.randint(1, 3))) for _ in range(2))
            return r.choice([four, six, short]), 2
        if kind == 3:
            return fours(card(), r.choice(["", " ", "-", ".", ":", " . "])), 3
        a, b, c = digits(3), digits(3), digits(4)
        if r.random() < 0.5:
            by = r.choice([" ", "-", ".", "/", ""])
            front = r.choice(["", "", "0", f"+{digits(2)} ", f"00{digits(2)} ", f"+{digits(1)}-", f"({a}) ", f"({a})"])
            rest = r.choice([
                f"{a}{by or '-'}{b}{r.choice(['-', ' ', ''])}{c}", f"{digits(4)}{by or ' '}{digits(6)}",
                f"{digits(2)}{by or ' '}{digits(3)}{by or ' '}{digits(4)}",
                f"{b}{by or '-'}{c}" if front[:1] == "(" else f"{a}{by or ' '}{digits(7)}"
            ])
            return f"{r.choice(['', '', '', 'tel:', 'fax:'])}{front}{rest}", 4
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"00{digits(2)} {a} {b} {c}"]), 4

    def number() -> str:
        wrong = card()
        wrong = wrong[:-1] + str((int(wrong[-1]) + 3) % 10)
        return r.choice([
            str(r.randint(1, 2100)), f"{digits(2)}.{digits(2)}.{r.randint(1900, 2030)}",
            f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}",
            f"${digits(3)}.{digits(2)}", f"{digits(3)},{digits(3)}", wrong, fours(wrong, " "), digits(r.randint(5, 13)),
            f"AKIA{digits(4)}XQ{digits(6)}", f"password={''.join(r.choice('0123456789abcdef') for _ in range(16))}",
            "978-" + digits(1) + "-" + digits(4) + "-" + digits(4) + "-" + digits(1), f"{filler()} at {filler()}",
            f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)} {digits(4)}", f"dot {filler()}", f"{digits(3)}-{digits(3)}",
            f"{filler()} at {filler()} dot {filler()}" if r.random() < 0.3 else f"a dot {filler()}",
            f"{filler()} at {filler()} . {filler()}", f"{digits(3)} {digits(3)}", f"{digits(2)}.{digits(6)}",
            f"{digits(2)}.{digits(5)}, {digits(1)}.{digits(5)}", f"{digits(4)}/{digits(2)}/{digits(2)}",
            f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(4)}-{digits(4)}",
            f"{digits(2)} {digits(2)} {digits(2)}",
            f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(1)}{r.choice(['a', 'rc', 'b'])}{digits(1)}",
            "".join(r.choice("0123456789abcdef") for _ in range(40)), f"#{digits(9)}",
            f"{r.choice(['id', 'no', 'ref'])}:{digits(8)}"
        ])

    lines = []
    for _ in range(n):
        line: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 3)):
            line += [(filler(), 0) for _ in range(r.randint(0, 6))]
            if r.random() < 0.2:
                line.append((r.choice(["phone", "tel", "call", "email", "card", "server", "order", "page", "year"]) + r.choice(["", ":"]), 0))
            text, kind = private() if r.random() < 0.5 else (number(), 0)
            line += [(w, kind) for w in (text + r.choice(["", "", "", ".", ","])).split()]
            line.append((filler(), 0))
        lines.append(line)
    return lines


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    lines = training_table()
    features = [f for line in lines for f in _features([w for w, _ in line])]
    weights, trans = train(features, np.array([k for line in lines for _, k in line]), np.array([len(x) for x in lines]), BUCKETS, len(LABELS), epochs=12)
    return weights.astype(np.float32), trans.astype(np.float32)


def _sane(kind: str, text: str) -> bool:
    """An exact check of a labelled span."""
    d, low = _digits(text), text.lower()
    if kind == "email":
        return bool(_ADDRESS.fullmatch(low))
    if kind == "ip":
        if low.count(".") + low.count("dot") != 3 and ":" not in low:
            return False
        if four := _QUAD.fullmatch(low):
            return all(int(x) <= 255 for x in four.groups())
        return bool(_HEX.fullmatch(low)) and len(d) >= 2 and ("::" in low or low.count(":") == 7)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not any(c.isalpha() for c in text) and len(text) <= 3 * len(d)
    return 9 <= len(d) <= 15 and len(text) <= 4 * len(d) and not re.search(r"[^0-9 ().+/-]", text) and bool(re.search(r"[ ().+/-]", text))


#: No span that passes is longer: an address of e-mail by choice, three digits four times and three dots of seven characters each or
#: 32 hex digits and 7 colons, a mark on either side of each of 19 digits, and the like for 15.
_LONGEST = {"email": 200, "ip": 48, "card": 57, "phone": 60}
#: What the first word of a span, and what is added to it, may hold; once this fails, more words do not help.
_BEGINS = {"email": re.compile(r"[^\n]*"), "card": re.compile(r"[^A-Za-z]*"), "phone": re.compile(r"\(*\+?[0-9 ()./-]*"), "ip": re.compile(r"[0-9A-Fa-f.:\[\](){}*<> dotDOT-]*")}
_GOES_ON = _BEGINS | {"phone": re.compile(r"[0-9 ()./-]*")}
#: Digits of a span that passes.
_FEWEST, _MOST = {"email": 0, "card": 13, "phone": 9, "ip": 2}, {"email": 200, "card": 19, "phone": 15, "ip": 32}
_EDGE = 1 + max(_LONGEST.values()) // 2
_AT_ALL, _HEX_DIGITS = re.compile("@|at", re.IGNORECASE), frozenset("0123456789abcdefABCDEF")


def _pieces(kind: str, text: str, words: list[re.Match]) -> list[tuple[int, int]]:
    """The spans in a run of words of one label: the whole run if it passes the check, else the pieces that cover
    the most words; of such splits the one with the fewest pieces, then with the most even ones."""

    def ends(i: int, j: int) -> tuple[int, int]:
        start, end = words[i].start(), words[j - 1].end()
        if kind != "email" and (lead := _LEAD.match(text, start, end)):
            start = lead.end()
        while end > start and text[end - 1] in ".,;:!?":
            end -= 1
        return start, end

    start, end = ends(0, len(words))
    if _sane(kind, text[start:end]):
        return [(start, end)]
    n = len(words)
    digits = [0, *itertools.accumulate(len(_digits(w[0])) for w in words)]
    # a span of e-mail has an @ or an "at" near its beginning
    ats = [m.start() for m in _AT_ALL.finditer(text, words[0].start(), words[-1].end())] if kind == "email" else []
    best = [(0, 0, 0)] * (n + 1)
    came = [-1] * (n + 1)  # where the piece that ends here begins; -1: no piece ends here
    for i in range(n):
        covered, pieces, uneven = best[i]
        if best[i] > best[i + 1]:
            best[i + 1], came[i + 1] = best[i], -1
        first = ends(i, i + 1)[0]
        if kind == "email":
            near = bisect.bisect_left(ats, first)
            if near == len(ats) or ats[near] > first + _LONGEST[kind]:
                continue
        elif kind == "ip" and text[first] not in _HEX_DIGITS or kind != "email" and digits[i + 1] == digits[i] and kind != "ip":
            continue
        at, may = first, _BEGINS[kind]
        for j in range(i + 1, n + 1):
            held = digits[j] - digits[i]
            if held > _MOST[kind] or words[j - 1].start() > first + _LONGEST[kind]:
                break
            score = (covered + j - i, pieces - 1, uneven - (j - i) ** 2)
            if held >= _FEWEST[kind] and score > best[j]:
                start, end = ends(i, j)
                if not (kind == "phone" and "+" in text[start:end].lstrip("(")[1:]) and _sane(kind, text[start:end]):
                    best[j], came[j] = score, i
            if not may.fullmatch(text, at, words[j - 1].end()) or kind == "email" and len(_AT_WHOLE.findall(text[first : words[j - 1].end()].lower() + " ")) > 1:
                break
            at, may = words[j - 1].end(), _GOES_ON[kind]
    out = []
    while n:
        if came[n] >= 0:
            out.append(ends(came[n], n))
        n = came[n] if came[n] >= 0 else n - 1
    return out[::-1]


def method_spans(texts: list[str], weights: np.ndarray, trans: np.ndarray, batch_words: int = 50_000) -> list[list[Span]]:
    """The field's spans of each text; lines of many texts are decoded together."""
    out: list[list[Span]] = [[] for _ in texts]
    lines: list[tuple[int, list[re.Match]]] = []
    held = 0

    def decode() -> None:
        if not lines:
            return
        features = [f for _, words in lines for f in _features([m[0] for m in words])]
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        scores = np.add.reduceat(weights[np.concatenate(features)], np.cumsum(sizes) - sizes, axis=0)
        lengths = np.array([len(w) for _, w in lines], np.int64)
        labels = viterbi(scores, lengths, trans).tolist()
        at = 0
        for which, words in lines:
            own = labels[at : at + len(words)]
            at += len(words)
            i = 0
            while i < len(own):
                j = i + 1
                while own[i] and j < len(own) and own[j] == own[i]:
                    j += 1
                if own[i]:
                    kind = LABELS[own[i]]
                    found = _pieces(kind, texts[which], words[i:j])
                    # the field may miss the first or the last word of an item
                    more = ((i, j + 1), (i - 1, j), (i - 1, j + 1))
                    while not found and more:
                        (a, b), more = more[0], more[1:]
                        if a >= 0 and b <= len(own):
                            # only spans at an end count, and no span is longer than so many words
                            ends = [words[a:b]] if b - a <= 2 * _EDGE else [words[a : a + _EDGE], words[b - _EDGE : b]]
                            found = [s for x in ends for s in _pieces(kind, texts[which], x) if s[0] <= words[i].start() or s[1] > words[j - 1].start()]
                    out[which] += [(kind, a, b) for a, b in found]
                i = j
        lines.clear()

    for which, text in enumerate(texts):
        done = 0
        for m in _EVIDENCE.finditer(text):
            if m.start() < done:
                continue
            start = text.rfind("\n", 0, m.start()) + 1
            done = text.find("\n", m.start())
            done = len(text) if done < 0 else done
            words = list(_WORD.finditer(text, start, done))
            if words:
                lines.append((which, words))
                held += len(words)
            if held >= batch_words:
                decode()
                held = 0
    decode()
    return out


def find_spans(texts: list[str], weights: np.ndarray, trans: np.ndarray) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans of each text, and all spans by kind, then start."""
    base = [base_spans(t) for t in texts]
    every = []
    for own, added in zip(base, method_spans(texts, weights, trans), strict=True):
        extra = [s for s in added if all(s[2] <= b[1] or b[2] <= s[1] for b in own)]
        every.append(sorted({*own, *extra}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return base, every


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: patterns' spans by kind as counts and in writing, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, every = find_spans(strings(batch.column("text")), *sent.value)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(map(written, base), pa.string()), pa.array(map(written, every), pa.string())],
                [x.split()[0] for x in SCHEMA.split(", ")]
            )

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "text", make, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with a mark for each span; spans that overlap get the mark of the one that begins first, the longer of two."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span masked; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column("text"))
            _, every = find_spans([t or "" for t in texts], *sent.value)
            return with_text(batch, pa.array([t and masked(t, s) for t, s in zip(texts, every, strict=True)], pa.string()))

        return work

    return map_chunks(docs, "text", make, docs.schema)
