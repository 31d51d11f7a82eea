"""Personal data: fixed base rules, and a semi-Markov conditional random field.

The base rules find e-mail addresses, IP addresses, card and phone numbers by
pattern and check digits. The random field looks at the places they leave
open: whole-span features (shape, digit count, check digits, octets, spelled-out
address, cue word, separators) score every candidate segment of a stretch of
tokens, and dynamic programming over segments of at most ``max_len`` tokens
chooses boundaries and kinds together; base spans are fixed segments of that
choice. A chosen segment is added if its marginal probability reaches
``min_probability``. So it finds what the base rules miss by their form:
addresses with ``(at)`` and ``dot``, octets and card digits with other
separators, phone numbers without a plus, and numbers that the base rules drop
because they read them together with their neighbours. Features describe how a
span is built, and training forms are drawn at random (words, hosts, digits,
groups, brackets, separators), so that what is learned isn't the table's own
values; ISBNs, order and serial numbers, dates and coordinates are learned as
no personal data.

Training (``fit``) is from rows without labels. Base spans in a bounded sample
of windows (``max_windows`` out of ``sample_docs`` documents, drawn by hash)
are the known personal data; a quarter of the windows hold none, where there are
as many. Each window is learned as it is, with its span
rewritten into other forms (``rewrites``), next to another number, and with
something harmless in its place (``harmless``: dates, versions, prices, numbers
that fail the check digit), which is learned as no span. Windows over
``train_chars`` characters teach nothing.

A stretch holds the tokens with a digit, an ``@`` or a spelled-out dot that are
at most ``gap`` tokens apart, and ``context`` tokens on either side; it is read
as one, however long it is.

Edge cases: null texts are empty; a text without digit, ``@`` and spelled-out
address has no span; repeated rows each get their own result; equal scores keep
the shorter segment and the kind listed first; without a base span in the
sample the field adds nothing. Whole texts, tokens and segments are read, in time
linear in their length. Personal data of more than ``max_len`` tokens, and
addresses that are spelled out with ``at`` alone beside a written host (as in
"write to anna at example.com"), are not found.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permitlake.llm.common import carry

#: The kinds in their order of listing.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Looking behind for a digit keeps the leftmost
#: matches and makes a long run of digits cost linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Spelled-out signs of an address: the word between brackets or strokes of any kind, or alone.
_OPEN, _CLOSE = r"[\[({<_|*~:-]+", r"[\])}>_|*~:-]+"
SPELLED = re.compile(rf"{_OPEN}\s?(?:at|dot|@|\.)\s?{_CLOSE}", re.IGNORECASE)
AT = re.compile(rf"\s*(?:{_OPEN}\s?(?:at|@)\s?{_CLOSE}|(?<=\s)at(?=\s)|@)\s*")
DOT = re.compile(rf"\s*(?:{_OPEN}\s?(?:dot|\.)\s?{_CLOSE}|(?<=\s)dot(?=\s)|(?<=\s)\.(?=\s))\s*")
ADDRESS = re.compile(r"([a-z0-9._%+-]+)@([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6})")
GROUP = re.compile(r"[0-9]+")

Span = tuple[int, int, str]


@dataclass(frozen=True)
class Params:
    sample_docs: int = 20_000  #: documents at most that training windows come from
    max_windows: int = 400  #: training windows at most
    train_chars: int = 2_000  #: longer windows are not learned from
    epochs: int = 5
    max_len: int = 9  #: tokens of a segment at most
    gap: int = 2
    context: int = 4
    min_probability: float = 0.9


@dataclass(frozen=True)
class Model:
    index: dict[str, int]  #: feature to its row
    weights: np.ndarray  #: a row for each feature, a column for no span and for each kind
    params: Params


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by start and then by kind as listed."""
    found: list[tuple[int, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        head = text[last:at]
        start = last + len(head.rstrip(LOCAL))
        last = at + 1  # no local part goes beyond an earlier sign
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", last)
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


@dataclass
class Stretch:
    """Tokens (start, end) around seeds, and which of them base spans cover."""

    tokens: list[tuple[int, int]]
    seeds: list[bool]
    fixed: list[bool]


def _spelled(text: str) -> bool:
    return " dot " in text.lower() or SPELLED.search(text) is not None


def _seeds(text: str, tokens: list[tuple[int, int]], spelled: bool) -> list[bool]:
    out = [SEED.search(text, a, b) is not None or (spelled and text[a:b].lower() == "dot") for a, b in tokens]
    k = 0
    for m in SPELLED.finditer(text) if spelled else ():
        while tokens[k][1] <= m.start():
            k += 1
        j = k
        while j < len(tokens) and tokens[j][0] < m.end():
            out[j] = True
            j += 1
    return out


def stretches(text: str, spans: list[Span], p: Params) -> Iterator[Stretch]:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    seeds = _seeds(text, tokens, _spelled(text))
    groups: list[tuple[int, int]] = []
    for i in (i for i, s in enumerate(seeds) if s):
        if groups and i - groups[-1][1] <= p.gap + 1:
            groups[-1] = (groups[-1][0], i)
        else:
            groups.append((i, i))
    fixed, k = [False] * len(tokens), 0
    for a, b, _ in sorted(spans):
        while k < len(tokens) and tokens[k][1] <= a:
            k += 1
        j = k
        while j < len(tokens) and tokens[j][0] < b:
            fixed[j] = True
            j += 1
    for first, last in groups:
        own = slice(max(0, first - p.context), last + 1 + p.context)
        yield Stretch(tokens[own], seeds[own], fixed[own])


def surface(text: str, a: int, b: int) -> tuple[int, int]:
    """A segment's span without the punctuation around it."""
    s = text[a:b]
    kept = s.rstrip(".,;:!?\"'>*#$&%|" + ("" if "(" in s else ")") + ("" if "[" in s else "]") + ("" if "{" in s else "}"))
    b = a + len(kept)
    kept = kept.lstrip("\"'<*#$&%|" + ("" if ")" in s else "(") + ("" if "]" in s else "[") + ("" if "}" in s else "{"))
    return b - len(kept), b


def _isbn(d: str) -> bool:
    """A book number: 13 digits after 978 or 979 with their check digit, or 10 with theirs."""
    if len(d) == 13:
        return d[:2] == "97" and d[2] in "89" and sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(d)) % 10 == 0
    return len(d) == 10 and sum((10 - i) * int(c) for i, c in enumerate(d)) % 11 == 0


def features(s: str, n: int, before: str) -> list[str]:
    """Whole-span features of s, a segment of n tokens after a word.

    They say how a span is built (groups of digits, kinds of separators, what it
    begins with, checks that it passes), never which letters or digits it holds.
    """
    plain = DOT.sub(".", AT.sub("@", s.lower()))
    letters = any(map(str.isalpha, s))
    out = ["bias", f"tokens={n}", f"before={before}", f"letters={letters}"]
    if letters:
        m = ADDRESS.fullmatch(plain)
        out += [f"address={m is not None}", f"at={min(2, plain.count('@'))}", f"address={m is not None}{n}"]
        if m:
            labels = m[2].split(".")
            out += [f"labels={min(4, len(labels))}", f"end={len(labels[-1])}", f"numbers={any(map(str.isdecimal, labels))}"]
    groups = [(m.start(), m.end()) for m in GROUP.finditer(s)]
    digits = "".join(s[a:b] for a, b in groups)
    if not digits:
        return [*out, f"word={letters and m is not None}"]
    inner = {re.sub(r"\s+", " ", s[b:c]) for (_, b), (c, _) in zip(groups, groups[1:], strict=False)}
    bare = {"".join(c for c in x if not c.isspace()) or " " for x in inner}  # the separators without white space around them
    same = len(bare) <= 1
    octets = plain.split(".") if letters or "." in plain else [s[a:b] for a, b in groups]
    octets = len(octets) == 4 and same and bare != {" "} and all(o.isdecimal() and o.isascii() and len(o) <= 3 and int(o) <= 255 for o in octets)
    sizes = "-".join(str(min(b - a, 9)) for a, b in groups) if len(groups) <= 6 else "many"
    edge = (s[: groups[0][0]].strip() or "none") + ("," + s[groups[-1][1] :].strip() if s[groups[-1][1] :].strip() else "")
    edge = edge if len(edge) <= 4 and not letters else "long"
    lead = "00" if digits[:2] == "00" else "0" if digits[0] == "0" else "1" if sizes[:2] == "1-" and digits[0] == "1" else "d"
    card = 12 <= len(digits) <= 19 and not letters and edge == "none"
    luhn, phone, isbn = card and _luhn(digits), not letters and 9 <= len(digits) <= 15, not letters and _isbn(digits)
    parts = min(len(groups), 6)
    return [
        *out,
        f"digits={min(20, len(digits))}{letters}",
        f"sizes={sizes}{letters}",
        f"edge={edge}",
        f"same={same}{parts}{letters}",
        f"octets={octets}",
        f"octets={octets}{letters}{n}",
        f"card={card}{luhn}",
        f"card={card}{luhn}{isbn}{same}",
        f"isbn={isbn}",
        f"phone={phone}{lead}{edge}",
        f"phone={phone}{lead}{edge}{sizes}",
        f"phone={phone}{lead}{parts}{isbn}{luhn}",
        *(f"between={x}{letters}" for x in sorted(bare) if len(x) <= 3),
    ]


def lattice(text: str, w: Stretch, p: Params) -> list[tuple[int, int, tuple[int, int], bool, list[str]]]:
    """Candidate segments (first token, after last, span, may be an entity, features)."""
    out = []
    for i, (start, _) in enumerate(w.tokens):
        before = text[w.tokens[i - 1][0] : w.tokens[i - 1][1]].lower().strip(".,:;") if i else ""
        before = re.sub("[0-9]", "0", before)
        for j in range(i + 1, min(len(w.tokens), i + p.max_len) + 1):
            if any(w.fixed[i:j]):
                if j == i + 1:
                    out.append((i, j, w.tokens[i], False, ["plain"]))
                break
            entity = any(w.seeds[i:j])
            if j > i + 1 and not entity:
                continue
            a, b = surface(text, start, w.tokens[j - 1][1])
            entity = entity and b > a
            out.append((i, j, (a, b), entity, features(text[a:b], j - i, before) if entity else ["plain"]))
    return out


@dataclass
class Chart:
    """A stretch's candidate segments in arrays; feats holds feature rows, -1 for none."""

    first: np.ndarray
    after: np.ndarray
    allowed: np.ndarray  #: which labels a segment may have
    feats: np.ndarray
    spans: list[tuple[int, int]]
    n: int


def _chart(edges: list, n: int, row) -> Chart:  # noqa: ANN001
    width = max((len(e[4]) for e in edges), default=1)
    feats = np.full((len(edges), width), -1)
    for k, e in enumerate(edges):
        own = [row(f) for f in e[4]]
        feats[k, : len(own)] = own
    first, after = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)
    entity = np.array([e[3] for e in edges], bool)
    allowed = np.concatenate([(after - first == 1)[:, None], np.repeat(entity[:, None], len(KINDS), axis=1)], axis=1)
    return Chart(first, after, allowed, feats, [e[2] for e in edges], n)


def _more(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _scores(c: Chart, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of every (segment, label), and its marginal probability."""
    known = np.concatenate([weights, np.zeros((1, weights.shape[1]))])[c.feats].sum(axis=1)
    scores = np.where(c.allowed, known, -np.inf)
    top = scores.max(axis=1)
    total = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    left, right = [-math.inf] * (c.n + 1), [-math.inf] * (c.n + 1)
    left[0] = right[c.n] = 0.0
    edges = list(zip(c.first.tolist(), c.after.tolist(), total.tolist(), strict=True))  # by first token
    for i, j, s in edges:
        left[j] = _more(left[j], left[i] + s)
    for i, j, s in reversed(edges):
        right[i] = _more(right[i], right[j] + s)
    log_p = np.array(left)[c.first][:, None] + scores + np.array(right)[c.after][:, None] - left[c.n]
    return scores, np.exp(np.minimum(log_p, 0.0))


def decode(text: str, w: Stretch, model: Model) -> list[Span]:
    """The entities of the best segmentation whose marginal probability is high enough."""
    c = _chart(lattice(text, w, model.params), len(w.tokens), lambda f: model.index.get(f, -1))
    scores, probability = _scores(c, model.weights)
    label, value = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
    best: list[tuple[float, int]] = [(0.0, -1)] + [(-math.inf, -1)] * c.n
    ends: list[list[int]] = [[] for _ in range(c.n + 1)]
    for k, j in enumerate(c.after.tolist()):
        ends[j].append(k)
    for j in range(1, c.n + 1):
        for k in reversed(ends[j]):  # the shorter segment first
            if (s := best[c.first[k]][0] + value[k]) > best[j][0]:
                best[j] = (s, k)
    out, j = [], c.n
    while j > 0 and (k := best[j][1]) >= 0:
        if label[k] and probability[k, label[k]] >= model.params.min_probability:
            out.append((*c.spans[k], KINDS[label[k] - 1]))
        j = int(c.first[k])
    return out


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, of a text."""
    if not text or not (SEED.search(text) or _spelled(text)):
        return [], []
    base = base_spans(text)
    more: list[Span] = []
    if model.index:
        for w in stretches(text, base, model.params):
            if any(s and not f for s, f in zip(w.seeds, w.fixed, strict=True)):
                more += decode(text, w, model)
    if not more:
        return base, base
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Brackets and strokes that signs and separators are written with.
_PAIRS = ("()", "[]", "{}", "<>", "__", "||", "**", "--", "~~")


def _word(r: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, most)))


def _run(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _sign(r: random.Random, word: str, alone: bool) -> str:
    """A spelled-out at or dot."""
    word = word.upper() if r.random() < 0.2 else word
    if alone and r.random() < 0.4:
        return f" {word} "
    pair, inside, around = r.choice(_PAIRS), r.choice(["", "", " "]), r.choice(["", " "])
    return around + pair[0] + inside + word + inside + pair[1] + around


def _address(r: random.Random) -> str:
    """An address in a form that the base rules don't know; its words are made of random letters."""
    local = _word(r)
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        local += r.choice(["", ".", "_", "-", "+"]) + r.choice([_word(r, 1, 6), _run(r, r.randint(1, 4))])
    labels = [_word(r) + r.choice(["", "", "", _run(r, r.randint(1, 3))]) for _ in range(r.choice([1, 1, 1, 2]))] + [_word(r, 2, 4)]
    dot = r.choice([".", ".", _sign(r, "dot", True), " dot ", _sign(r, r.choice(["dot", "."]), False)])
    dots = [dot] * (len(labels) - 1)
    if len(dots) > 1 and r.random() < 0.3:
        dots[0] = "."
    at = r.choice([" at ", " at ", _sign(r, "at", True), _sign(r, r.choice(["at", "@"]), False), " @ "]) if "dot" in dot.lower() else r.choice([_sign(r, "at", False), _sign(r, "at", False), " @ "])
    return local + at + "".join(x + y for x, y in zip(labels, [*dots, ""], strict=True))


def _between(r: random.Random, plain: str) -> str:
    """What separates groups of digits: a sign, in brackets or white space or neither."""
    sign = r.choice(plain)
    form = r.random()
    return f" {sign} " if form < 0.2 else (p := r.choice(_PAIRS[:4]))[0] + sign + p[1] if form < 0.35 else sign


def _cut(r: random.Random, digits: str, sizes: list[int]) -> list[str]:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return [x for x in [*out, digits[at:]] if x]


def rewrites(kind: str, s: str, r: random.Random) -> str:
    """Personal data of a kind, of random content, in a form that the base rules don't know."""
    if kind == "email":
        return _address(r)
    if kind == "ip":
        most = r.choice([(255,), (9, 99, 255), (9, 19)])
        return r.choice([_between(r, ".-,_:;|/"), _sign(r, "dot", True), _between(r, ".")]).join(str(r.randint(0, r.choice(most))) for _ in range(4))
    if kind == "card":
        n = r.choice([16, 16, 16, 15, 14, 13, 19])
        head = r.choice("3456") + _run(r, n - 2)
        number = head + next(c for c in "0123456789" if _luhn(head + c))
        sizes = [4, 6] if n == 15 else [4] * 4 if r.random() < 0.85 else [n // 2]
        return r.choice([_between(r, "./_|:~*,=\u2013"), _between(r, "./_|:-"), "--", "  "]).join(_cut(r, number, sizes))
    land, trunk = r.choice("123456789") + _run(r, r.randint(0, 2)), r.choice("123456789")
    area, rest = trunk + _run(r, r.randint(1, 3)), _run(r, r.randint(6, 8))
    sep, other = r.choice(" -./"), r.choice(" -./")
    tail = sep.join(_cut(r, rest, r.choice([[3], [4], [2, 2], [3, 2], [9]])))
    north = sep.join([trunk + _run(r, 2), _run(r, 3), _run(r, 4)])
    return r.choice([
        f"00{land}{sep}{area}{sep}{tail}", f"00{land}{sep}{area}{other}{tail}", f"00{land}{area}{rest}", f"00{land} ({area}) {tail}", f"(0{area}) {tail}", f"({area}) {tail}", f"0{area}{other}{tail}", f"0{area}{r.choice('/ -')}{rest}",
        f"1{sep}{north}", f"1{sep}{r.choice([800, 888, 877])}{north[3:]}", north, f"({north[:3]}){r.choice(['', ' '])}{north[4:]}", f"+{land}/{area}/{rest}", f"+ {land} {area} {tail}", f"+({land}) {area} {tail}",
    ])


def _number(r: random.Random) -> str:
    """As many digits as a card has, but failing the check digit."""
    number = str(r.randint(10**15, 10**16 - 1))
    return number[:-1] + str((int(number[-1]) + 1) % 10) if _luhn(number) else number


def _book(r: random.Random) -> str:
    """An ISBN, with or without hyphens."""
    sep = r.choice(["-", "-", " ", ""])
    if r.random() < 0.7:
        head = r.choice(["978", "979"]) + _run(r, 9)
        digits = head + next(c for c in "0123456789" if _isbn(head + c))
        a, b = r.randint(1, 2), r.randint(2, 5)
        return sep.join(_cut(r, digits, [3, a, b, 9 - a - b]))
    head = _run(r, 9)
    digits = next((head + c for c in "0123456789" if _isbn(head + c)), head + "X")
    return sep.join(_cut(r, digits, [1, 4, 4]))


def harmless(r: random.Random) -> str:
    """Something with digits or a sign of an address that is no personal data."""
    n = lambda a, b: r.randint(a, b)
    number = _number(r)
    date = [f"{n(1900, 2100)}", f"{n(1, 12):02}", f"{n(1, 28):02}"]
    kind = r.randrange(9)
    if kind == 0:
        return _book(r)
    if kind == 1:  # order, serial, part and case numbers
        first = r.choice("123456789")
        return r.choice([f"{first}{_run(r, 2)}-{_run(r, 7)}", f"{first}{_run(r, 3)}-{_run(r, 6)}", f"{first}{_run(r, 2)}-{_run(r, 7)}-{_run(r, 7)}", f"{first}{_run(r, n(5, 14))}", f"{first}{_run(r, n(1, 4))}-{_run(r, n(3, 8))}", f"{_word(r, 1, 3).upper()}-{_run(r, n(3, 10))}", f"{_word(r, 1, 3).upper()}{_run(r, n(3, 10))}", f"{_word(r, 2, 3).upper()}-{_run(r, 3)}-{_run(r, n(4, 7))}", f"#{_run(r, n(4, 12))}", f"{first}{_run(r, 3)}/{_run(r, n(2, 6))}"])
    if kind == 2:
        return r.choice(["-".join(date), ".".join(reversed(date)), f"{n(1, 12)}/{n(1, 28)}/{date[0]}", f"{n(0, 23):02}:{n(0, 59):02}", f"{'-'.join(date)} {n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", f"{'-'.join(date)}T{n(0, 23):02}:{n(0, 59):02}", f"{n(1900, 2100)}-{n(1900, 2100)}", "".join(date), f"{''.join(date)}{n(0, 23):02}{n(0, 59):02}{n(0, 59):02}", f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}.{_run(r, 3)}"])
    if kind == 3:
        return r.choice([f"{n(1, 9)}.{n(0, 20)}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 99)}-rc{n(1, 9)}", f"{n(256, 999)}.{n(256, 999)}.{n(0, 300)}.{n(0, 300)}", f"{n(1, 9)}.{n(0, 9)}.{n(0, 9)}.{n(1000, 99999)}"])
    if kind == 4:  # coordinates, prices, shares, ranges, sizes
        return r.choice([f"{n(-90, 90)}.{_run(r, n(3, 6))}, {n(-180, 180)}.{_run(r, n(3, 6))}", f"{n(-90, 90)}.{_run(r, 4)} {n(-180, 180)}.{_run(r, 4)}", f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}", f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", f"{n(1, 99)}%", f"{n(1, 99)}-{n(1, 99)}", f"{n(1, 9)} x {n(1, 9)}", f"{n(100, 999)}-{n(10, 99)}-{_run(r, 4)}"])
    if kind == 5:
        return r.choice([str(n(0, 10**8)), number, r.choice([*".-/_ ", " - ", " . "]).join(_cut(r, number, [4, 4, 4])), f"{n(1000, 9999)} {n(1000, 9999)} {n(1000, 9999)}", f"{n(100, 999)} {n(100, 999)}", _run(r, n(9, 19))])
    if kind == 6:
        return r.choice([f"{n(0, 2**40):x}{n(0, 2**40):x}", f"id-{n(1000, 10**7)}", f"{_word(r)}_{n(1, 999)}", f"@{_word(r)}{n(1, 99)}", f"{_word(r)}-{_word(r)}-{n(1, 99)}"])
    if kind == 7:
        return r.choice([f"{n(1, 300)} dot {n(256, 999)}", "look at the dot here", "a dot on it", f"{n(1, 9)} . {n(1, 9)}", f"{n(1, 9)} at {n(1, 9)}", f"the dot at {_word(r)} dot", f"{_word(r)}-at-{_word(r)}", f"{_word(r)} (at {_word(r)})", f"{_word(r)} {r.choice(['(', '<'])}dot{r.choice([')', '>'])} {_word(r)}"])
    return r.choice([f"{n(1, 99)}, {n(1, 99)}, {n(1, 99)}, {n(256, 999)}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}", f"({n(1, 99)})", f"[{n(1, 999)}]", f"{n(1, 99)}:{n(1, 99)}", f"{n(1, 9)}/{n(1, 9)}"])


Example = tuple[str, list[Span]]


def taught(windows: list[Example], most: int, seed: int = 9) -> list[Example]:
    """What is learned from windows with base spans: themselves, and their changed copies,
    of which a window has the more (five times as many, at most) the fewer there are."""
    r = random.Random(seed)
    known = [(k, text[a:b]) for text, spans in windows for a, b, k in spans]
    times = min(5, max(1, most // max(1, sum(bool(spans) for _, spans in windows))))
    out: list[Example] = []
    for text, spans in windows:
        if not spans:
            out.append((text, []))
            continue
        out.append((text, spans))
        a, b, kind = spans[0]
        head, tail = text[:a], text[b:]
        if any(s[0] < b for s in spans[1:]):
            continue
        rest = lambda at, spans=spans, b=b: [(x - b + at, y - b + at, k) for x, y, k in spans[1:]]
        for i in range(9 * times):
            other = kind if i % 3 == 0 else r.choice([*KINDS, KINDS[0]])
            new = rewrites(other, text[a:b], r)
            out.append((head + new + tail, [(a, a + len(new), other), *rest(a + len(new))]))
        for _ in range(6 * times):
            new = harmless(r)
            out.append((head + new + tail, rest(a + len(new))))
        new = _number(r) if kind == "card" or r.random() < 0.5 else harmless(r)
        out.append((f"{head}{text[a:b]} {new}{tail}", [(a, b, kind), *rest(b + 1 + len(new))]))
        other, near = r.choice(known)
        end = b + 1 + len(near)
        out.append((f"{head}{text[a:b]} {near}{tail}", [(a, b, kind), (b + 1, end, other), *rest(end)]))
        out.append((f"{head}{new} {text[a:b]}{tail}", [(a + len(new) + 1, b + len(new) + 1, kind), *rest(b + len(new) + 1)]))
    return out


def train(examples: list[Example], p: Params) -> Model:
    """Likelihood ascent over windows (text of the window, its spans); no base rule holds here."""
    index: dict[str, int] = {}
    ready: list[tuple[Chart, np.ndarray]] = []
    for text, spans in examples:
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        seeds = _seeds(text, tokens, _spelled(text))
        edges = lattice(text, Stretch(tokens, seeds, [False] * len(tokens)), p)
        where = {e[2]: k for k, e in enumerate(edges) if e[3]}
        own = [(where.get((a, b)), k) for a, b, k in spans]
        if not edges or any(k is None for k, _ in own):
            continue  # a span that is no segment of tokens
        chart = _chart(edges, len(tokens), lambda f: index.setdefault(f, len(index)))
        gold = np.zeros(chart.allowed.shape)
        covered = set()
        for k, kind in own:
            gold[k, 1 + KINDS.index(kind)] = 1
            covered |= set(range(edges[k][0], edges[k][1]))
        for k, e in enumerate(edges):
            if e[1] - e[0] == 1 and e[0] not in covered:
                gold[k, 0] = 1
        ready.append((chart, gold))
    weights = np.zeros((len(index), 1 + len(KINDS)))
    squares = np.full_like(weights, 1e-6)
    for _ in range(p.epochs):
        for c, gold in ready:
            _, probability = _scores(c, weights)
            off = gold - probability
            use = np.flatnonzero(np.abs(off).max(axis=1) > 1e-4)
            if not len(use):
                continue
            rows, at = np.unique(c.feats[use], return_inverse=True)
            gradient = np.zeros((len(rows), weights.shape[1]))
            np.add.at(gradient, at.ravel(), np.repeat(off[use], c.feats.shape[1], axis=0))
            if rows[0] < 0:
                rows, gradient = rows[1:], gradient[1:]
            squares[rows] += gradient * gradient
            weights[rows] += 0.5 * gradient / np.sqrt(squares[rows]) - 1e-4 * weights[rows]
    return Model(index if ready and any(g[:, 1:].any() for _, g in ready) else {}, weights, p)


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Trains on base spans in a bounded sample of windows of ``docs``."""
    n = docs.count()
    h = F.xxhash64("text")
    some = docs.where("text is not null").withColumn("_h", h)
    if n > p.sample_docs:
        some = some.where(F.pmod("_h", F.lit(1 << 30)) < int(p.sample_docs / n * (1 << 30)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, key in zip(pdf["text"], pdf["_h"], strict=True):
                if SEED.search(text):
                    base = base_spans(text)
                    for w in stretches(text, base, p):
                        a, b = w.tokens[0][0], w.tokens[-1][1]
                        if b - a > p.train_chars:
                            continue
                        inside = [(s - a, e - a, k) for s, e, k in base if a <= s and e <= b]
                        open_ = any(e and not f and len(_digits(text[x:y])) >= 3 for (x, y), e, f in zip(w.tokens, w.seeds, w.fixed, strict=True))
                        if open_ and inside:
                            continue  # next to a span, digits may be one that the rules lost
                        own = hashlib.md5(f"{key}:{a}".encode()).hexdigest()
                        rows.append((own, not inside, text[a:b], [s for s, _, _ in inside], [e for _, e, _ in inside], [k for _, _, k in inside]))
            yield pd.DataFrame(rows, columns=["h", "empty", "part", "a", "b", "k"])

    found = (
        some.select("text", "_h")
        .mapInPandas(cut, "h string, empty boolean, part string, a array<int>, b array<int>, k array<string>")
        .dropDuplicates(["h"])
        .withColumn("r", F.row_number().over(W.partitionBy("empty").orderBy("h")))  # of the sample's windows
        .where(F.col("r") <= F.when(F.col("empty"), p.max_windows // 4).otherwise(p.max_windows - p.max_windows // 4))
        .orderBy("empty", "r")
        .collect()
    )
    return train(taught([(r["part"], list(zip(r["a"], r["b"], r["k"], strict=True))) for r in found], p.max_windows), p)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by [KIND]."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with base_spans, spans and redacted; columns so named are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_windows
    span = "array<struct<start int, end int, kind string>>"

    @F.pandas_udf(f"struct<base_spans {span}, spans {span}, redacted string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for t in texts:
            base, every = find(t, shared.value)
            rows.append((as_rows(base), as_rows(every), redact(t, every)))
        return pd.DataFrame(rows, columns=["base_spans", "spans", "redacted"])

    names = ("base_spans", "spans", "redacted")
    out, laid_out = carry(docs, names, found("text").alias("f"))
    return laid_out(out, *(f"f.{c}" for c in names))
