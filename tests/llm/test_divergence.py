"""The audit of sources beside a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from permitlake.llm import divergence


def plainly(rows, p=divergence.Params()):
    docs = []
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= p.min_docs}
        counts = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, ts in docs:
            if l == lang:
                counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, own in counts.items():
            pairs = [(sum(f(share(own, t), share(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            terms = [(f(share(own, t), share(whole, t)), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, p.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def world(seed, n, sources, hot=0.34):
    r = random.Random(seed)
    words = ["a", "B", "é", "É", "ab", "AB", "z9z", "ﬁ", "😀", "zz", "y_y", "Σ"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    source = lambda: "hot" if r.random() < hot else f"s{r.randrange(sources)}"
    return [(None if r.random() < 0.03 else " ".join(r.choice(words) for _ in range(r.randrange(30))), r.choice(["en", "fr", None]), None if r.random() < 0.02 else source()) for _ in range(n)]


def audited(spark, rows, p=divergence.Params()):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, p).collect())


@pytest.mark.parametrize("p", [divergence.Params(), divergence.Params(min_docs=3, top=4, flush=50, block_rows=40, source_block=2, cells=60)])
def test_same_as_plain_version(spark, p):
    """Also with tables that are handed on early, many blocks of terms and of sources, and little memory."""
    rows = world(1, 400, 6)
    assert audited(spark, rows, p) == plainly(rows, p)


def test_nothing_kept_and_single_sources(spark):
    rows = [("rare word", "de", "x"), (None, "de", "y"), ("", None, None), ("alone " * 30, "it", "only")] + [("same", "nl", "s")] * 12
    assert audited(spark, rows) == plainly(rows)


def test_ties_follow_utf8(spark):
    """Equal values, more of them than there are ranks, in byte order: U+FFxx stands before U+1xxxx."""
    words = ["ａ", "\U00010400", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "é"]
    rows = [(" ".join(words), "en", "one")] * 10 + [("other", "en", "two")] * 10
    assert audited(spark, rows) == plainly(rows)


def test_counts_beyond_64_bits(spark):
    """The numerator of p needs more than 64 bits from counts of about nine thousand million on."""
    from pyspark.sql import functions as F

    n, size, kept = 10**13 + 7, 3 * 10**14, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (size + 2 * kept)


def test_empty_table(spark):
    assert audited(spark, []) == []
