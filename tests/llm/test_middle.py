"""Fill-in-the-middle beside a plain version, by property and on odd tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from permitlake.llm import fim
from pyspark.sql import functions as F

CHARS = st.sampled_from("ab\n\né€😀\x00ÿ ")


def plainly(doc_id, text, p=fim.Params()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.SIGNS) or h[2] % 100 >= p.percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < p.spm_percent:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.none() | st.text(CHARS, max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=12), st.integers(0, 3))
def test_places_by_words(rows, skipped):
    """Whole batches, and batches that are a slice of a longer array."""
    texts = pa.array(["é\n"] * skipped + [t for t, _, _ in rows], pa.string())[skipped:]
    found = fim.places(texts, np.array([a for _, a, _ in rows], np.int64), np.array([b for _, _, b in rows], np.int64))
    for i, (t, x, y) in enumerate(rows):
        units = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        a, b = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        assert tuple(int(c[i]) for c in found) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=70), st.integers(0, 255))
def test_marks_by_arithmetic(data, byte):
    words = np.frombuffer(data + b"\0" * (-len(data) % 8), "<u8")
    marks = fim.Marks.equal(words, byte)
    where = [i for i, b in enumerate(words.tobytes()) if b == byte]
    assert marks.select(np.arange(len(where))).tolist() == where
    assert marks.before(np.arange(len(data) + 1)).tolist() == [sum(w < i for w in where) for i in range(len(data) + 1)]


def test_same_as_plain_version_and_restored(spark, odd, documents):
    signs = documents([(i, t) for i, t in enumerate(["<P>", "a<S>\nb", "x\n<M", "<<\nS>\n", ">\n<P\n>", "\n", "\n\n\n", "one line", "é\n😀\nÿ"] * 20)])
    for docs in (odd, signs):
        for p in (fim.Params(), fim.Params(seed=3, percent=40, spm_percent=0)):
            out = fim.transform(docs, p).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
            assert len(out) == docs.count()
            for r in out:
                assert tuple(r[c] for c in fim.MADE) == plainly(r["doc_id"], r["text"], p)
                assert r["again"] == (r["text"] or "")


def test_forms_are_mixed_and_columns_stay(spark, documents):
    out = fim.transform(documents([(i, f"a\nb{i}\nc\nd") for i in range(400)]))
    forms = {r["form"]: r["count"] for r in out.groupBy("form").count().collect()}
    assert forms.keys() == {"psm", "spm"} and min(forms.values()) > 140
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "_id", *fim.MADE]
    again = fim.transform(out.drop("n")).select(*out.columns)  # columns named like those made are replaced
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_empty_table(documents):
    assert fim.transform(documents([])).collect() == []
