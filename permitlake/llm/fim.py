"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). The cuts are drawn from
the document's id alone, so they are the same on every run: the first four
8-digit groups of the hex SHA-256 of ``seed:doc_id`` are numbers h1 to h4, the
prefix ends after the smaller of h1 and h2 modulo (units + 1) units, the middle
after the larger. h3 decides whether a text is changed at all (``percent``), h4
which form it takes: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm``
is ``<S>``suffix``<P>``prefix``<M>``middle, ``plain`` the text itself.

Places are found by words, not by a scan per character (``Marks``): the UTF-8
bytes of a whole Arrow batch are seen as 64-bit words; arithmetic on a word
marks its eight bytes at once; bits are counted per word; the word of a wanted
mark is found in the cumulative counts, and the mark inside it by clearing
lower ones. Only three numbers per text come back from Python: texts are cut,
joined, restored and hashed by built-in functions.

Edge cases: a null text is empty; empty texts, and texts that hold one of the
signs, stay plain, with null prefix_chars and middle_chars; a text without a
line end is one unit; a null id is an empty one; repeated rows each get their
own (equal) result. Columns named like those made are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import carry

#: The signs before prefix, suffix and middle.
SIGNS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")
_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F) * _ONES
_HIGH = np.uint64(0x80) * _ONES
_U1 = np.uint64(1)


@dataclass(frozen=True)
class Params:
    seed: int = 7
    percent: int = 100  #: of the texts, so many are changed
    spm_percent: int = 50  #: of the changed texts, so many are suffix first


class Marks:
    """Marked bytes of a buffer: how many lie before a byte, and where the k-th is."""

    def __init__(self, words: np.ndarray) -> None:
        """``words`` has 0x80 in every marked byte and 0 in the others."""
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def equal(words: np.ndarray, byte: int) -> Marks:
        """Marks the bytes equal to one; no carry runs from byte to byte."""
        x = words ^ (np.uint64(byte) * _ONES)
        return Marks(~(((x & _LOW) + _LOW) | x | _LOW))

    @staticmethod
    def continuation(words: np.ndarray) -> Marks:
        """Marks the bytes 10xxxxxx, which begin no code point."""
        return Marks(words & ~(words << _U1) & _HIGH)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The number of marked bytes before each byte place."""
        word = at >> 3
        inside = (_U1 << ((at & 7) * 8).astype(np.uint64)) - _U1
        own = np.concatenate([self.words, np.zeros(1, np.uint64)])[word]
        return self.upto[word] + np.bitwise_count(own & inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte place of each k-th marked byte (from 0)."""
        word = np.searchsorted(self.upto, k, side="right") - 1
        own, left = self.words[word], k - self.upto[word]
        for step in range(1, 8):  # a word has eight bytes
            own = np.where(left >= step, own & (own - _U1), own)
        lowest = own & (~own + _U1)
        return (word << 3) + (np.bitwise_count(lowest - _U1) >> 3)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch's UTF-8 bytes as words (the last one filled up), and each text's bounds in bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    padded = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    padded[: len(raw)] = raw
    return padded.view("<u8"), at - at[0]


def places(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its units, and the code points of prefix and middle."""
    words, at = _buffer(texts)
    start, end = at[:-1], at[1:]
    lines, inner = Marks.equal(words, 0x0A), Marks.continuation(words)
    first, after = lines.before(start), lines.before(end)
    ended = np.zeros(len(start), bool)
    full = end > start
    ended[full] = lines.before(end[full] - 1) < after[full]
    n = after - first + (full & ~ended)
    a, b = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)

    def byte_after(units: np.ndarray) -> np.ndarray:
        place = np.where(units == n, end, start)
        inside = (units > 0) & (units < n)
        place[inside] = lines.select(first[inside] + units[inside] - 1) + 1
        return place

    cuts = [start, byte_after(a), byte_after(b)]
    chars = [cut - inner.before(cut) for cut in cuts]
    return n, chars[1] - chars[0], chars[2] - chars[1]


def numbers(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with n, form, prefix_chars, middle_chars and output."""

    @F.arrow_udf("struct<n long, prefix_chars long, middle_chars long>")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        found = places(texts, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["n", "prefix_chars", "middle_chars"])

    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = numbers(F.col("doc_id"), p.seed)
    own, laid_out = carry(docs, MADE, text.alias("t"), cut(text, h1, h2).alias("c"), h3.alias("h3"), h4.alias("h4"))
    t, a, b = F.col("t"), F.col("c.prefix_chars"), F.col("c.middle_chars")
    signed = t.contains(SIGNS[0]) | t.contains(SIGNS[1]) | t.contains(SIGNS[2])
    plain = (t == "") | signed | (F.col("h3") % 100 >= p.percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < p.spm_percent, "spm").otherwise("psm")
    one, length = F.lit(1), F.length(t)
    prefix, middle, suffix = F.substring(t, one, a), F.substring(t, a + 1, b), F.substring(t, a + b + 1, length)
    first, second, third = map(F.lit, SIGNS)
    psm, spm = F.concat(first, prefix, second, suffix, third, middle), F.concat(second, suffix, first, prefix, third, middle)
    whole = own.withColumn("form", form)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t)
    count = lambda c, name: F.when(F.col("form") != "plain", c).alias(name)
    return laid_out(whole, F.col("c.n").alias("n"), "form", count(a, "prefix_chars"), count(b, "middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from; no sign can begin inside another, so the parts are clear."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
