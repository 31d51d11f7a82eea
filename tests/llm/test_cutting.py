"""Cutting-stock packing: ids, knapsack, programs, layouts."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from permitlake.llm import cutting
from permitlake.llm.common import table
from pyspark.sql import functions as F
from worlds import DATA

SIGNS = ["a", "B", "'s", "'S", "'", "'ll", "Σ", "İ", "é", "é", "́", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "​", "1", "23", "!", "_", "²", "ª", "×", "<", "|", "<|endoftext|>", "ß", "ẞ", "ǅ", "ŉ", "한", "中", "😀"]


@pytest.fixture(scope="module")
def ids():
    return cutting.Ids(cutting.vocabulary_path(), 50)  # small, so that it forgets


@settings(max_examples=300, deadline=None)
@given(words=st.lists(st.sampled_from(SIGNS), max_size=14))
def test_ids_are_the_tokenizers(ids, words):
    text = "".join(words)
    assert ids.of(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 9))
def test_knapsack_beside_all_multisets(demand, seed):
    r = random.Random(seed)
    lengths = np.array(sorted(demand))
    prices = np.array([r.random() for _ in lengths])
    value, _ = cutting._best_fills(lengths, prices, 16)
    best = {}
    for items in product(*(range(16 // n + 1) for n in lengths.tolist())):
        fill = int(np.dot(items, lengths))
        best[fill] = max(best.get(fill, 0.0), float(np.dot(items, prices)))
    for fill in range(17):
        assert (fill in best) == bool(np.isfinite(value[fill])) and (fill not in best or abs(best[fill] - value[fill]) < 1e-9)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 300), min_size=1, max_size=12))
def test_program_and_completion(demand):
    """The program covers no more than there is; whole copies and the strip cover it exactly, without padding."""
    p = cutting.Params(capacity=64)
    lengths, wanted = np.array(sorted(demand)), np.array([demand[n] for n in sorted(demand)])
    solution = cutting.solve(lengths, wanted, p)
    covered = sum((x * c for x, c in solution), np.zeros(len(lengths)))
    assert (covered <= wanted + 1e-6).all()
    patterns = cutting.rounded(lengths, wanted, solution)
    left = dict(demand)
    for n, f in patterns:
        for k, a in f.items():
            left[k] -= n * a
    more, strip = cutting.complete(left, p)
    every = Counter(strip)
    for n, f in patterns + more:
        assert sum(k * a for k, a in f.items()) in {1 << i for i in range(7)}
        for k, a in f.items():
            every[k] += n * a
    assert +every == Counter(demand)


def test_program_finds_what_greedy_misses():
    """Items of 40 go with 24, those of 44 with 20: the optimum has no padding at all."""
    lengths, wanted = np.array([20, 24, 40, 44]), np.array([500, 500, 500, 500])
    solution = cutting.solve(lengths, wanted, cutting.Params(capacity=64))
    assert abs(sum(x for x, _ in solution) - 1000) < 1e-6


def laid_out(docs, p=cutting.Params()):
    """The layout's rows, checked: every id once, gapless sequences, crc of the tokenizer's ids."""
    tokens = cutting.tokens(docs, p=p)
    rows = cutting.lay_out(tokens, p).collect()
    ids = cutting.Ids(cutting.vocabulary_path(), 1000)
    whole = {(r["part"], r["k"]): r for r in tokens.collect()}
    texts = Counter((r["doc_id"], ids.of(r["text"]) + np.array([p.end], "<u4").tobytes()) for r in docs.collect())
    assert texts == Counter((r["doc_id"], bytes(r["ids"])) for r in whole.values())
    by_doc, by_sequence = {}, {}
    for r in rows:
        data = bytes(whole[r["part"], r["k"]]["ids"])
        assert r["doc_tokens"] == len(data) // 4
        assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["length"] > 0
        by_doc.setdefault((r["part"], r["k"]), []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, own in by_doc.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(bytes(whole[key]["ids"])) // 4
    assert len(by_doc) == len(whole)
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= p.capacity and at & (at - 1) == 0  # nothing is padded
    return rows, by_sequence, tokens


def test_odd_rows(odd):
    rows, _, _ = laid_out(odd)
    assert sum(r["doc_tokens"] == 1 for r in rows) == 4  # null, empty, blank, null without id


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_one_length_holds_all(documents, n):
    """A hot length that only fits by cutting: as many sequences as the tokens need, and the tail's."""
    p = cutting.Params(capacity=64)
    rows, sequences, _ = laid_out(documents([(i, "a " * 39) for i in range(n)]).repartition(5), p)
    assert len(sequences) <= n * 40 // 64 + 6
    assert len(rows) <= 2 * n + 6


def test_sequences_hold_the_ids(documents):
    docs = documents([(i, "word " * (7 * i % 150)) for i in range(60)])
    p = cutting.Params(capacity=64, rows=8)
    _, by_sequence, tokens = laid_out(docs, p)
    made = {r["sequence_id"]: bytes(r["ids"]) for r in cutting.sequences(tokens, cutting.lay_out(tokens, p)).collect()}
    assert {s: len(d) // 4 for s, d in made.items()} == {s: sum(n for _, n in own) for s, own in by_sequence.items()}
    assert b"".join(sorted(made.values())).count(np.array([p.end], "<u4").tobytes()) >= 60


def test_given_table_is_cut_little(spark):
    docs = table(spark, DATA, "documents")
    rows, sequences, tokens = laid_out(docs)
    least = tokens.agg(F.sum(F.ceil(F.col("doc_tokens") / 4096))).first()[0]
    assert len(rows) <= least + 14
    assert len(sequences) <= tokens.agg(F.sum("doc_tokens")).first()[0] / 4096 + 14


def test_empty_table(documents):
    assert cutting.pack(documents([])).collect() == []
