"""Packing, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from fractions import Fraction
from itertools import pairwise

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from permitlake.llm import mixing, neardup, packing
from permitlake.llm.common import table
from pyspark.sql import functions as F
from worlds import DATA


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_best_fit_and_bound(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets, fill = packing.best_fit_decreasing(n, 30)
    assert fill.sum() == n.sum() and fill.max() <= 30 and (np.bincount(bins, n) == fill).all()
    for b in range(len(fill)):
        own = sorted(zip(offsets[bins == b].tolist(), n[bins == b].tolist(), strict=True))
        assert own[0][0] == 0 and all(a + x == c for (a, x), (c, _) in pairwise(own))
    bound = packing.lower_bound(np.bincount(n, minlength=31), 30)
    assert -(-int(n.sum()) // 30) <= bound <= len(fill) and bound >= int((n > 15).sum())


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(1)

    def optimum(items, bins=()):
        if not items:
            return len(bins)
        best, x = len(items) + len(bins), items[0]
        for i in range(len(bins)):
            if bins[i] + x <= 12 and bins[i] not in bins[:i]:
                best = min(best, optimum(items[1:], (*bins[:i], bins[i] + x, *bins[i + 1 :])))
        return min(best, optimum(items[1:], (*bins, x)))

    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(7)), reverse=True)
        assert packing.lower_bound(np.bincount(items, minlength=13), 12) <= optimum(items)


def layout_is_sound(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(parts[-1]) <= capacity
    return len(by)


def test_pieces_and_layout(spark, documents, odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.vocabulary_paths()[0])
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é😀\n\t '12.,中ʼ<|end>") for _ in range(rng.randrange(300))) for _ in range(100)] + ["it's <|endoftext|> here", "a" * 9000, "", None]
    df = documents(list(enumerate(texts))).unionByName(odd)
    layout = packing.pack(packing.pieces(df), packing.Params(part_rows=25)).collect()
    layout_is_sound(layout)
    by = {}
    for r in layout:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        if i in (1, 2, 3, 4, 5, 6, 7):
            continue  # ids that odd rows share
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert len(by[None]) == 2 and packing.pack(packing.pieces(odd.limit(0))).count() == 0


def test_ranks_give_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    reference, encode = Tokenizer.from_file(packing.vocabulary_paths()[0]), packing.encoder(packing.vocabulary_paths())
    for r in table(spark, DATA, "documents").select("text").collect():
        assert encode(r["text"]).tolist() == reference.encode(r["text"], add_special_tokens=False).ids


def test_exchange_reaches_the_bound(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([700, 900, 1100, 1300, 40, 5]), 0) for i in range(1500)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(cut, packing.Params(part_rows=60)).persist()
    made = packing.certificate(found)
    assert layout_is_sound(found.collect()) == made["sequences"] and found.count() == 1500
    alone, whole = (packing.certificate(packing.pack(cut, packing.Params(part_rows=n, rounds=0)))["sequences"] for n in (60, 10_000))
    assert made["bound"] <= made["sequences"] <= min(alone, 1.02 * whole)  # whole: all in one partition


def test_sequences_hold_the_ids(documents):
    df = documents([(i, f"text number {i} " * (i % 5)) for i in range(40)])
    layout = packing.pack(packing.pieces(df))
    got = packing.sequences(df, layout)
    ids = {r["doc_id"]: list(r["ids"]) for r in packing.pieces(df, with_ids=True).collect()}
    where = layout.collect()
    for r in got.collect():
        for x in where:
            if x["sequence_id"] == r["sequence_id"]:
                assert list(r["ids"][x["offset"] : x["offset"] + x["length"]]) == ids[x["doc_id"]]


def test_packing_in_order(documents, tmp_path):
    """Sequences follow the stored order but for the documents of one range, and need hardly more of them."""
    rng = random.Random(5)
    df = documents([(i, "w " * rng.randrange(1, 900)) for i in range(1200)]).orderBy("doc_id").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "t"))
    stored = df.sparkSession.read.parquet(str(tmp_path / "t"))
    p = packing.Params(part_rows=100)
    cut = packing.pieces_in_order(stored, p)
    assert [(r["place"], r["doc_id"]) for r in cut.where("piece = 0").orderBy("place").collect()] == [(i, i) for i in range(1200)]
    layout = packing.pack(cut, p).persist()
    rows = layout.collect()
    used = layout_is_sound(rows)
    assert len(rows) == cut.count() and used <= 1.02 * packing.certificate(layout)["bound"]
    ranges = [r["doc_id"] // 100 for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    late = sum(a > b for a, b in pairwise(ranges))
    assert late <= 0.05 * len(rows) and max(b - a for a, b in pairwise(ranges)) < 16
    assert packing.pack(packing.pieces_in_order(stored.limit(0), p), p).count() == 0


# mixing


def by_hand(blocks, weights):
    """Earliest deadline first, slot by slot, with every comparison by exact fractions."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while left := {x: n for x, n in left.items() if n}:
        share = {x: Fraction(weights[x]) for x in left if weights[x] > 0} or dict.fromkeys(left, Fraction(1))
        share = {x: w / sum(share.values()) for x, w in share.items()}
        t, j = 0, dict.fromkeys(share, 0)
        while True:
            ready = [(math.ceil((j[x] + 1) / w), x) for x, w in share.items() if math.floor(j[x] / w) <= t]
            x = min(ready)[1]
            if not left[x]:
                break
            out.append((x, done[x]))
            left[x], done[x], j[x], t = left[x] - 1, done[x] + 1, j[x] + 1, t + 1
    return out


WEIGHTS = st.one_of(st.integers(1, 50).map(float), st.floats(1e-4, 1.0), st.just(0.0))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.integers(0, 40), WEIGHTS), max_size=9))
def test_turns_beside_a_plain_schedule(sources):
    """The same slots; and until a source runs out, each has its share of them, off by less than one."""
    blocks, weights = {x: n for x, (n, _) in sources.items()}, {x: w for x, (_, w) in sources.items()}
    got = list(mixing.turns(blocks, weights))
    assert got == by_hand(blocks, weights)
    alive = {x: Fraction(weights[x]) for x, n in blocks.items() if n and weights[x] > 0}
    had = dict.fromkeys(alive, 0)
    for t, (x, _) in enumerate(got, 1):
        if not alive:
            break
        had[x] += 1
        assert all(abs(had[y] - t * w / sum(alive.values())) < 1 for y, w in alive.items())
        if had[x] == blocks[x]:
            break


def test_mix_beside_a_plain_version(spark, documents):
    """Places of all rows of a table with a hot source, repeated rows, nulls and many small sources."""
    r = random.Random(5)
    docs = documents([(r.randrange(300), r.choice(["a", "b", None]), "en", "hot" if r.random() < 0.34 else r.choice([None, *(f"s{k}" for k in range(40))])) for _ in range(700)])
    p = mixing.Params(block_docs=4, bucket_rows=60)
    weights = {"hot": 5.0, "s1": 0.5, "s2": 0.25}
    mixed = mixing.mix(docs, weights, p)
    rows = [x for x in mixed.withColumns({"h": F.xxhash64("doc_id", "text"), "s": F.coalesce("source", F.lit(""))}).collect()]
    buckets = -(-len(rows) // p.bucket_rows)
    order = {}
    for x in sorted(rows, key=lambda x: (x["h"] % buckets, x["h"], x["doc_id"])):
        order.setdefault(x["s"], []).append((x["h"], x["doc_id"]))
    slots = {block: t for t, block in enumerate(by_hand({x: -(-len(n) // 4) for x, n in order.items()}, {x: weights.get(x, 0.25) for x in order}))}
    want = sorted((x, h, i, k // 4, slots[x, k // 4], k % 4) for x, own in order.items() for k, (h, i) in enumerate(own))
    assert sorted((x["s"], x["h"], x["doc_id"], x["block"], x["slot"], x["place"]) for x in rows) == want


def test_mix_uses_every_row_once(documents, odd):
    df = documents([(i, f"t{i}", "en", f"s{i % 3 if i % 5 else 0}") for i in range(700)]).unionByName(odd).withColumn("slot", F.lit("mine"))
    p = mixing.Params(block_docs=4, period=32, bucket_rows=50)
    rows = mixing.in_order(mixing.mix(df, {"s0": 1.0, "s1": 2.0}, p)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in df.collect())
    keys = [(r["slot"], r["place"]) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    slots = sorted({(r["slot"], r["source"] or "") for r in rows})
    assert [s for s, _ in slots] == list(range(len(slots)))  # one source and one block each
    assert mixing.mix(df.limit(0), p=p).count() == 0


def test_more_sources_than_the_bound(documents):
    df = documents([(i, "t", "en", f"s{i % 20}") for i in range(200)])
    got = mixing.mix(df, p=mixing.Params(block_docs=2, period=64))
    assert got.count() == 200 and got.select("slot", "place").distinct().count() == 200


def mixed_order(docs, weights, p):
    """The source of every slot, blocks being single documents."""
    return [r["source"] for r in mixing.in_order(mixing.mix(docs, weights, p)).collect()]


def test_prefixes_keep_to_the_given_weights(documents):
    weights = {"a": 0.6, "b": 0.1, "c": 0.1, "d": 0.1, "e": 0.0999, "f": 0.0001}
    df = documents([(i, "t", "en", "aaaaaabcdef"[i % 11]) for i in range(3300)])
    got = mixed_order(df, weights, mixing.Params(block_docs=1, period=32))
    seen = dict.fromkeys(weights, 0)
    for t, s in enumerate(got[:2500], 1):  # about 80 periods; no source has run out
        seen[s] += 1
        assert all(abs(seen[x] - t * w / sum(weights.values())) < 1 + 1e-9 for x, w in weights.items()), t
    assert len(got) == 3300


def test_every_source_has_its_own_weight(documents):
    df = documents([(i, "t", "en", f"s{i % 300:03}") for i in range(600)] + [(i, "t", "en", "tiny") for i in range(600, 601)])
    weights = {f"s{i:03}": 1.0 for i in range(300)} | {"tiny": 300.0}  # the smallest of 301 is due at once
    got = mixed_order(df, weights, mixing.Params(block_docs=1))
    assert len(got) == 601 and got.index("tiny") == 0
    # it is due again within four slots, and without a block left a new schedule of the 300 others starts
    assert any(len(set(got[q : q + 300])) == 300 for q in range(1, 5))


def test_sources_of_weight_zero_follow(documents):
    df = documents([(i, "t", "en", "xyz"[i % 3]) for i in range(90)])
    got = mixed_order(df, {"x": 1.0, "y": 0.0, "z": 0.0}, mixing.Params(block_docs=1))
    assert got[:30] == ["x"] * 30 and all(set(got[i : i + 2]) == {"y", "z"} for i in range(30, 90, 2))


# the pipeline


def test_stages_on_odd_tables(spark, odd):
    for df in (odd, odd.limit(0)):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == odd.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := stage(spark, docs, DATA).persist())
    return out


def test_toxic_documents_go(spark, documents, tmp_path):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["the", "on", "river", "house", "green"]) for _ in range(30))
    docs = documents([(i, say() + (" scum idiot" if i % 5 == 0 else "")) for i in range(500)])
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [i for i in range(500) if i % 5]


def test_stage_decisions_take_effect(stages):
    before, after = stages["near_duplicates"]
    assert after.count() < before.count()
    before, after = stages["near_duplicates"]
    classes = neardup.classes(before).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["class_id"] for r in classes})
    before, after = stages["personal_data"]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"]) and ("[" in r["text"] or r["text"] == text[r["doc_id"]])
    assert after.where(F.col("text").contains("@mail")).count() == 0
    before, after = stages["mixing"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    before, after = stages["packing"]
    # the layout needs no schedule of its own: it follows the mixture's (test_packed_output_follows_the_weights)
    layout_is_sound(after.collect())
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_packed_output_follows_the_weights(spark, documents, tmp_path, monkeypatch):
    """Every prefix of sequences holds the sources in their weights, but for the documents of one range."""
    rng = random.Random(7)
    df = documents([(i, f"t{i} " * rng.randrange(20, 60) * (1 + i % 3), "en", f"s{i % 3}") for i in range(3000)])
    weights = {"s0": 4.0, "s1": 2.0, "s2": 1.0}
    monkeypatch.setattr(mixing, "default_weights", lambda sizes, t: weights)
    corpus_pipeline.mix_sources(spark, df, "").write.parquet(str(tmp_path / "m"))
    layout = packing.pack(packing.pieces_in_order(spark.read.parquet(str(tmp_path / "m")), packing.Params(part_rows=50)), packing.Params(part_rows=50))
    seen, n = {"s0": 0, "s1": 0, "s2": 0}, 0
    for r in sorted(layout.where("piece = 0").collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        seen[f"s{r['doc_id'] % 3}"] += 1
        n += 1
        if n <= 1600:  # s0 runs out at 1750
            assert all(abs(seen[s] - n * w / 7) <= 16 + 100 for s, w in weights.items()), (n, seen)
    assert n == 3000 and sum(seen.values()) == 3000
