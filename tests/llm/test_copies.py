"""Near-duplicates and repeated passages, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from permitlake.llm import neardup, queries, substrings
from permitlake.llm.common import table
from worlds import DATA

WORD = r"[^\x20\x09-\x0D]+"


def shingles(t):
    w = re.findall(WORD, t or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else None


def groups(rows, least=0.8):
    """Smallest id of each row's class, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for x, (_, s) in enumerate(sets):
        both = Counter()
        for k, c in (s or {}).items():
            for y in inverted.setdefault(k, []):
                both[y] += min(c, sets[y][1][k])
            inverted[k].append(x)
        for y, c in both.items():
            if c >= least * (sum(s.values()) + sum(sets[y][1].values()) - c):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    members = {}
    for x, (i, _) in enumerate(sets):
        members.setdefault(top(x), []).append(i)
    return {i: min(m) for m in members.values() for i in m}


def test_classes_on_the_tables(spark):
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_neardup(spark, DATA).collect()}
    assert got == groups([(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()])


def test_chains_and_scattered_copies(documents):
    """Copies that differ more from one another than from the text between them."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in rng.sample(range(300), rng.choice([1, 3, 6, 9, 15])):
            w[k] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"z{rng.randrange(5000)}" for _ in range(100))) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(rows), neardup.Params(block=16)).collect()}
    want = groups(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 1, wrong


def test_blocks_and_whole_buckets_agree(documents):
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    copy = lambda n: " ".join(w if rng.random() > n else f"q{rng.randrange(10**6)}" for w in base)
    df = documents([(i, copy(rng.choice([0.005, 0.02, 0.05]))) for i in range(80)])
    one, two = ({r["doc_id"]: r["class_id"] for r in neardup.classes(df, neardup.Params(block=b)).collect()} for b in (7, 1000))
    assert one == two


def test_odd_rows(documents, odd):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["class_size"], r["kept"]))
    assert by[1] == [(1, 1, True)] == by[1] and by[2] == [(2, 1, True)] and by[5] == [(5, 2, True)] * 2 and by[6] == [(6, 1, True)]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1 and kept.where("doc_id = 5").count() == 1
    assert neardup.classes(odd.limit(0)).count() == 0 and neardup.keep_one(odd.limit(0)).count() == 0


def test_keep_one_keeps_the_smallest(documents):
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(5, same), (3, same), (9, same + " end"), (4, "other words are here to stay for now")]
    assert sorted(r["doc_id"] for r in neardup.keep_one(documents(rows)).collect()) == [3, 4]


def test_keep_one_of_rows_that_differ_elsewhere(documents):
    same = "one two three four five six seven"
    rows = [(5, same, "en", f"s{i}") for i in range(6)] + [(5, same, None, None), (8, same, "de", "x")]
    kept = {tuple(neardup.keep_one(documents(rows[k:] + rows[:k]).repartition(1 + k % 3)).collect()) for k in range(4)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1 and next(iter(kept))[0]["doc_id"] == 5


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(20):
        n = int(rng.integers(3, 400))
        ids = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a, b = rng.uniform(0.1, 4, n), rng.uniform(0.1, 4, n)
        sig = neardup.signatures(np.repeat([0, 1], n), np.concatenate([ids, ids]), np.concatenate([a, b]), 2, 1500)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.06


# repeated passages


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), kept)
    return out


def check(df, p=substrings.Params()):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove(df, p).collect()}
    assert got == removed(rows)
    return got


def test_repeats_on_the_tables(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op8_substrings(spark, DATA).collect()}
    want = removed([(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()])
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}


def test_repeats_within_and_across(documents):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh")
    passage = [word() * 3 for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(40))] + passage[rng.randrange(6) :] + [word() for _ in range(rng.randrange(20))])) for i in range(120)]
    rows += [(200, " ".join(passage * 3)), (201, "same " * 100), (202, "é\xa0ü " * 25), (203, " \t\n"), (204, None), (205, "\x1fa\x85b " * 30)]
    one = check(documents(rows).repartition(5))
    assert one == check(documents(rows).repartition(3), substrings.Params(chunk_words=50))


def test_runs_longer_than_a_batch(spark, documents):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(documents([(i, " ".join(f"w{(k + i % 2) % 23}" for k in range(90))) for i in range(40)]).repartition(8), substrings.Params(chunk_words=100))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unlike_windows_that_agree_in_32_bits(documents):
    run = [f"g{i}" for i in range(1277953, 1277958)]  # the least run of each of these windows, with a very small hash
    ends = (145257, 60929, 16166, 116422, 385854, 82200, 14064, 78674)  # pairs that agree in the upper half of the window's hash
    df = documents([(k, " ".join([f"x{i}" for i in range(14)] + [f"x{x}"] + run)) for k, x in enumerate(ends)])
    for p in (substrings.Params(), substrings.Params(chunk_words=20)):
        assert all(n == 0 for _, n, _ in check(df, p).values())


def test_hot_owners_are_dealt_on(documents):
    """One run in every document: its windows are many, and go to many tasks, with the same result."""
    rng = random.Random(13)
    run = [f"g{i}" for i in range(1277953, 1277958)]  # a very small hash: the owner of every window that holds it
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(own(15) + run + own(15))) for i in range(400)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    df = documents(rows).repartition(4)
    p = substrings.Params(sample=1, owner_windows=100, chunk_words=200)
    owner, parts = substrings.hot_owners(df, p)
    assert len(owner) == 1 and parts[0] == 128  # 7,040 windows
    spread = substrings._deal_on(np.repeat(owner, 5_000), np.random.default_rng(1).integers(0, 1 << 63, 5_000).astype(np.uint64), (owner, parts))
    assert np.unique(spread, return_counts=True)[1].max() < 80 and len(np.unique(spread)) == 128
    assert check(df, p) == check(df, substrings.Params(chunk_words=200)) and not len(substrings.hot_owners(df.limit(0), p)[0])


def test_odd_rows_of_repeats(odd):
    got = substrings.remove(odd).collect()
    assert len(got) == odd.count() and got[0]["_id"] == "other"
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["n_words"] == 40_000 and by[4]["n_removed"] == 40_000 - 997 - 19 + 19 and by[5]["n_removed"] == 0
    assert substrings.remove(odd.limit(0)).count() == 0
