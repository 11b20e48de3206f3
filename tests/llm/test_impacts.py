"""Ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import impacts, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, shard int").repartition(3)
    q = spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, score double")
    return [tuple(r) for r in impacts.ranked(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()]


def random_docs(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 80))) if x < 300)) for i in range(n)]


def test_against_brute_force(spark):
    docs = random_docs(400) + [(1000, None), (1001, ""), (1002, "É漢字 w1-W2_w3 w1"), (None, "w5 w6 w7"), (None, "w5 w6 w7"), (1003, "w5 w6 w7"), (1004, " ".join(["w1 w9"] * 30000))]
    docs += [(2000 + i, "tie tie w2") for i in range(150)]
    items = [(1, "w1 w2 w2 w50 W7"), (2, None), (3, ""), (4, "nowhere"), (5, "tie"), (None, "w5 w6 w7"), (6, "é漢字!"), (7, " ".join(f"w{i}" for i in range(200)))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_repeated_questions_and_empty_tables(spark):
    docs = random_docs(30)
    assert sorted(run(spark, docs, [(1, "w1 w2"), (1, "w1 w2")])) == sorted(brute(docs, [(1, "w1 w2")] * 2))
    assert run(spark, [], [(1, "w1")]) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], [(1, "w1")]) == []


def test_blocks_and_shards_change_nothing(spark):
    docs, items = random_docs(200), [(i, f"w{i} w{i + 1} w3") for i in range(12)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    n, total = impacts.collection(d)
    index, asked = impacts.write_index(d, n, total, shard_bytes=1500), impacts.questions(q)
    assert index.select("shard").distinct().count() > 5
    found = impacts.search(index, asked, impacts.weights(index, asked, n), 7, block_terms=9)
    assert sorted(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == sorted(brute(docs, items, 7))


@pytest.mark.parametrize("first", [1, 8, 10**6])
def test_stops_only_when_proven(first):
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 9))
        sums, groups = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 6))):
            docs = rng.permutation(n)[: int(rng.integers(1, n + 1))]
            gain = np.sort(rng.integers(1, 12, len(docs)))[::-1]
            sums[docs] += gain
            at = words.starts(gain)
            groups.append((gain[at[:-1]].astype(np.int64), at, docs.astype(np.uint32)))
        chosen, score = impacts.best(groups, n, k, first)
        assert (sums[chosen] == score).all()
        rank = lambda c: sorted((-int(sums[i]), int(i)) for i in c if sums[i] > 0)[:k]
        assert rank(chosen) == rank(range(n))


def test_words_are_the_same_in_chunks_of_any_size():
    texts = ["", None, "a b. c", "é漢 x" * 9, "q" * 50, "..a..", " A b "]
    table = words.kinds(b" ", b".")
    whole = None
    for size in (1, 2, 7, 1 << 20):
        got = [(int(r), w.vocabulary[int(c)].as_py()) for w in words.words(pa.array(texts), table, size) for c, r in zip(w.codes, w.rows)]
        whole = whole or got
        assert got == whole
        assert words.counts(pa.array(texts), table, size).tolist() == [sum(1 for r, _ in whole if r == k) for k in range(len(texts))]
