import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa

from sparkloom.llm import jaccard


def brute(rows, n=5):
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)


def test_groups_of_near_copies(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(46)]
    rows, i = [], 0
    for _ in range(8):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(2, 40)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randrange(1, 12))]
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(30):  # a passage that many share, with tails of all lengths
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randrange(0, 14))])))
        i += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(30000))
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " x"), (9, "a a a a a a a"), (10, "a a a a a"), (-3, "É one"), (0, "é one")])


def test_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b", "z")], "doc_id long, text string, n_shingles string")
    found = sorted(map(tuple, jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert found == [(1, 2, 1), (1, 2, 1), (None, 1, None)]
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_a_slice_costs_the_same_however_many_ranges_there_are():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)) for _ in range(500)]
    shared = sets[0][5]
    sets = [np.unique(np.append(s, shared)) for s in sets]
    ids = np.arange(500, dtype=np.int64)
    seconds = {}
    for bits in (10, 24):
        began = time.perf_counter()
        elements, about = list(jaccard._packs(ids, sets, [len(s) for s in sets], bits))
        seconds[bits] = time.perf_counter() - began
        distinct = np.unique(np.concatenate(sets))
        assert elements.num_rows == len(np.unique(distinct >> np.uint64(64 - bits))) and about.num_rows == 1
        tables = pa.Table.from_batches([elements])
        assert jaccard._joined(tables.column("tokens"), np.uint64).tolist() == distinct.tolist()
        counts = jaccard._joined(tables.column("counts"), np.uint32)
        # the element that all hold is sent once, without owners
        assert counts.sum() == sum(map(len, sets)) and len(jaccard._joined(tables.column("owners"), np.int64)) == (counts == 1).sum()
        settled = jaccard._joined(pa.Table.from_batches([about]).column("settled"), np.int64)
        assert (settled >= 1).all()
    assert seconds[24] < 10 * seconds[10] + 0.5


def test_an_element_that_a_third_of_the_sets_hold(spark):
    rng = random.Random(5)
    word = lambda: str(rng.randrange(10**6))
    passage = [word() for _ in range(20)]
    rows = [(i, " ".join((passage if i % 3 == 0 else []) + [word() for _ in range(rng.randrange(4, 40))])) for i in range(120)]
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(rng.randrange(0, 5))])) for i in range(60)]
    check(spark, rows)


def test_a_long_chain_is_one_component(spark):
    # each text is linked with the next alone: a window that moves by a tenth of its shingles
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 104])) for i in range(150)]
    check(spark, rows)
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    assert {r["component"] for r in jaccard.components(edges).collect()} == {0}
