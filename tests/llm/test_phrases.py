"""Collocations against brute force."""

import re
from collections import Counter

import numpy as np

from sparkloom.llm import phrases


def brute(docs, min_count=100, top=2000):
    per = {}
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        counts = per.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            counts.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in per.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = {q[i : i + k] for q, a in held.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if a >= f[q[i : i + k]]}
        rows = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(spark, docs, **more):
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], "lang string, text string, rank int, words string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(d, **more).collect())


def sample(n, seed=2, size=60):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", ", "]
    word = lambda x: ["The", "é漢", "of"][x] if x < 3 else f"w{x}"
    return [(["en", "de", None][i % 3], "".join(word(int(x) % 40) + marks[int(m)] for x, m in zip(rng.zipf(1.5, size), rng.integers(0, 9, size)))) for i in range(n)]


def test_against_brute_force(spark):
    docs = sample(300) + [("en", None), ("en", ""), ("und", "the of the of"), ("en", "ha " * 500), ("en", "a b c d e f g\n" * 120), ("fr", "x y"), ("en", "\x00q r " * 130)]
    assert run(spark, docs, min_count=20) == brute(docs, 20)
    assert run(spark, docs, min_count=20, n=5) == brute(docs, 20, 5)


def test_hot_words_are_dealt_by_more_of_the_suffix(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKETS", 400)
    docs = sample(300, 4) + [("en", "hot pair " * 40 + f"w{i} hot pair w{i % 7}") for i in range(90)]
    assert run(spark, docs, min_count=20) == brute(docs, 20)


def test_more_words_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SENT_WORDS", 3)
    docs = sample(200, 9)
    assert run(spark, docs, min_count=20) == brute(docs, 20)


def test_small_slices_and_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STEP_BYTES", 300)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 900)
    monkeypatch.setattr(phrases, "PART_ROWS", 37)
    docs = sample(60, 6, 400)
    assert run(spark, docs, min_count=20) == brute(docs, 20)


def test_empty_tables_and_ties(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, "..")]) == []
    docs = [("en", "\n".join(pair for pair in ["xb y", "xa y", "xé y"] for _ in range(7)))]
    assert run(spark, docs, min_count=5) == brute(docs, 5)


def test_depth_of_dealing():
    rows = np.array([[1, 2, 3, 0, 0], [9, 2, 3, 0, 0], [9, 8, 1, 0, 0], [9, 8, 9, 8, 9], [9, 8, 0, 0, 0]], np.uint32)
    assert phrases.depth(rows, np.array([8, 9], np.uint32)).tolist() == [1, 2, 3, 5, 3]
