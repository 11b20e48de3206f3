"""Null, empty, repeated and very long rows, empty tables and clashing columns, for every operator."""

import gzip
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licenses, media, mixing, packing, shards, store, token_files, tokens, warc, winnowing

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
ROWS = [(5, "Hello world, hello!", "en", "b"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (None, "no id here", "de", "a"), (7, LONG, "en", "b"), (8, "é 漢字 😀", None, "b"), (9, "tie tie", "en", "a"), (10, "tie tie", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with the operators' own
    extra = {c: F.lit("z") for c in ("n_chars", "size", "part", "ids", "dir", "rank", "bucket", "copies", "row")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).repartition(3)


def ids_of(text, end):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs):
    path = store.new_path(spark, "t")
    token_files.write_files(docs, path, parts=3)
    found = [(r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read_files(spark, path).collect()]
    found.sort()
    assert [f[1] for f in found] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert Counter((i, tuple(x)) for _, i, x in found) == Counter((r[0], tuple(ids_of(r[1], 2))) for r in ROWS)
    at = 0
    for start, _, x in found:
        assert start == at
        at += len(x)
    path = store.new_path(spark, "t")
    token_files.write_files(docs.limit(0), path)
    assert token_files.read_files(spark, path).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 70000, 1 << 31])
def test_streams(top):
    rng = np.random.default_rng(top)
    sizes = np.array([0, 1, 3, 4, 5, 0, 1000])
    values = rng.integers(0, top, sizes.sum(), dtype=np.uint32)
    control, data = token_files.encode_streams(values, sizes)
    assert token_files.decode_streams(b"".join(control), b"".join(data), sizes).tolist() == values.tolist()


def test_packing(spark, docs):
    found = packing.packed(docs, capacity=64).collect()
    assert packing.packed(docs.limit(0)).count() == 0
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    whole = [ids_of(r[1], 0) for r in ROWS]
    assert sum(r["length"] for r in found) == sum(map(len, whole))
    assert Counter((r["piece"], r["ids_crc32"]) for r in found) == Counter((k, crc(x[k * 64 : k * 64 + 64])) for x in whole for k in range(-(-len(x) // 64)))


def test_plan_fills_exactly():
    counts = np.zeros(101, np.int64)
    for x, n in {60: 5, 40: 3, 20: 8, 33: 3, 34: 1, 7: 2, 100: 4}.items():
        counts[x] = n
    done = packing.plan(counts, 100)
    used = Counter()
    for times, lengths in done:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == Counter({x: int(counts[x]) for x in np.flatnonzero(counts).tolist()})
    total = int((np.arange(101) * counts).sum())
    assert sum(t for t, _ in done) <= -(-total // 100) + 1


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(spark, docs):
    found = mixing.mixed(docs).collect()
    assert sorted(r["size"] for r in found) == sorted(words(r[1]) for r in ROWS) and len(found) == len(ROWS)
    per = {}
    for i, t, _, s in ROWS:
        per[s] = per.get(s, 0) + words(t)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, (1, 2, 3)))
    target, open_ = {}, set(names)
    while True:
        rest = sum(per.values()) - sum(3 * per[s] for s in names if s not in open_)
        target = {s: rest * weights[s] / sum(weights[x] for x in open_) if s in open_ else 3 * per[s] for s in names}
        over = {s for s in open_ if target[s] > 3 * per[s]}
        if not over:
            break
        open_ -= over
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == per[r["source"]] and 0 <= r["copies"] <= 3
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixed(docs.limit(0)).count() == 0
    out = mixing.emitted(docs)
    assert out.columns == docs.columns and out.count() >= sum(r["copies"] for r in found if r["doc_id"] != 3)


def mixed_rows(spark, n):
    return spark.range(n).selectExpr("id AS doc_id", "repeat('w ', CAST(pow(id % 37, 2) AS INT) + 1) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")


def test_shares_come_near_their_targets(spark):
    found = mixing.mixed(mixed_rows(spark, 6000))
    fraction = F.col("target") / F.col("source_size") % 1
    spread = F.sqrt(F.sum(F.col("size") ** 2 * fraction * (1 - fraction)))
    sums = found.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), spread.alias("spread")).collect()
    # the deviation that independent draws have
    assert all(abs(r["taken"] - r["target"]) <= 4 * r["spread"] + 1e-6 for r in sums)
    assert all(abs(r["taken"] / r["target"] - 1) < 0.15 for r in sums)


def test_a_new_row_changes_no_other_draw(spark):
    rows = mixed_rows(spark, 3000)
    one = spark.createDataFrame([(90000, "a b c", "hot")], rows.schema)
    before = {r["doc_id"]: r for r in mixing.mixed(rows).collect()}
    after = {r["doc_id"]: r for r in mixing.mixed(rows.union(one)).collect()}
    draws = {r["doc_id"]: r["u"] for r in rows.select("doc_id", mixing.draw(F.col("doc_id"), F.col("text"), 7).alias("u")).collect()}
    for i, b in before.items():
        a = after[i]
        fractions = sorted(r["target"] / r["source_size"] % 1 for r in (a, b))
        assert a["copies"] == b["copies"] or fractions[0] <= draws[i] <= fractions[1]


def test_draws_are_even(spark):
    u = sorted(r[0] for r in spark.range(4000).select(mixing.draw(F.col("id"), F.lit(None).cast("string"), 7)).collect())
    assert max(abs(x - (i + 0.5) / 4000) for i, x in enumerate(u)) < 0.03 and 0 <= u[0] and u[-1] < 1


def test_shards(spark, docs):
    found = shards.sharded(docs, 5).collect()
    assert len(found) == len(ROWS) and shards.sharded(docs.limit(0), 5).count() == 0
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_shards_are_even_with_a_hot_source(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS INT) * 3) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "'en' AS lang")
    sums = [r["b"] for r in shards.sharded(rows, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and max(sums) / min(sums) < 1.02


def test_repeated_rows_are_cut(spark):
    half = "id < 2000"
    rows = spark.range(4000).selectExpr(f"IF({half}, 1, id) AS doc_id", f"IF({half}, repeat('a', 50), repeat('x', CAST(id % 50 AS INT) * 3)) AS text", "'s' AS source", "'en' AS lang")
    sums = [r["b"] for r in shards.sharded(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) / min(sums) < 1.02


def test_tree_cuts_the_widest_dimension_at_the_weighted_median(spark):
    rows = spark.range(999).selectExpr("id AS doc_id", "repeat('x', CAST(1 + id % 7 AS INT)) AS text", "'s' AS source", "'en' AS lang")
    facts = store.saved(shards.document_rows(rows).drop("row"), "facts")
    ends = shards.spans(facts)
    ((d, cut, right),) = shards.tree(shards.keyed(facts, ends), 2)[0].values()
    held = [(r["doc_id"], r["size"]) for r in facts.collect()]
    total, place = sum(n for _, n in held), (cut >> shards.HASH_BITS + shards.PLACE_BITS) / ((1 << shards.COORDINATE_BITS) - 1)
    # all dimensions with an extent are scaled to the same width, so the first of them is cut: sizes
    assert d == "d0" and right == 1
    lo, hi = ends["d0"]
    below = sum(n for _, n in held if (np.log2(n) - lo) / (hi - lo) < place - 1e-6)
    at = sum(n for _, n in held if abs((np.log2(n) - lo) / (hi - lo) - place) <= 1e-6)
    assert below <= total / 2 <= below + at


def test_a_thousand_shards(spark):
    rows = spark.range(40000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 90 AS INT)) AS text", "concat('s', id % 7) AS source", "'en' AS lang")
    began = time.perf_counter()
    sums = [r["b"] for r in shards.sharded(rows, 1000).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 1000 and max(sums) / min(sums) < 1.2 and time.perf_counter() - began < 120


def test_shards_hold_the_texts(spark, docs):
    path = shards.write_shards(docs, 3)
    held = shards.read_shards(spark, path, docs).select("row.*").collect()
    assert Counter(map(str, held)) == Counter(map(str, docs.collect()))


PAGES = [(1, "http://a/x", "<p>" + "same " * 40), (2, "http://b/y\r\nX: 1", "<p>" + "same " * 40), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "<p>" + "same " * 40), (1, "http://a/x", "<p>" + "same " * 40), (9, "ü", "é" * 300000)]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("z")).repartition(2)
    directory = store.new_path(spark, "w")
    index = warc.write_archives(warc.with_revisits(pages), directory, file_bytes=600)
    assert index.select("file").distinct().count() > 2
    found = warc.read_records(index, directory).collect()
    expected = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        refers = 1 if b.startswith(b"<p>same") and i != 1 else None
        expected[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in found) == expected
    some = warc.read_records(index.where("page_id = 9"), directory).collect()
    assert len(some) == 1 and bytes(some[0]["payload"]).decode() == "é" * 300000
    empty = store.new_path(spark, "w")
    assert warc.read_records(warc.write_archives(warc.with_revisits(pages.limit(0)), empty), empty).count() == 0


def test_records_of_archives_have_ids_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(i % 3 or None, "u", "same html " * 20) for i in range(9)], "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w")
    ids, referred = [], []
    for name in (tmp_path / "w").iterdir():
        records = gzip.decompress(name.read_bytes()).split(b"WARC/1.1\r\n")[1:]
        assert b"WARC-Type: warcinfo" in records[0]
        ids += [re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records]
        referred += [m[1] for r in records if (m := re.search(rb"WARC-Refers-To: (\S+)", r))]
    assert index.count() == 9 and len(ids) == len(set(ids)) == 9 + len(list((tmp_path / "w").iterdir()))
    # page 1 comes three times: its rows are responses, all else are revisits of one record that is there
    assert len(referred) == 6 and len(set(referred)) == 1 and set(referred) <= set(ids)


def test_directories_as_spark_names_them():
    assert warc.store_of("file:///a/b")[1] == "/a/b" and warc.store_of("dbfs:/a/b")[1] == "/dbfs/a/b"
    assert warc.store_of("s3a://bucket/a?region=us-east-1")[1] == "bucket/a"
    with pytest.raises(ValueError):
        warc.store_of("viewfs://x/y")


def test_ranges_are_joined_up_to_a_limit():
    near, far = warc.GAP_BYTES, warc.READ_BYTES
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + near + 1, 5), ("a", far + near, 9), ("b", 0, far * 2)]
    assert [(f, s, e, len(h)) for f, s, e, h in warc.ranges(rows)] == [("a", 0, 20, 2), ("a", 21 + near, 26 + near, 1), ("a", far + near, far + near + 9, 1), ("b", 0, far * 2, 1)]


def test_damaged_records_are_found():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_media(spark, docs):
    found = media.digests(media.pcm_blocks(store.saved(media.as_media(docs), "m"))).collect()
    expected = Counter()
    for i, t, _, _ in ROWS:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        expected[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == expected
    assert media.digests(media.pcm_blocks(media.as_media(docs.limit(0)))).count() == 0


def py_fingerprint(text, k=5, w=8):
    """Kept (hash, position) pairs by the definition; hashes are ranks of runs, so only equality is compared."""
    ws = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    return [] if ws == [""] else [tuple(ws)] if len(ws) < k else [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def test_winnowing(spark, docs):
    rows = winnowing.with_edited(winnowing.with_next(docs, parts=4)).collect()
    order = sorted(((i, t or "") for i, t, _, _ in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    nexts = Counter()
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        nexts[i, t, t[: len(t) - h] + n[:h]] += 1
    assert Counter((r["doc_id"], r["text"], r["edited"]) for r in rows) == nexts
    for r in rows:
        grams = py_fingerprint(r["text"])
        kept = [(v >> 31, winnowing.PLACES - (v & winnowing.PLACES)) for v in r["fp"]]
        assert bool(kept) == bool(grams)
        if grams:
            places = [p for _, p in kept]
            assert places == sorted(set(places)) and places[-1] < len(grams)
            # every window of W grams keeps one of its own
            for s in range(max(1, len(grams) - winnowing.W + 1)):
                assert any(s <= p < s + winnowing.W for p in places)
            same = {}
            for h, p in kept:
                assert same.setdefault(grams[p], h) == h
    found = winnowing.fingerprinted(docs).collect()
    assert len(found) == len(ROWS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (9, 10)}) == 1
    assert winnowing.fingerprinted(docs.limit(0)).count() == 0


def test_winnowing_keeps_the_least_of_every_window(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (1, 4, 5, 6, 12, 13, 31, 32, 33, 36, 37, 38, 64, 69, 70, 500)] + ["漢字" * 40, "x" * 24 + " " + "y" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    k, w, p = winnowing.K, winnowing.W, winnowing.P
    rows = df.select("t", F.transform(winnowing.units(F.col("t")), lambda x: F.pmod(F.xxhash64(x), F.lit(p))).alias("h"), winnowing.fingerprint(F.col("t")).alias("fp")).collect()
    assert {len(r["h"]) for r in rows if "漢" in r["t"]} == {80} and {len(r["h"]) for r in rows if "xy"[1] * 25 in r["t"]} == {26}
    for r in rows:
        if len(r["h"]) < k:
            assert len(r["fp"]) == 1
            continue
        grams = []
        for i in range(len(r["h"]) - k + 1):
            v = 0
            for x in r["h"][i : i + k]:
                v = (v * winnowing.BASE + x) % p
            grams.append(v << 31 | winnowing.PLACES - i)
        expected = [min(grams)] if len(grams) <= w else list(dict.fromkeys(min(grams[i : i + w]) for i in range(len(grams) - w + 1)))
        assert r["fp"] == expected


def test_likeness_of_neighbours(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(40 + i))) for i in range(10)]
    found = {r["doc_id"]: r for r in winnowing.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {i: {x.split("@")[0] for x in r["fingerprint"].split()} for i, r in found.items()}
    for i, r in found.items():
        other = kept[i - 1 if i else 9]
        assert r["near_next"] == pytest.approx(len(kept[i] & other) / len(kept[i] | other))
        edited = {x.split("@")[0] for x in r["edited_fingerprint"].split()}
        assert r["near_edited"] == pytest.approx(len(kept[i] & edited) / len(kept[i] | edited))


def test_rightmost_of_ties(spark):
    r = spark.createDataFrame([("a " * 30,)], "t string").select(winnowing.fingerprint(F.col("t")).alias("f")).first()["f"]
    # all grams are equal, so each window keeps its last place
    assert [winnowing.PLACES - (v & winnowing.PLACES) for v in r] == list(range(7, 26))


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    prose = " ".join(f"word{i}" for i in range(200))
    files = [
        ("r/LICENSE", apache), ("r/a.py", prose), ("r/s/t/b.py", f"{prose}\n{mit}\n{prose}"), ("r/s/COPYING.md", mit), ("r/s/t/c.py", ""), ("r/s/t/d.py", None),
        ("q/e.py", prose), (None, None), ("top.py", f"{prose} the license of the software is free"), ("r/one.py", f"{prose} {apache} {prose}"), ("r/u/v.txt", apache.upper()), ("r/u/w.py", prose), ("r/a.py", prose),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumns({"dir": F.lit("z"), "score": F.lit("z")}).drop("dir")
    got = [(r["path"], r["license"], r["origin"], r["licensed_dir"]) for r in licenses.inherited(licenses.scanned(df)).collect()]
    assert Counter(got) == Counter([
        ("r/LICENSE", "Apache-2.0", "own", None), ("r/a.py", "Apache-2.0", "inherited", "r"), ("r/s/t/b.py", "MIT", "own", None), ("r/s/COPYING.md", "MIT", "own", None), ("r/s/t/c.py", "MIT", "inherited", "r/s"), ("r/s/t/d.py", "MIT", "inherited", "r/s"),
        ("q/e.py", None, "none", None), (None, None, "none", None), ("top.py", None, "none", None), ("r/one.py", "Apache-2.0", "own", None), ("r/u/v.txt", "Apache-2.0", "own", None), ("r/u/w.py", "Apache-2.0", "inherited", "r/u"), ("r/a.py", "Apache-2.0", "inherited", "r"),
    ])
    assert licenses.inherited(licenses.scanned(df.limit(0))).count() == 0


def test_no_window_without_an_anchor_can_match():
    t = licenses.Templates()
    for i, (_, template) in enumerate(licenses.TEMPLATES):
        rest = sum(t.weights[w][i] ** 2 for w in set(licenses.words_of(template)) if w not in t.anchors)
        assert rest < licenses.THRESHOLD**2
    assert not set(t.anchors) & licenses.COMMON
