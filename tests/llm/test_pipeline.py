"""The pipeline's stages against what each is to do, on a small table with planted cases."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import mixing, store
from tests.llm.test_jaccard import brute


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {r["doc_id"]: r for r in docs.collect()}
    some = list(held.values())
    plant = [(90001, some[0]["text"], "en", "srcX", 1), (90002, some[0]["text"] + " again", "en", "srcX", 1), (90003, "12 34", "en", "srcX", 5), (90004, None, None, None, None), (90005, "", "en", "srcX", 0)]
    docs = docs.union(spark.createDataFrame(plant, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "mixing", "packing"]
    at, seen = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        at = store.saved(stage(spark, at, "/root/testdata/sf0.001"), name)
        seen.append(at)
        if name != "packing":
            assert at.columns == docs.columns
    kept = {r["doc_id"] for r in seen[1].collect()}
    assert kept == set(held) | {90001, 90002}
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    groups = brute(rows)
    assert {r["doc_id"] for r in seen[2].collect()} == {i for i, (_, c) in groups.items() if c == i}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(seen[2]).collect()}
    got = {r["doc_id"]: r["count"] for r in seen[3].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}
    packed = seen[4].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert {r["doc_id"] for r in packed} == set(got)
    again = corpus_pipeline.one_of_each_group(spark, seen[1].union(seen[1]), "")
    assert again.count() == seen[2].count()


def rows(spark, held):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in held], "doc_id long, text string, lang string, source string, n_chars long")


def test_repeated_and_missing_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    held = [(5, a), (5, b), (3, a), (None, b + " more"), (None, c), (None, c), (7, None), (7, ""), (9, "short")]
    got = corpus_pipeline.one_of_each_group(spark, rows(spark, held), "").collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted([(3, a), (5, b), (None, c), (7, None), (7, ""), (9, "short")], key=key)


def test_stages_take_empty_tables_and_very_long_texts(spark):
    long = " ".join(f"the word{k % 5000}" for k in range(60000))
    empty = rows(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    docs = rows(spark, [(1, long), (2, long + " end"), (3, "the few words")])
    for name, stage in corpus_pipeline.STAGES:
        docs = store.saved(stage(spark, docs, ""), name)
    assert {r["doc_id"] for r in docs.collect()} <= {1, 3}


def test_run_is_its_stages(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = store.saved(stage(spark, docs, str(tmp_path)), "stage")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select(key)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.select(key).collect())) and got.count() > 0


def test_workers_get_a_few_mib_at_once(spark):
    docs = rows(spark, [(i, None) for i in range(30)]).coalesce(1).withColumn("text", F.repeat(F.lit("the word "), 120_000))
    sizes = lambda: [r["n"] for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    before = spark.conf.get(store.BATCH_BYTES, None)
    try:
        for _, stage in [corpus_pipeline.STAGES[i] for i in (0, 1, 3)]:
            spark.conf.unset(store.BATCH_BYTES)
            stage(spark, rows(spark, [(1, "a word")]), "")
            assert max(sizes()) < 6 << 20
        # a session's own choice holds
        spark.conf.set(store.BATCH_BYTES, str(20 << 20))
        corpus_pipeline.by_language(spark, rows(spark, [(1, "a word")]), "")
        assert max(sizes()) > 16 << 20
    finally:
        spark.conf.set(store.BATCH_BYTES, before) if before else spark.conf.unset(store.BATCH_BYTES)
