import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import language, queries

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    found = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.where("lang = lang_pred").count(), found.count()
    assert n > 20 and right >= 0.95 * n


def brute(scores, switch):
    n, k = scores.shape
    best = max(product(range(k), repeat=n), key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, s] for i, s in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 7, 3, 0, 6]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    for switch in (0.5, 2.0, 50.0):
        labels = language.viterbi(scores, offsets, switch)
        for s, e in zip(offsets, offsets[1:]):
            if e > s:
                p = labels[s:e]
                value = sum(scores[s + i, x] for i, x in enumerate(p)) - switch * np.count_nonzero(np.diff(p.astype(int)))
                assert abs(value - brute(scores[s:e], switch)) < 1e-3


def test_features_of_words():
    names = pa.array(["ab", "é", "漢字"])
    hashed, starts, sizes, scripts = language.features(names)
    assert starts.tolist() == [0, 2, 4] and sizes.tolist() == [2, 2, 6] and len(hashed) == 10 and scripts.tolist() == [1, 1, 15]
    alone = language.features(pa.array(["é"]))[0]
    assert hashed[2:4].tolist() == alone.tolist()


def test_spans_and_odd_rows(spark):
    en, fr, ru = "the house and the garden with the water", "la maison et le jardin avec leau", "дом и сад и вода"
    rows = [(i, t, lang, "z") for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    assert model.languages == ["en", "fr", "ru"]
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, f"{en} {ru} {fr}"), (None, en), (5, "漢字"), (6, en), (6, en), (7, f"{en} " * 5000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang_pred": F.lit("z"), "row": F.lit("z"), "spans": F.lit("z")})
    found = language.identified(docs, model, switch=4.0).collect()
    by = {(r["row"]["doc_id"]): r for r in found}
    assert len(found) == len(odd) and by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[3]["score"] == 0
    assert [s["lang"] for s in by[4]["spans"]] == ["en", "ru", "fr"] and by[4]["spans"][0]["last"] == 7
    assert by[None]["lang_pred"] == by[6]["lang_pred"] == by[7]["lang_pred"] == "en" and by[5]["lang_pred"] in model.languages
    assert by[1]["row"]["lang_pred"] == "z"
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identified(docs, none).collect()} == {"und"}
    assert language.identified(docs.limit(0), model).count() == 0


def test_shares_count_letters_and_the_query_is_as_by_hand(spark, tmp_path):
    rows = [(i, t, l, "s") for i, (t, l) in enumerate([("the house and the garden are old", "en"), ("der Hund und die Katze sind alt", "de"), ("кошка и собака живут дома", "ru")] * 8)]
    rows += [(100, "the house кошка", None, "s"), (101, None, None, "s"), (102, "12 34", None, "s"), (103, "und die кошка и собака and the garden", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, str(tmp_path)).collect()}
    model = language.fit(language.learning_rows(docs))
    for i, t, _, _ in rows:
        ws = re.findall(r"[^\W\d_]+", (t or "").lower())
        held_out = zlib.crc32(str(i).encode()) % 3 == 1
        if not ws:
            expected = ("und", 0.0)
        else:
            scores, _ = language.word_scores(pa.array(ws), model)
            best = max(product(range(len(model.languages)), repeat=len(ws)), key=lambda p: sum(scores[k][s] for k, s in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
            letters = [sum(len(w) for w, s in zip(ws, best) if s == k) for k in range(len(model.languages))]
            top = max(range(len(letters)), key=lambda k: letters[k])
            expected = (model.languages[top], letters[top] / sum(letters))
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (expected[0], held_out) and abs(got[i]["score"] - expected[1]) < 1e-9
    assert abs(got[100]["score"] - 8 / 13) < 1e-9


def test_workers_get_texts_alone(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("der Hund und die Katze", "de"), ("12 34", None), (None, None)] * 8)]
    # Arrow has no type for such intervals, so a row that went through a worker would fail
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("age", F.expr("make_interval(0, doc_id)"))
    model = language.fit(language.learning_rows(docs))
    found = language.identified(docs, model)
    got = {r["doc_id"]: r for r in found.select("row.*", "lang_pred", "score", "spans").where("lang_pred <> 'und' and score > 0.5").withColumn("age", F.col("age").cast("string")).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: lang for i, _, lang in rows if lang} and got[5]["age"] == "5 months" and got[5]["spans"]
    plan = found.where("lang_pred <> 'und'").select("spans")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("found(text") == 1
    kept = language.kept(docs)
    assert kept.columns == docs.columns and kept.count() == 16
