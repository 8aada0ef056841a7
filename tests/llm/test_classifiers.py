import numpy as np
from pyspark.sql import functions as F

from crowdtide.llm import language_id, toxicity
from tests.llm.helpers import DOCS, documents, sentence

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def toxic_corpus(n=400):
    rng = np.random.default_rng(11)
    texts, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = sentence(rng, 40).split()
        if bad:
            for at in rng.choice(40, 3, replace=False):
                text[at] = ["Nasty", "VILE", "rotten"][rng.integers(0, 3)]
        texts.append(" ".join(text))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity_on_held_out_documents(spark):
    texts, labels = toxic_corpus()
    extra = [None, "", "vile " * 5000, (3, "w1 vile"), (None, "vile rotten nasty"), (None, None)]
    docs = documents(spark, [*texts, *extra]).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (1, 0, 0)], LABELS)
    got = toxicity.scored(docs, marks)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "held_out", "score", "predicted"]
    rows = got.collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400 and r["text"] == texts[r["doc_id"]]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows) and len(rows) == 406
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1 and all(r["predicted"] == 1 for r in rows if r["text"] == "vile rotten nasty")
    assert next(r["score"] for r in rows if r["text"] == extra[2]) > 2 * empty.pop()


def test_labels_of_held_out_rows_are_not_learned(spark):
    texts, labels = toxic_corpus(100)
    docs, held = documents(spark, texts), {r[0] for r in documents(spark, texts).where(toxicity.fold("doc_id", 5) == 0).select("doc_id").collect()}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.scored(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_without_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.scored(spark.createDataFrame([], DOCS), none).count() == 0
    assert {r["score"] for r in toxicity.scored(documents(spark, ["a b", None]), none).collect()} == {0.5}


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    examples = [np.unique(np.append(rng.integers(10, 1000, 30), [3] if i % 2 else [])).astype(np.int64) for i in range(600)]
    bias, places, weights = toxicity.ftrl(examples, np.arange(600) % 2 * 1.0)
    assert len(places) < 100 and weights[places == 3][0] > 2


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify_language(docs.withColumn("score", F.lit(1)).withColumn("held_out", F.lit(1))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["der", "und", "nicht", "über"] if i % 2 else ["the", "and", "with", "over"], 12)), "de" if i % 2 else "en") for i in range(120)]
    texts += [(200, None, "en"), (201, "", "de"), (202, "12 ... 34 !?", "en"), (203, "und nicht", None), (None, "the and with", "en"), (204, "日本語", None), (7, texts[7][1], "de"), (205, "und der " * 20_000, None)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in texts], DOCS)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs).collect()}
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None, 205)] == ["und", "und", "und", "de", "en", "de"]
    assert got[200]["score"] == 0 and got[204]["lang_pred"] in ("de", "en") and got[204]["rejected"] and not got[203]["rejected"] is None
    assert all(r["lang_pred"] == ("de" if i % 2 else "en") for i, r in got.items() if i is not None and i < 120)


def test_language_without_rows(spark):
    assert language_id.identify_language(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, ["text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify_language(docs).collect()} == {("und", 0.0)}
