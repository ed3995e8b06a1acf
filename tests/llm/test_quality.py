import numpy as np
from corpusloom.llm.quality import CoTrained, cotrain, keep_good, meta_features, meta_numbers, op10_cotraining_quality, score_quality, taught_sums, text_features, train
from corpusloom.llm.words import texts_of
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, lang string, n_chars int, score string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(docs, labels.where("doc_id % 3 <> 0"))
    scored = score_quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    right = scored.kept == (scored.quality == 1)
    assert right.mean() > 0.95 and right[scored.quality == 1].mean() > 0.97, (right.mean(), right[scored.quality == 1].mean())
    assert abs(scored.score.mean() - scored.quality.mean()) < 0.1


def test_pseudo_labels_help_the_other_view():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).astype(float)
    a, b = y[:, None] * 3 + rng.normal(size=(4000, 2)), y[:, None] * 2 + rng.normal(size=(4000, 40))
    alone = cotrain(a[:100], b[:100], y[:100], None, 0, 3)
    taught = cotrain(a[:100], b[:100], y[:100], lambda *views: taught_sums((a[100:2000], b[100:2000]), *views, 0.95), 3, 3)
    right = lambda m: (((m.meta.logit(b[2000:]) > 0) == (y[2000:] > 0))).mean()
    assert right(taught) >= right(alone)


def test_all_other_documents_teach(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = train(docs.repartition(5), labels, labelled_rows=120, confident=0.9)
    rows = docs.orderBy("doc_id").toArrow()
    x = text_features(texts_of(rows["text"])).astype(np.float32).astype(np.float64), meta_features(meta_numbers(*(rows[c].to_pylist() for c in ("source", "lang", "n_chars"))))
    order = [r.doc_id for r in labels.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(120).collect()]
    quality = {r.doc_id: r.quality for r in labels.collect()}
    ids = rows["doc_id"].to_pylist()
    mine = np.array([i in set(order) for i in ids])
    y = np.array([quality[i] for i in ids if i in set(order)], float)
    want = cotrain(x[0][mine], x[1][mine], y, lambda *views: taught_sums((x[0][~mine], x[1][~mine]), *views, 0.9), 2, 3)
    for a, b in ((model.text, want.text), (model.meta, want.meta), (model.both, want.both)):
        assert np.allclose(a.weights, b.weights, atol=1e-4)
    one = score_quality(docs, model).orderBy("doc_id").toPandas()
    logits = np.c_[want.text.logit(x[0]), want.meta.logit(x[1])]
    assert np.allclose(one.score, 1 / (1 + np.exp(-want.both.logit(logits))), atol=1e-3)
    assert not np.allclose(want.text.weights, cotrain(x[0][mine], x[1][mine], y, None, 0, 3).text.weights, atol=1e-3)


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = [(1, None, None, None, None, "x"), (2, "", "s", "en", 0, "x"), (3, "w" * 200_000, "s", "en", -1, None), (None, "a b", "s", "en", 3, None), (4, "a", "s", "en", 1, ""), (4, "a", "s", "en", 1, "")]
    df = spark.createDataFrame(rows, DOCS)
    out = score_quality(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert keep_good(df, model, 0.0).columns == df.columns and keep_good(df, model, 0.0).count() == 6
    assert score_quality(df, CoTrained(None, None)).where("kept").count() == 6
    empty = spark.createDataFrame([], DOCS)
    none = train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.text is None and score_quality(empty, none).collect() == []


def test_query_scores_every_document(spark):
    out = op10_cotraining_quality(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and out.count() == docs.count()
    assert out.where(F.col("kept") != (F.col("score") >= 0.5)).isEmpty()
