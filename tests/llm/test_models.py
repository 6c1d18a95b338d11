"""Language network and quality discriminant: gradients, held-out accuracy, empty and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import langid, quality

FOLDER = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    plan = langid.Plan(hidden=3, seed=2)
    net = langid.Network(["a", "b", "c"], plan)
    for c in net.cells:
        c.inputs, c.states = c.inputs.astype(np.float64), c.states.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 102, (6, 4)), np.array([0, 1, 2, 1])

    def loss():
        p = net.label(x.astype(np.uint8)).astype(np.float64)
        return -np.log(p[:, y, np.arange(4)]).mean()

    for w, g in zip(net.weights(), net.gradients(x, y), strict=True):
        flat = np.argsort(-np.abs(g), axis=None)[:4]
        for i in flat:
            at = np.unravel_index(i, w.shape)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.03, abs=1e-4)


def test_pooling_covers_every_byte():
    net = langid.Network(["a", "b"], langid.Plan(window=16))
    texts = [b"x", b"y" * 16, b"some longer text than one window", b"z" * 33]
    shares, labels = net.pooled(texts, together=3)
    assert labels.sum(1).tolist() == [len(t) for t in texts]
    assert np.allclose(shares.sum(1), 1)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tested = langid.held_out(F.col("doc_id"), 4, 2)
    odd = spark.createDataFrame([(None, "und zwar nicht", None, "s", 1), (5_000_000, None, "en", "s", 1), (5_000_001, "", "en", "s", 1), (5_000_002, "123 !?", None, "s", 1), (5_000_003, "é" * 500, None, "s", 1)], docs.schema)
    every = docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    net = langid.fit(docs.where(~tested), langid.Plan(steps=120))
    got = langid.predict(every, net)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() + 5
    assert [rows[5_000_000 + i].lang_pred for i in range(3)] == ["und"] * 3 and rows[5_000_000].score == 0
    assert rows[5_000_003].lang_pred in net.langs and sum(rows[5_000_003].positions.values()) == 1000
    wanted = docs.where(tested).select("doc_id", "lang").collect()
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in wanted]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = every.withColumn("t", langid.predictor(net)(F.col("text"))).select("doc_id", "t.lang_pred").collect()
    assert all(rows[r.doc_id].lang_pred == r.lang_pred for r in kept)


def test_language_without_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert langid.predict(docs, None).collect()[0].lang_pred == "und"
    assert langid.predict(docs.limit(0), None).count() == 0


def test_quality_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    tested = langid.held_out(F.col("doc_id"), 5, 0)
    odd = spark.createDataFrame([(None, "no id"), (5_000_000, None), (5_000_001, ""), (5_000_002, "x" * 200_000)], "doc_id long, text string")
    feats = quality.features(docs.select("doc_id", "text").unionByName(odd).withColumn("x", F.lit(1)))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (99_999_999, 1, 0)], labels.schema))
    model = quality.fit(feats.where(~tested), more)
    rows = quality.score(feats, model).join(labels.where(langid.held_out(F.col("doc_id"), 5, 0)), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    scored = quality.score(feats, model).collect()
    assert len(scored) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    by_text = {r.doc_id: r.s for r in docs.select("doc_id", quality.scorer(model)(F.col("text")).alias("s")).collect()}
    assert all(by_text[r.doc_id] == pytest.approx(r.score) for r in scored if r.doc_id in by_text)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    d = 4
    parts = [rng.normal(size=(300, d)), rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + 2]
    n = np.array([300.0, 200.0])
    model = quality.Discriminant.from_sums(n, np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts]), 0.0, 0.0)
    x = rng.normal(size=(50, d))
    logs = []
    for p, k in zip(parts, n, strict=True):
        pooled = sum(m * np.cov(q.T, bias=True) for q, m in zip(parts, n, strict=True)) / n.sum()
        cov = np.cov(p.T, bias=True) + 1e-3 * np.diag(np.diag(pooled))
        diff = x - p.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(k / n.sum()))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    feats = quality.features(docs)
    assert {r.score for r in quality.score(feats, quality.fit(feats, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(feats, quality.fit(feats, one)).collect()} == {1.0}
    assert quality.score(quality.features(docs.limit(0)), quality.fit(feats, one)).count() == 0


def test_short_texts_are_not_judged_by_length():
    rnd = random.Random(0)
    x = quality.statistics(["", "a", "Some words."] + ["word " * rnd.randint(1, 50) for _ in range(5)])
    assert np.isfinite(x).all()
