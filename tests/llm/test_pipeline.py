"""The corpus pipeline, stage by stage, against brute force in Python with the same trained models."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import langid, quality
from flowspark.llm.chunktable import ByteRanks
from flowspark.session import cut_lineage
from test_sigtree import brute as near_brute

FOLDER = "/root/testdata/sf0.001"


CLASHES = ["_told", "told", "_score", "score", "_own", "own", "_chars", "chars", "_first", "first", "_id", "id", "_sha", "sha", "_hash", "hash", "row", "stay_id", "keep", "n", "class", "a.b", "lang_pred"]


def planted(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = [r.text for r in docs.orderBy("doc_id").limit(30).collect() if len(r.text) > 600]
    rows = [(1_000_000 + i, t, "en", "new", None) for i, t in enumerate(some)]  # exact copies
    rows += [(1_100_000 + i, t.replace(" ", "  "), "en", "new", 3) for i, t in enumerate(some[:5])]  # equal but for white space, longer
    rows += [(1_200_000 + i, t + " one more", None, None, 3) for i, t in enumerate(some[5:10])]  # near copies
    rows += [(1_300_000, None, "en", "x", 0), (1_300_001, "", None, "x", 0), (1_300_002, "12 34 !!", None, "x", 0), (None, some[0] + " no id", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return docs.withColumns({c: F.concat(F.lit(f"{c} "), F.xxhash64("doc_id", "text").cast("string")) for c in CLASHES})


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_stages_equal_brute_force(spark):
    docs = cut_lineage(planted(spark))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "exact copies", "near copies", "packing"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    # language
    net = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"), 4, 2)))
    want = []
    for doc, t in rows:
        if t and re.search(r"[^\W\d_]", t):
            share = net.pooled([t.encode()])[0][0]
            if share.max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
                want.append((doc, t))
    docs = step(spark, stages["language"], docs, want)
    rows = want

    # quality
    learned = docs.where(~langid.held_out(F.col("doc_id"), 5, 0))
    model = quality.fit(quality.features(learned), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = [(doc, t) for doc, t in rows if model.score(quality.statistics([t]))[0] >= corpus_pipeline.LEAST_QUALITY_SCORE]
    assert len(want) < len(rows)
    docs = step(spark, stages["quality"], docs, want)
    rows = want

    # exact copies
    best = {}
    for doc, t in rows:
        key = (-len(t), doc is None, doc or 0)
        if norm(t) not in best or key < best[norm(t)][0]:
            best[norm(t)] = (key, doc, t)
    want = [(doc, t) for _, doc, t in best.values()]
    assert len(want) < len(rows)
    docs = step(spark, stages["exact copies"], docs, want)
    rows = want

    # near copies
    least = {doc: c for doc, _, c in near_brute(rows, 5, 80, 100)}
    want = [(doc, t) for doc, t in rows if least[doc] == doc]
    assert len(want) < len(rows)
    docs = step(spark, stages["near copies"], docs, want)

    # packing
    pieces = stages["packing"](spark, docs, FOLDER).collect()
    enc = ByteRanks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for doc, t in want:
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == [*next(enc.encode([t])).tolist(), 0]


def step(spark, stage, docs, want):
    out = cut_lineage(stage(spark, docs, FOLDER))
    assert out.columns == docs.columns
    # each column of a row that stays has the value that it came with
    assert out.exceptAll(docs).count() == 0
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    return out


def test_near_copies_without_or_with_repeated_ids(spark):
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"]
    rows = [(None, texts[0]), (None, texts[0] + " x"), (None, texts[0] + " y")]  # near copies that all lack an id
    rows += [(None, texts[1]), (None, None), (None, "")]  # without links
    rows += [(4, texts[2]), (None, texts[2] + " x")]  # linked to a row with id
    rows += [(1, texts[3]), (6, texts[3] + " x"), (6, texts[4])]  # one id: a linked row and an unlinked one
    rows += [(8, texts[5]), (8, texts[5] + " x")]  # near copies of one id
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()]
    assert len(got) == 8 and set(got) <= set(rows)
    assert {(4, texts[2]), (1, texts[3]), (6, texts[4]), (None, texts[1]), (None, None), (None, "")} <= set(got)
    assert [i for i, t in got if t and t.startswith("a0 ")] == [None] and [i for i, t in got if t and t.startswith("f0 ")] == [8]


def test_stages_without_a_model(spark, tmp_path):
    texts = ["some words", "mots", "12 34 !!", "", None]
    for docs in ([(i, t, None) for i, t in enumerate(texts)], [(None, t, "en") for t in texts]):
        docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        assert sorted(r.text for r in corpus_pipeline.language(spark, docs, FOLDER).collect()) == ["mots", "some words"]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).count() == 20


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run_on_a_table(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
