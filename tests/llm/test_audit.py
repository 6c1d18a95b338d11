"""Filter audit against brute force, over several micro-batches and runs."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from flowspark.llm import audit

SCHEMA = "doc_id long, text string, lang string, mask string, n int"
SAID = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order applied document by document, as the filters would be."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rank = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in rows:
        t = t or ""
        least[t] = min(least.get(t, (2, 0)), rank(i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search("[#$%&*|]", t) is not None, "E": rank(i) > least[t],
        }
        docs.append((part or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in own if f in d[1] and not d[1] & before]
                kept = sum(not d[1] & (before | {f}) for d in own)
                redundant = sum(f in d[1] and bool(d[1] & before) for d in own)
                out[part, "".join(order), step] = [kept, len(here), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def table():
    long = " ".join(f"word{i}" for i in range(120))
    same = " ".join(["word"] * 150)
    texts = [long, same, long.upper(), long + " # cost", "short", "", None, "SHORT & LOUD", "  \t\n ", long * 30]
    rows = []
    for i in range(160):
        rows.append((1000 - i, texts[i % 10], [None, "en", "de", ""][i % 4]))  # ids fall, so later files hold smaller ones
    rows += [(None, long, "en"), (None, long, "de"), (None, "only without id", "en"), (2**60 + 1, "two rows of one id", "en"), (2**60 + 1, "two rows of one id", "fr"), (2**60 + 2, "two rows of one id", "en")]
    rows += [(841, long, "de"), (841, long, None)]  # rows of one id, smallest of its text
    return rows, [(i, i % 2, i % 3 == 0) for i in range(841, 1001, 3)] + [(841, 0, 1), (841, None, None), (None, 1, 1), (2**60 + 1, 1, 0)]


def write(spark, rows, path, n):
    """The rows in order, one file for every n of them."""
    for k in range(0, len(rows), n):
        part = [(i, t, lang, "clash", 7) for i, t, lang in rows[k : k + n]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("batches", [1, 5])
def test_equals_brute_force(spark, tmp_path, batches):
    rows, said = table()
    write(spark, rows, f"{tmp_path}/d.parquet", 40)
    labels = spark.createDataFrame([(i, q, int(t) if t is not None else None) for i, q, t in said], SAID)
    got = told(audit.audit(spark, f"{tmp_path}/d.parquet", labels, audit.Plan(batches=batches), f"{tmp_path}/job"))
    assert got == brute(rows, said)
    assert len(got) == 4 * 600


def test_a_later_run_retracts(spark, tmp_path):
    """New files on the same folder, with smaller ids: the counters equal those of one run over all."""
    rows, said = table()
    labels = spark.createDataFrame([(i, q, int(t) if t is not None else None) for i, q, t in said], SAID)
    path, folder = f"{tmp_path}/d.parquet", f"{tmp_path}/job"
    write(spark, rows[:90], path, 30)
    assert told(audit.audit(spark, path, labels, folder=folder)) == brute(rows[:90], said)
    write(spark, rows[90:], path, 30)
    assert told(audit.audit(spark, path, labels, folder=folder)) == brute(rows, said)
    assert told(audit.audit(spark, path, labels, folder=folder)) == brute(rows, said)  # nothing new
    assert spark.read.parquet(f"{folder}/changes").where("n < 0").count() > 0


def test_a_lost_batch_is_run_again(spark, tmp_path, monkeypatch):
    """A micro-batch that fails after its rows and state are written, and its job is started again."""
    rows, said = table()
    labels = spark.createDataFrame([(i, q, int(t) if t is not None else None) for i, q, t in said], SAID)
    write(spark, rows, f"{tmp_path}/d.parquet", 40)
    whole, calls = audit.corrections, []

    def lost(changed, copy_bit):
        calls.append(changed.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return whole(changed, copy_bit)

    monkeypatch.setattr(audit, "corrections", lost)
    with pytest.raises(Exception, match="lost"):
        audit.audit(spark, f"{tmp_path}/d.parquet", labels, audit.Plan(batches=5), f"{tmp_path}/job")
    got = audit.audit(spark, f"{tmp_path}/d.parquet", labels, audit.Plan(batches=5), f"{tmp_path}/job")
    assert told(got) == brute(rows, said) and len(calls) == 6


def test_hot_text_and_ids_are_added_up_before_the_shuffle(spark):
    for doc in (F.col("id"), F.lit(None).cast("long"), F.lit(5).cast("long")):
        docs = spark.range(20_000).select(doc.alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
        rows = audit.masked(docs, audit.text_filters(), "doc_id", "text", "lang").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
        got = audit.holders(rows).collect()
        assert len(got) == 1 and sum(p.n for p in got[0].own) == (1 if "id" in doc._jc.toString() else 20_000)
    plan = audit.holders(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and plan.count("partial_") >= 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/d.parquet")
    labels = spark.createDataFrame([], SAID)
    got = audit.audit(spark, f"{tmp_path}/d.parquet", labels, folder=f"{tmp_path}/job")
    assert got.count() == 0 and "shapley" in got.columns
