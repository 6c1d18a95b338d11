"""Similarity joins against brute force over Python sets."""

import random
import re

import numpy as np
import pytest

from flowspark.llm import sigtree
from flowspark.llm.shingles import class_of, sets


def words_of(t):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingles(t, k):
    w = words_of(t)
    return frozenset({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def brute(rows, k, num, den):
    found = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and den * both >= num * len(found[i] | found[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = root(i)
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(found[i]), least.get(root(i)) if found[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    def edited(w, edits):
        w = list(w)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        return w

    passage = prose(60)
    bodies = [prose(rnd.randint(1, 120)) for _ in range(120)]
    bodies += [prose(rnd.randint(30, 90)) + passage for _ in range(90)]  # unrelated, with a passage in common
    family = prose(120)
    bodies += [edited(family, rnd.randint(0, 5)) for _ in range(150)]  # near copies, linked in parts
    chain = prose(150)
    for _ in range(30):
        chain = edited(chain, 3)
        bodies.append(chain)
    bodies += [passage + [f"v{i}"] for i in range(45)]
    texts = [" ".join(b) for b in bodies]
    texts += [t.upper().replace(" ", "\n ") for t in texts[:40]] + ["", None, " \t", "a", "A", "a b", "a  b\n", "a b c", "x " * 400, "x " * 500]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "only without id"), (7, texts[7]), (7, "another text of one id")]


@pytest.mark.parametrize(("k", "num", "den", "hot", "node"), [(4, 85, 100, None, None), (5, 80, 100, None, None), (4, 85, 100, 8, 4), (5, 80, 100, 40, 7)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, den, hot, node):
    """Also with most shingles dealt out one by one, and with trees of many nodes."""
    if hot:
        monkeypatch.setattr(sigtree, "HOT", hot)
        monkeypatch.setattr(sigtree, "SALTS", 2)
        monkeypatch.setattr(sigtree, "NODE", node)
    rows = corpus(k)
    df = spark.createDataFrame([(doc, t, 1, "c") for doc, t in rows], "doc_id long, text string, class int, n string").repartition(5)
    got = sorted([tuple(r) for r in sigtree.near_duplicates(df, k, num, den).collect()], key=str)
    assert got == brute(rows, k, num, den)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sigtree.near_duplicates(df).count() == 0


def test_shingles_equal_brute_force():
    rows = corpus(1)
    texts = [t for _, t in rows] + ["é b C D", "\x00 a b c d", "a" * 3000 + " b c d"]
    got, want = list(sets(texts, 4)), [shingles(t, 4) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    names = {}
    for s, w in zip(got, want, strict=True):
        if w:
            assert names.setdefault(class_of(s), w) == w
    assert len(names) == len(set(want) - {frozenset()})


def test_traversal_loses_no_pair():
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(3000)]
    found = []
    for i in range(300):
        start = rnd.randrange(0, 1500) if i % 3 else 40
        found.append(np.array(sorted(rnd.sample(base[start : start + 130], rnd.randint(90, 128))), np.uint64))
    n = np.array([len(s) for s in found])
    sig = np.stack([np.frombuffer(sigtree.signature(s), np.uint64) for s in found])
    label = np.array([i % 7 if i % 3 else 100 for i in range(300)])
    order = np.lexsort((n, label))
    tree = sigtree.Tree(order, n[order], label[order], n[order], sig[order])
    got = {(min(a, b), max(a, b)) for u, v in sigtree.traverse(tree, tree, 80, 100) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    assert len(got) < 300 * 299 / 2 / 2
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(found[i], found[j]))
            if label[i] != label[j] and 100 * both >= 80 * (n[i] + n[j] - both):
                assert (j, i) in got


def test_a_row_meets_its_own_class_only(spark, monkeypatch):
    """Rows that share an id or have none: each of their texts is looked at once, not once a class."""
    rows = [(i, f"a{i} b c d e f g h i j k l m n o p q r s t") for i in [None, 7] for _ in range(40)]
    rows = [(i, f"{t} u{j}") for j, (i, t) in enumerate(rows)]
    seen, of_class = [], sigtree.of_class

    def counted(texts, words):
        seen.append(texts.count())
        return of_class(texts, words)

    monkeypatch.setattr(sigtree, "of_class", counted)
    got = sigtree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 60, 100).collect()
    assert seen == [80]
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 60, 100)


def test_letters_of_one_form_meet_in_no_task(spark, monkeypatch):
    """Letters that differ in one word: no task holds the entries of their common shingles."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sigtree, "HOT", 300)
    form = " ".join(f"f{i}" for i in range(100))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("dear n"), F.col("id").cast("string"), F.lit(" " + form)).alias("text")).repartition(6)
    sketch = sigtree.merged_sketch(sigtree.profiles(df, 5))
    packed = sigtree.entries(df, sketch, 5, 80, 100, 20)
    part = packed.groupBy("part").agg((F.sum(F.length("key")) / 8).alias("n")).collect()
    total, most = sum(r.n for r in part), max(r.n for r in part)
    print(f"{total:.0f} entries, {most:.0f} in the largest part")
    assert total > 100_000 and most < 0.02 * total
    assert {r.component_id for r in sigtree.near_duplicates(df).collect()} == {0}
