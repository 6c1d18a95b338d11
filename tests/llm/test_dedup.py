import hashlib
import random
import re

from flowspark.llm import dedup


def brute(rows):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]", "", t or "")

    groups = {}
    for i, (doc, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), doc is None, doc or 0, i))
    out = []
    for n, members in groups.items():
        members.sort()
        keep = rows[members[0][3]][0]
        sha = hashlib.sha256(n.encode()).hexdigest()
        out += [(rows[m[3]][0], keep, len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=str)


def test_copies_equal_brute_force(spark):
    rnd = random.Random(3)
    pool = ["", None, " ", "a b", "ab", "a\tb\n", "a b", "é x", "a b" * 3000] + ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    rows = [(i, rnd.choice(pool)) for i in range(600)] + [(10_000 + i, "hot  one") for i in range(900)] + [(None, "ab"), (None, None), (5, "same row"), (5, "same row")]
    rows += [(20_000, "a  b"), (20_001, "a   b")]
    df = spark.createDataFrame([(doc, t, "k", 1) for doc, t in rows], "doc_id long, text string, keep_id string, hash int")
    got = sorted([tuple(r) for r in dedup.copies(df.repartition(7)).collect()], key=str)
    assert got == brute(rows)
    assert dedup.copies(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in dedup.copies(df)._jdf.queryExecution().toString()
