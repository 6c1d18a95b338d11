import random

from pyspark.sql import functions as F

from flowspark.llm import warc

DDL = f"record_id long, kind string, url string, ts long, status int, headers {warc.HEADERS}, body_id long, outcome string"


def brute(rows):
    full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] is not None and r[3] is not None]
    out = []
    for rid, kind, url, ts, _, headers, _ in rows:
        if kind != "revisit":
            continue
        headers = headers or []
        before = [r for r in full if url is not None and ts is not None and r[2].lower() == url.lower() and (r[3], r[0]) < (ts, rid)]
        orig = max(before, key=lambda r: (r[3], r[0])) if before else None

        def get(h, name):
            return next((v for n, v in h if n.lower() == name), None)

        outcome = "missing"
        if orig:
            stored = orig[5] or []
            tag, date = get(headers, "etag"), get(headers, "last-modified")
            strip = lambda t: t.removeprefix("W/") if t else t
            outcome = "unchecked" if tag is None and date is None else "resolved" if (strip(tag) == strip(get(stored, "etag")) if tag is not None else date == get(stored, "last-modified")) else "changed"
        if outcome in ("resolved", "unchecked"):
            sent = [(n, v) for n, v in headers if n.lower() in warc.PERMITTED]
            names = {n.lower() for n, _ in sent}
            out.append((rid, outcome, orig[0], orig[6], tuple([(n, v) for n, v in stored if n.lower() not in names] + sent)))
        else:
            out.append((rid, outcome, None, None, tuple(headers)))
    return sorted(out, key=str)


def test_resolution_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(1500):
        url = rnd.choice(["http://hot.example/x"] * 3 + ["http://a.example/", "HTTP://A.example/", None, "http://b.example/q?a=1"])
        kind = rnd.choice(["response", "revisit", "request"])
        headers = None if rnd.random() < 0.05 else [h for h in [("ETag", rnd.choice(['"1"', 'W/"1"', '"2"'])), ("Last-Modified", rnd.choice("xy")), ("Content-Length", "5"), ("date", str(i)), ("ETag", '"3"')] if rnd.random() < 0.5]
        rows.append((i, kind, url, None if rnd.random() < 0.03 else rnd.randint(0, 40) * 5000, rnd.choice([200, 200, 200, 404]) if kind == "response" else 304, headers, i * 10))
    df = spark.createDataFrame([(*r, "clash") for r in rows], DDL).repartition(5)
    got = [(r.record_id, r.outcome, r.original_id, r.body_id, tuple((h.name, h.value) for h in r.headers)) for r in warc.resolve(df, 20_000).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert {g[1] for g in got} == {"resolved", "unchecked", "changed", "missing"}
    assert warc.resolve(df.limit(0)).count() == 0
    assert "Python" not in warc.resolve(df)._jdf.queryExecution().toString()


def test_canonical_urls(spark):
    cases = {
        "http://User@Example.COM:80/A?b=2&a=1&utm_source=x#top": "http://example.com/A?a=1&b=2",
        "https://example.com:443": "https://example.com/",
        "https://example.com:8443/?ref=x": "https://example.com:8443/",
        " http://example.com/a?referrer=1 ": "http://example.com/a?referrer=1",
        "http://example.com?b": "http://example.com/?b",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    assert df.select(warc.canonical(F.col("u")).alias("got"), "want").where("got <> want").collect() == []
    assert spark.sql("select cast(null as string) u").select(warc.canonical(F.col("u")).alias("c")).collect()[0].c is None
