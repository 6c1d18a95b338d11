import re

from flowspark.llm import urlwords

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.b/"), ("allow", "b/xy")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://planet/x", "http://a.example.net/en/1", "http://example.net/en", "http://example.net/de/",
    "https://www.example.com/de/x?y=casino", "https://example.com/en/casino", "https://example.com/en/casinos", "https://example.com/en/1casino", "https://example.com/CASINO-1",
    "http://cheap.pills.io/", "http://cheap.cheap.io/cheap", "http://cheappills.io", "http://free-bets.io#top", "http://x.io/?q=free&r=bets", "http://a.b/xyz", "http://b/xyz", "http://c.b/xz",
    "http://user@h.org:80/fr/?casino", "ftp://x://y/z", "http://a\nb.net/p\nq?r", "http://example.org/fr/casino", "http://casinö.io/ßporn", "http://xxx", "xxx", "http://i.io/" + "a" * 100_000 + "/porn",
]


def brute(url):
    url = url or ""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    rest = url.split("://", 1)[1] if "://" in url else None
    host = path = ""
    if rest is not None:
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    stands = lambda t: re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low) is not None
    strict, soft = sorted(filter(stands, urlwords.STRICT)), sorted(filter(stands, urlwords.SOFT))
    fits = []
    for verdict, rule in RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), len(own), rule, verdict))
    if fits:
        _, _, rule, verdict = max(fits)
    else:
        rule, verdict = None, "block" if strict or len(soft) > 1 else "allow"
    return host, path, rule, verdict, strict, soft


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, verdict string, terms int")
    got = urlwords.judge(pages, RULES)
    assert got.columns == ["page_id", "url", "terms", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
    for r in got.collect():
        want = brute(r.url)
        assert (r.host, r.path, r.rule, r.verdict, r.strict_terms, r.soft_terms) == want, r.url
        assert r.terms == 1


def test_weights_and_overlaps(spark):
    words = urlwords.Vocabulary({"Red": 1.0, "red-hot": 1.5, "hot": 0.5, "hot hot": 3.0}, limit=3.0)
    rows = ["red", "red-hot", "red-hot-hot", "hot hot", "red red red", ""]
    got = urlwords.judge(spark.createDataFrame([(u,) for u in rows], "url string"), [], words).collect()
    assert [(r.strict_terms, r.soft_terms, r.verdict) for r in got] == [
        ([], ["red"], "allow"), ([], ["hot", "red", "red-hot"], "block"), ([], ["hot", "red", "red-hot"], "block"),
        (["hot hot"], ["hot"], "block"), ([], ["red"], "allow"), ([], [], "allow"),
    ]


def test_no_rules_no_rows_no_terms(spark):
    none = spark.createDataFrame([], "url string, host int")
    assert urlwords.judge(none, RULES).collect() == []
    one = spark.createDataFrame([("http://casino",)], "url string")
    assert [r.verdict for r in urlwords.judge(one, [], urlwords.Vocabulary({"sonic": 9.0})).collect()] == ["allow"]
