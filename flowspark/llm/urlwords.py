"""URL filter by a weighted vocabulary, with allow and block rules that come first.

One Aho-Corasick automaton holds all terms and finds every occurrence in one pass over the URL,
overlapping ones as well. A hit counts where the term stands alone: no letter or digit of ASCII
touches it on either side. A term is strict or soft by its weight: ``Vocabulary.limit`` or more is
strict. A URL is rejected by one strict hit, or when the weights of its *different* soft terms reach
the limit; a soft term that is repeated counts once, and no single soft term can reach it.

The URL is searched whole and as written, A-Z lower-cased, with no decoding of escapes. Its host is
what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (port and user
included), its path goes on up to ``?``, ``#`` or the end; both are empty for a null URL or one
without ``://``. A rule is a host and a path; it fits its host and all subdomains where the path
starts with the rule's. The longest rule that fits decides (of equally long ones the one with the
longer host, which is then unique), and where none does the vocabulary.

A null or empty URL has no hits and is allowed. Long URLs are searched to the end. Each row is
judged by itself, so repeated rows get the same verdict; an empty table gives an empty table. The
columns ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms``, ``soft_terms`` are the
result's; equal names of further columns are replaced, all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "struct<strict_terms: array<string>, soft_terms: array<string>>"
RESULT = ("host", "path", "rule", "verdict", "strict_terms", "soft_terms")

# Words that by themselves mark a page as unwanted, and words that do so in company.
STRICT = ["casino", "porn", "xxx", "viagra", "escort", "hentai", "camgirls", "warez", "payday-loan", "adult"]
SOFT = [
    "ads", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "deal", "deals", "discount", "farm", "free", "jackpot", "loan", "loans",
    "nude", "pills", "poker", "prize", "promo", "sex", "sexy", "slots", "spam", "track", "tracker", "win",
]


@dataclass(frozen=True)
class Vocabulary:
    weights: dict[str, float] = field(default_factory=lambda: {t: 2.0 for t in STRICT} | {t: 1.0 for t in SOFT})
    limit: float = 2.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            term = term.translate(str.maketrans(UPPER, LOWER))
            if term:
                found.add_word(term, (term, weight >= self.limit))
        found.make_automaton()
        return found


def plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(automaton, text: str) -> tuple[list[str], list[str]]:
    """The different strict and soft terms that stand alone in the text, in alphabetical order."""
    strict: set[str] = set()
    soft: set[str] = set()
    if text and len(automaton):
        for last, (term, is_strict) in automaton.iter(text):
            first = last - len(term)
            before_free = first < 0 or not (plain(text[first]) and plain(term[0]))
            after_free = last + 1 == len(text) or not (plain(text[last + 1]) and plain(term[-1]))
            if before_free and after_free:
                (strict if is_strict else soft).add(term)
    return sorted(strict), sorted(soft)


def terms_of(url: Column, vocabulary: Vocabulary) -> Column:
    """The different strict and soft terms of a URL."""

    @F.pandas_udf(WORDS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = vocabulary.automaton()  # once per task
        for urls in parts:
            yield pd.DataFrame([hits(automaton, u or "") for u in urls], columns=["strict_terms", "soft_terms"])

    return run(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (verdict, rule) that fits, as a struct; null if none does. A rule reads ``host/path``."""
    order = sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0])), reverse=True)
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in reversed(order):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str]], vocabulary: Vocabulary | None = None, url: str = "url") -> DataFrame:
    """The rows with host, path, rule, verdict, strict_terms and soft_terms."""
    vocabulary = vocabulary or Vocabulary()
    others = [c for c in pages.columns if c.lower() not in RESULT]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    u = F.col(f"`{url}`")
    d = pages.select(row.alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), terms_of(u, vocabulary).alias("terms"))
    weights = F.create_map(*[F.lit(x) for t, w in vocabulary.weights.items() for x in (t.translate(str.maketrans(UPPER, LOWER)), float(w))])
    weight = F.aggregate("terms.soft_terms", F.lit(0.0), lambda s, t: s + weights[t])
    bad = (F.size("terms.strict_terms") > 0) | (weight >= vocabulary.limit)
    d = d.withColumn("told", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("told.verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return d.select(
        *[F.col("row")[c].alias(c) for c in others],
        "host", "path", F.col("told.rule").alias("rule"), verdict.alias("verdict"),
        F.col("terms.strict_terms").alias("strict_terms"), F.col("terms.soft_terms").alias("soft_terms"),
    )
