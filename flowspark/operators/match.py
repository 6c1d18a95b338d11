"""Name matching without comparing all pairs (P-31, P-32, J-08)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import levenshtein_score, ratio_score

THRESHOLD = 0.80
HOT = 2_000  # names that meet under one gram in one task, about
SALTS = 16  # tasks that the names of one gram are spread over while it is counted
EPS = 1e-9


def whole(x: Column) -> Column:
    return F.floor(x + EPS).cast("int")


@dataclass(frozen=True)
class Scorer:
    """A score and what a pair that reaches threshold t must satisfy; n and m are the lengths."""

    score: Callable[[Column, Column], Column]
    longest: Callable[[Column, float], Column]  # greatest length of a partner of a name of length n
    lost: Callable[[Column, float], Column]  # grams (two letters each) of a name of length n that a partner may lack
    shift: Callable[[Column, Column, float], Column]  # places that a common gram may move by
    common: Callable[[Column, Column, float], Column]  # letters in common, counted with repeats


def _lost_in_blocks(n: Column, t: float) -> Column:
    # 2 for a letter outside the blocks, 1 for a letter put in between: 2 (n - M) + (m - M), M >= t (n + m) / 2
    m = F.ceil(n * (t / (2 - t)) - EPS) if 1.5 * t > 1 else whole(n * ((2 - t) / t))
    return whole(n * (2 - 1.5 * t) + m * (1 - 1.5 * t))


SCORERS = {
    # k <= (1 - t) * longer length edits; an edit takes two grams at most
    "levenshtein": Scorer(
        levenshtein_score,
        lambda n, t: whole(n / t),
        lambda n, t: 2 * whole((1 - t) * whole(n / t)),
        lambda n, m, t: whole((1 - t) * F.greatest(n, m)),
        lambda n, m, t: F.greatest(n, m) - whole((1 - t) * F.greatest(n, m)),
    ),
    # M >= t (n + m) / 2 letters in blocks of the same order
    "ratio": Scorer(
        ratio_score,
        lambda n, t: whole(n * ((2 - t) / t)),
        _lost_in_blocks,
        lambda n, m, t: F.greatest(n, m) - F.ceil(t * (n + m) / 2 - EPS).cast("int"),
        lambda n, m, t: F.ceil(t * (n + m) / 2 - EPS).cast("int"),
    ),
}


def letters_in_common(a: Column, b: Column) -> Column:
    """Letters that both names have, as often as both have them."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: a.substr(i, F.lit(1))))
    return F.aggregate(each, F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))


def prefixes(names: DataFrame, gram_counts: DataFrame, scorer: Scorer, threshold: float) -> DataFrame:
    """(name, n, gram, pos): the rarest grams of each name, one more than a partner may lack, and
    those as rare as the last of them. A name with no more grams than that has all of them, and
    ``weak`` is true."""
    n = F.length("name")
    d = names.select("name", n.alias("n"), scorer.lost(n, threshold).alias("lost"))
    places = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("pos", F.explode_outer(places)).withColumn("gram", F.expr("substring(name, pos, 2)"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    counts = gram_counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.join(counts, ["gram", "salt"], "left")
    d = d.groupBy("name", "n", "lost").agg(F.sort_array(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("count", "gram", "pos")))).alias("g"))
    last = F.get(F.col("g"), F.least(F.col("lost"), F.size("g") - 1))
    rare = F.filter("g", lambda x: F.struct(x["count"], x["gram"]) <= F.struct(last["count"], last["gram"]))
    return d.select("name", "n", (F.size("g") <= F.col("lost")).alias("weak"), F.explode_outer(rare).alias("g")).select(
        "name", "n", "weak", F.col("g.gram").alias("gram"), F.col("g.pos").alias("pos")
    )


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, scorer: str = "levenshtein") -> DataFrame:
    """Pairs (a, b) that can reach the threshold: a superset, none is missed.

    Each name is probed by its rarest grams of two letters. A pair that reaches the threshold
    shares one of these, at places that differ by no more than the score allows; the lengths and
    the letters in common bound the score as well. Where a name is so short, or the threshold so
    low, that a partner may lack every gram, such names of fitting lengths meet. Names under a gram that
    many names have are dealt out over several tasks.
    """
    sc = SCORERS[scorer]
    named = lambda d: d.select("name").where(F.length("name") > 0).distinct()
    l, r = named(left), named(right)
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.col("name").substr(i, F.lit(2))))
    counts = l.unionByName(r).where(F.length("name") > 1).select(grams.alias("gram")).groupBy("gram").count()
    l, r = prefixes(l, counts, sc, threshold), prefixes(r, counts, sc, threshold)

    dealt = r.where("gram IS NOT NULL").groupBy("gram").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"))
    spread = lambda d: d.where("gram IS NOT NULL").join(dealt, "gram")
    a = spread(l).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    b = spread(r).withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"))
    a = a.select("gram", "salt", F.col("name").alias("a"), F.col("n"), F.col("pos").alias("p"))
    b = b.select("gram", "salt", F.col("name").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"))
    n, m = F.col("n"), F.col("m")
    in_reach = (n <= sc.longest(m, threshold)) & (m <= sc.longest(n, threshold))
    met = a.join(b, ["gram", "salt"]).where(in_reach & (F.abs(F.col("p") - F.col("q")) <= sc.shift(n, m, threshold)))

    weak = lambda d, name: d.where("weak").select(F.col("name").alias(name), "n").distinct()
    reach = F.sequence(F.lit(1), sc.longest(F.col("n"), threshold))
    short = weak(l, "a").withColumn("m", F.explode(reach)).join(weak(r, "b").withColumnRenamed("n", "m"), "m").where(in_reach)
    pairs = met.select("a", "b").unionByName(short.select("a", "b")).distinct()
    la, lb = F.length("a"), F.length("b")
    return pairs.where(letters_in_common(F.col("a"), F.col("b")) >= sc.common(la, lb, threshold))


def best_matches(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, scorer: str = "levenshtein") -> DataFrame:
    """Best partner of every distinct left name: exact first, else the best score at or
    above the threshold (smallest name on ties), else null with score null."""
    names, known = left.select("name").distinct(), right.select("name").distinct()
    exact = names.join(known, "name", "left_semi").select("name", F.col("name").alias("match"), F.lit(1.0).alias("score"))
    rest = names.join(known, "name", "left_anti")
    score = SCORERS[scorer].score
    pairs = candidate_pairs(rest, known, threshold, scorer).withColumn("score", score(F.col("a"), F.col("b")))
    pairs = pairs.where(F.round(F.col("score"), 9) >= threshold)
    best = pairs.groupBy(F.col("a").alias("name")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("b").alias("match"))).alias("_b")
    )
    fuzzy = rest.join(best, "name", "left").select("name", "_b.match", (-F.col("_b.s")).alias("score"))
    return exact.unionByName(fuzzy)


def match_rows(left: DataFrame, right: DataFrame, normalise, on: str, threshold: float = THRESHOLD, scorer: str = "levenshtein") -> DataFrame:
    """Left rows with the right rows of their best normalised name (adds ``match``, ``score``).
    Names repeat, so the matching runs on distinct names and meets the rows again by equi join."""
    l = left.withColumn("_norm", normalise(F.col(on)))
    known = right.select(normalise(F.col(on)).alias("name"))
    m = best_matches(l.select(F.col("_norm").alias("name")), known, threshold, scorer)
    return l.join(m.withColumnRenamed("name", "_norm"), "_norm", "left").drop("_norm")


def supplement_routes(stops: DataFrame, pairs: DataFrame, reference: DataFrame, normalise, threshold: float = THRESHOLD, scorer: str = "levenshtein") -> DataFrame:
    """(stop, route) pairs, completed for the stops without any: their name is matched to a
    reference of (stop_name, route) pairs."""
    bare = stops.join(pairs.select("stop_id"), "stop_id", "left_anti").select("stop_id", normalise(F.col("name")).alias("name"))
    found = best_matches(bare, reference.select(F.col("stop_name").alias("name")), threshold, scorer).where("match IS NOT NULL")
    extra = (
        bare.join(found, "name")
        .join(reference.withColumnRenamed("stop_name", "match"), "match")
        .select("stop_id", F.col("route").alias("route_id"))
    )
    return pairs.unionByName(extra.distinct())
