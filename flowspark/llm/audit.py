"""How corpus filters interact: who removes what in every order, counted by a stream with retractions.

All files of a table are read by Structured Streaming in available-now micro-batches. A row's
failures are a bit mask: one bit a filter that looks at the text alone, and one bit for "some
smaller id has the same text". The last one is only known once all rows are seen, so it is counted
with retractions. Each micro-batch counts its rows as copies first. The state, keyed by the text's
sha256, holds each text's smallest id so far and where the rows with that id are counted (its places:
part, good, toxic); these are counted as no copies instead. When a smaller id arrives, that count is
taken back for the earlier rows and made for the new ones. The sum of all changes are the counters.

The state is a table of versions: a micro-batch meets, by the text's key, the versions of those before
it and writes the texts that are new or changed, and its changes of the counters, under its own
number. A batch that is run again after a loss replaces its rows and reads none of its own. (An operator state
of the stream was tried first: with calls into Python and the store for every text it cost 1.7 ms a text.) State, changes and checkpoint stay in the job's folder: a later call on it reads the files that are
new and comes to the same counters as one run over all of them.

Hot texts: Spark adds up a task's rows of one id and text, and keeps the smallest id of a text, before
each shuffle, so a text with a third of all rows travels as one row a task. Labels are joined by id; rows without an
id are spread over all tasks, an id's rows over ``Plan.salts``, as many times as the small label
rows are repeated.

From the counters follows every order of the filters, for they tell all that the orders ask: a document
goes by the first filter of the order in its mask. A null text counts as empty, a null part as
the empty string. A null id is larger than all others; rows of one id are not copies of each other.
Several labels of one id: it is good, or toxic, if one of them says so; null labels say nothing. An empty
table gives an empty report. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowspark.session import fresh_dir

WORDS = r"[\x20\x09-\x0D]+"
COUNT = "part string, mask int, good boolean, toxic boolean, n long"


@dataclass(frozen=True)
class Plan:
    batches: int = 4  # micro-batches that the files are spread over, about
    salts: int = 4  # keys that the rows of one id are spread over


def text_filters() -> dict[str, Column]:
    """Failure conditions of the filters that look at a text alone: columns text, n (words) and different (words)."""
    n, different, text = F.col("n"), F.col("different"), F.col("text")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * different < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masked(docs: DataFrame, filters: dict[str, Column], doc_id: str, text: str, part: str) -> DataFrame:
    """id, part, sha (of the text) and mask of every row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", WORDS), lambda w: w != ""))
    d = d.select("id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    return d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.cast("int").alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, salts: int, doc_id: str) -> DataFrame:
    """Adds good and toxic. An id's rows are spread over its salts; rows without an id, which no label has, over all tasks."""
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    said = said.where("good OR toxic").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = F.hash("sha", "part")
    salt = F.when(F.col("id").isNull(), place).otherwise(F.pmod(place, F.lit(salts)))
    met = rows.withColumn("salt", salt).join(said, ["id", "salt"], "left")
    return met.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


PLACE = ["part", "good", "toxic", "n"]
PLACES = "array<struct<part: string, good: boolean, toxic: boolean, n: bigint>>"


def holders(rows: DataFrame) -> DataFrame:
    """sha, mask, and of each text the rank of its smallest id (null last) and the places of the rows with it."""
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    at = rows.groupBy("sha", "mask", "id", "part", "good", "toxic").agg(F.count("*").alias("n"))
    own = at.groupBy("sha", "mask", "id").agg(F.collect_list(F.struct(*PLACE)).alias("own"))
    least = own.groupBy("sha", "mask").agg(F.min_by(F.struct(rank.alias("rank"), F.col("own")), rank).alias("least"))
    return least.select("sha", "mask", "least.rank", "least.own")


def updated(new: DataFrame, versions: DataFrame) -> DataFrame:
    """The texts of ``new`` that are unknown, or whose holders change: rank, own, and ``gone``, the places so far."""
    latest = versions.groupBy("sha").agg(F.max_by(F.struct("rank", "own"), "batch").alias("old"))
    met = new.join(latest, "sha", "left")
    known, same = F.col("old").isNotNull(), F.col("old.rank").eqNullSafe(F.col("rank"))
    own = F.when(known & same, F.concat("old.own", "own")).otherwise(F.col("own"))
    met = met.where(~known | same | (F.col("rank") < F.col("old.rank")))
    return met.select("sha", "mask", "rank", own.alias("own"), F.coalesce("old.own", F.array().cast(new.schema["own"].dataType)).alias("gone"))


def corrections(changed: DataFrame, copy_bit: int) -> DataFrame:
    """Rows with the smallest id are no copies; those that were until now are."""
    parts = F.array(*[
        F.struct(F.col(places).alias("places"), F.lit(sign).alias("sign"), (F.col("mask") + bit).cast("int").alias("mask"))
        for places, sign, bit in (("own", 1, 0), ("own", -1, copy_bit), ("gone", -1, 0), ("gone", 1, copy_bit))
    ])
    d = changed.select(F.explode(parts).alias("c")).select("c.sign", "c.mask", F.explode("c.places").alias("p"))
    return d.select("p.part", "mask", "p.good", "p.toxic", (F.col("sign") * F.col("p.n")).alias("n"))


def run_stream(
    spark: SparkSession, path: str, labels: DataFrame, folder: str, plan: Plan, filters: dict[str, Column] | None = None, schema: StructType | None = None,
    doc_id: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """Read the files under ``path`` that the folder's job has not read yet; the counters of all it has read.

    Counters: part, mask, good, toxic, n. Bit i of a mask is the i-th filter, the last one the copies'.
    """
    table = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    files = max(1, -(-len(table.inputFiles()) // plan.batches))
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern(path))
    filters = text_filters() if filters is None else filters
    copy_bit = 1 << len(filters)
    rows = masked(docs, filters, doc_id, text, part)
    kind = table.schema[doc_id].dataType.simpleString()
    row = f"id {kind}, part string, sha binary, mask int"
    state = f"sha binary, mask int, rank struct<none: boolean, id: {kind}>, own {PLACES}"
    for name, columns in (("state", state), ("changes", COUNT)):
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")

    def merge(batch: DataFrame, number: int) -> None:
        put = lambda d, name: d.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        put(batch, "rows")  # the texts are looked at once
        own = labelled(spark.read.schema(row).parquet(f"{folder}/rows/batch={number}"), labels, plan.salts, doc_id)
        versions = spark.read.schema(f"{state}, batch long").parquet(f"{folder}/state").where(F.col("batch") < number)
        put(updated(holders(own), versions).select("sha", "mask", "rank", "own", "gone"), "state")
        changed = spark.read.schema(f"{state}, gone {PLACES}").parquet(f"{folder}/state/batch={number}")
        copies = own.select("part", (F.col("mask") + copy_bit).cast("int").alias("mask"), "good", "toxic", F.lit(1).cast("long").alias("n"))
        put(total(copies.unionByName(corrections(changed, copy_bit))), "changes")

    stream = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    stream.foreachBatch(merge).start().awaitTermination()
    return total(spark.read.schema(f"{COUNT}, batch long").parquet(f"{folder}/changes")).where("n <> 0")


def total(changes: DataFrame) -> DataFrame:
    return changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def pattern(path: str) -> str:
    """The same path as a pattern: a stream takes one file by a pattern only, and a folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def report(counters: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the counters (at most 4 * 2**filters of a part)."""
    n = len(letters)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    held = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("held"))
    each = held.select("part", "held", F.explode(orders).alias("filter_order"))
    each = each.select("part", "held", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bits = F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)])
    own = bits[F.expr("substring(filter_order, step, 1)")]
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bits[F.col("filter_order").substr(i, F.lit(1))]).otherwise(0))
    each = each.withColumns({"own": own, "before": before})
    fails, earlier = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0, lambda c: c["mask"].bitwiseAND(F.col("before")) != 0

    def total(which, weight=lambda c: F.lit(1)) -> Column:
        return F.aggregate("held", F.lit(0).cast("bigint"), lambda s, c: s + F.when(which(c), c["n"] * weight(c)).otherwise(0))

    many = len(list(permutations(letters)))
    firsts = F.create_map(*[F.lit(x) for k in range(1, n + 1) for x in (k, many // k)])  # orders in which a filter is the first of k
    return each.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total(lambda c: fails(c) & ~earlier(c)).alias("removed"),
        total(lambda c: fails(c) & earlier(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: fails(c) & ~earlier(c) & c["good"]).alias("good_lost"),
        total(lambda c: fails(c) & ~earlier(c) & c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: firsts[F.bit_count(c["mask"])].cast("bigint")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, plan: Plan | None = None, folder: str | None = None) -> DataFrame:
    """The report on the filters A to D and the copies E over the documents under ``path``."""
    folder = folder or fresh_dir(spark, "audit")
    return report(run_stream(spark, path, labels, folder, plan or Plan()), "ABCDE")
