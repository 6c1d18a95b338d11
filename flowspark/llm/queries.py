"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import ann, audit, chat, dedup, idfiles, langid, packing, pieces, quality, sigtree, urlwords, vantage, warc
from flowspark.session import cut_lineage, fresh_dir, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir.rstrip("/"))

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tested = langid.held_out(F.col("doc_id"), 4, 2)
    net = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~tested))
    return langid.predict(docs, net).select("doc_id", tested.alias("held_out"), "lang_pred", "score")


@query()
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "idfiles")
    idfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.scan(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = cut_lineage(quality.features(table(spark, sf_dir, "documents")))
    tested = langid.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(feats.where(~tested), table(spark, sf_dir, "labels"))
    return quality.score(feats, model).select("doc_id", tested.alias("held_out"), "score", "predicted")


@query("""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
           FROM documents),
h AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
e AS (SELECT c, n, unnest(s) AS x FROM c),
met AS (SELECT a.c AS a, b.c AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * k >= 85 * (n - k)),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN least ON least.c = c.c
""")
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


@query()
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """An archive's records from the pages: a full response of each, and a revisit some time later.

    One revisit in seven comes before its page; by turns revisits have a stale entity tag, a date, a
    weak tag, no validator or a strong tag.
    """
    p, ts = F.col("page_id"), F.lit(1_700_000_000) + F.col("page_id") * 7919 % 1_000_003
    later = ts + F.when(p % 7 == 0, -5).otherwise(p % 13 * 40_000 + 1)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    changed = F.concat(F.lit("t"), (ts - 3600).cast("string"))

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    stored = F.array(pair("Content-Type", F.lit("text/html")), pair("Date", ts), pair("ETag", tag), pair("Last-Modified", changed))
    validator = (
        F.when(p % 5 == 0, F.array(pair("ETag", F.lit('"stale"'))))
        .when(p % 5 == 1, F.array(pair("Last-Modified", changed)))
        .when(p % 5 == 2, F.array(pair("ETag", F.concat(F.lit("W/"), tag))))
        .when(p % 5 == 4, F.array(pair("ETag", tag)))
        .otherwise(F.array().cast(warc.HEADERS))
    )
    sent = F.concat(F.array(pair("Content-Length", F.lit(0)), pair("Date", later), pair("Cache-Control", F.concat(F.lit("max-age="), (p % 100).cast("string")))), validator)
    again = F.concat(F.col("url"), F.lit("#again"))
    both = F.array(
        F.struct((2 * p).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), ts.alias("ts"), F.lit(200).alias("status"), stored.alias("headers"), p.alias("body_id")),
        F.struct((2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), again.alias("url"), later.alias("ts"), F.lit(304).alias("status"), sent.alias("headers"), F.lit(None).cast("bigint").alias("body_id")),
    )
    return pages.select(F.explode(both).alias("r")).select("r.*")


@query("""
WITH p AS (SELECT page_id, url AS raw, '"' || md5(html) || '"' AS tag, 1700000000 + page_id * 7919 % 1000003 AS ts FROM pages),
q AS (SELECT *, ts + CASE WHEN page_id % 7 = 0 THEN -5 ELSE page_id % 13 * 40000 + 1 END AS later FROM p),
u AS (SELECT *, regexp_replace(trim(raw), '#.*$', '') AS u FROM q),
v AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u),
w AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', '')), CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') AS host,
  regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS asked FROM v),
c AS (SELECT *, scheme || '://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS url FROM w),
e AS (
  SELECT 2 * page_id AS record_id, page_id, url, ts, tag, 't' || (ts - 3600) AS changed, true AS is_full, NULL AS own_tag, NULL AS own_changed FROM c
  UNION ALL
  SELECT 2 * page_id + 1, page_id, url, later, NULL, NULL, false,
    CASE page_id % 5 WHEN 0 THEN '"stale"' WHEN 2 THEN 'W/' || tag WHEN 4 THEN tag END, CASE page_id % 5 WHEN 1 THEN 't' || (ts - 3600) END FROM c),
o AS (SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'page': page_id, 'ts': ts, 'tag': tag, 'changed': changed} END IGNORE NULLS)
  OVER (PARTITION BY url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS orig FROM e),
r AS (SELECT *, CASE WHEN orig IS NULL THEN 'missing' WHEN own_tag IS NULL AND own_changed IS NULL THEN 'unchecked'
    WHEN coalesce(regexp_replace(own_tag, '^W/', '') = orig.tag, own_changed = orig.changed) THEN 'resolved' ELSE 'changed' END AS outcome FROM o WHERE NOT is_full)
SELECT record_id, url, ts, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN orig.id END AS original_id,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN orig.page END AS body_id,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'Content-Type: text/html' || CASE WHEN own_tag IS NULL THEN chr(10) || 'ETag: ' || orig.tag ELSE '' END
      || CASE WHEN own_changed IS NULL THEN chr(10) || 'Last-Modified: ' || orig.changed ELSE '' END ELSE 'Content-Length: 0' END
    || chr(10) || 'Date: ' || ts || chr(10) || 'Cache-Control: max-age=' || (page_id % 100)
    || CASE WHEN own_tag IS NOT NULL THEN chr(10) || 'ETag: ' || own_tag WHEN own_changed IS NOT NULL THEN chr(10) || 'Last-Modified: ' || own_changed ELSE '' END AS headers
FROM (SELECT r.*, r.record_id // 2 AS page_id FROM (SELECT * EXCLUDE (page_id) FROM r) r)
""")
def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(page_records(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.withColumn("headers", F.concat_ws("\n", lines))


CLUSTERS, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024


def centroid_sql() -> str:
    """Rounds written out: the SQL has no loop that can group."""
    parts = [f"""e AS (SELECT vec_id, embedding AS x FROM embeddings WHERE len(embedding) = {DIMS}
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0)""",
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v FROM e)",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM
      (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT v.vec_id, v.v, m.c, list_sum(list_transform(list_zip(v.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, m{i} m) GROUP BY vec_id, v)""")
        if i < ROUNDS:
            parts.append(f"""m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(t.v, m.v) AS v FROM m{i} m LEFT JOIN (
      SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM (
        SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY c, k) GROUP BY c) t ON t.c = m.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN m{ROUNDS} m ON m.c = a.c"""


@query(centroid_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found = vantage.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, SEED, DIMS, SCALE)
    rows = found.collect()  # one row a centroid
    total = sum(r.cluster_inertia for r in rows)
    told = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, vantage.digest(r.centroid)) for r in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def found_sql(terms: list[str]) -> str:
    """How many of the terms stand alone in u."""
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)


@query(f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
u AS (SELECT page_id, translate(url, '{urlwords.UPPER}', '{urlwords.LOWER}') AS u,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlwords.UPPER}', '{urlwords.LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
h AS (SELECT *, {found_sql(urlwords.STRICT)} AS strict, {found_sql(urlwords.SOFT)} AS soft FROM u),
r(own, starts, rule, told) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(told, length(rule)) AS told FROM h JOIN r
  ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, starts) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(told, CASE WHEN strict > 0 OR soft > 1 THEN 'block' ELSE 'allow' END) AS verdict,
  strict AS n_strict, soft AS n_soft FROM h LEFT JOIN f ON f.page_id = h.page_id
""")
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlwords.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").alias("n_strict"), F.size("soft_terms").alias("n_soft"))


@query("""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT
    + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
b(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b2.f || c2.f || d2.f || e2.f AS filter_order, [a.bit, b2.bit, c2.bit, d2.bit, e2.bit] AS bits
  FROM b a, b b2, b c2, b d2, b e2 WHERE a.bit + b2.bit + c2.bit + d2.bit + e2.bit = 31 AND len(list_distinct([a.f, b2.f, c2.f, d2.f, e2.f])) = 5),
s AS (SELECT filter_order, step, bits[step]::INT AS own, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, own,
  coalesce(sum(n) FILTER ((mask & (own | before)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0 AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
