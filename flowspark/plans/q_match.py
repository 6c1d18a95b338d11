"""Name matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import text
from flowspark.functions.num import rnd as r
from flowspark.operators import match as ma
from flowspark.operators import transit as tr
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.sources import tables as src
from flowspark.sources.tables import Tables

cte("matches", """
SELECT name, name AS match, 1.0::DOUBLE AS score FROM names_b WHERE name IN (SELECT name FROM names_a)
UNION ALL SELECT a.name, b.match, b.score FROM (SELECT name FROM names_b WHERE name NOT IN (SELECT name FROM names_a)) a LEFT JOIN (
  SELECT name, match, score FROM (SELECT x.name, y.name AS match, 1 - levenshtein(x.name, y.name) / CAST(greatest(length(x.name), length(y.name)) AS DOUBLE) AS score,
      row_number() OVER (PARTITION BY x.name ORDER BY round(1 - levenshtein(x.name, y.name) / CAST(greatest(length(x.name), length(y.name)) AS DOUBLE), 9) DESC, y.name) AS rn
    FROM names_b x, names_a y) WHERE rn = 1 AND round(score, 9) >= 0.8) b ON a.name = b.name
""", ["names_a", "names_b"])


@query("fuzzy_match", sql(["matches"], f"SELECT name, match, {rnd('score', 'score')} FROM matches"))
def fuzzy_match(t: Tables) -> DataFrame:
    d = ma.best_matches(fx.names_b(t), fx.names_a(t))
    return d.select("name", "match", r(F.col("score")).alias("score"))


@query("fuzzy_match_ratio")
def fuzzy_match_ratio(t: Tables) -> DataFrame:
    """Matching-blocks ratio as the score; no SQL function exists for it."""
    d = ma.best_matches(fx.names_b(t), fx.names_a(t), scorer="ratio")
    return d.select("name", "match", r(F.col("score")).alias("score"))


@query("station_names", """
SELECT c_custkey AS id, regexp_replace(regexp_replace(regexp_replace(trim(n), '站$', ''), '地铁站$', ''), '^地铁', '') AS station FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' 地铁' ELSE ' ' END || c_name || CASE c_custkey % 4 WHEN 0 THEN '站 ' WHEN 1 THEN '地铁站' WHEN 2 THEN '站站' ELSE '' END AS n FROM customer)""")
def station_names(t: Tables) -> DataFrame:
    """Customer names with a station's affixes, cleaned."""
    c = F.col("c_custkey")
    suffix = F.when(c % 4 == 0, "站 ").when(c % 4 == 1, "地铁站").when(c % 4 == 2, "站站").otherwise("")
    name = F.concat(F.when(c % 3 == 0, " 地铁").otherwise(" "), "c_name", suffix)
    return t.customer.select(c.alias("id"), text.station_name(name).alias("station"))


@query("stop_reference", """
SELECT p_name AS stop_name, count(DISTINCT p_brand) AS n_routes FROM part GROUP BY 1""")
def stop_reference(t: Tables) -> DataFrame:
    pairs = src.stop_routes_reference(t.part, "p_brand", "p_name", text.stop_name)
    return pairs.groupBy("stop_name").agg(F.count("*").alias("n_routes"))


@query("route_supplement", sql(["matches"], """
SELECT stop_id, count(DISTINCT route_id) AS n_routes FROM (
  SELECT p_partkey AS stop_id, p_type AS route_id FROM part WHERE p_size <= 25
  UNION ALL SELECT q.p_partkey, ref.p_brand FROM (SELECT p_partkey, CASE WHEN length(p_name) % 2 = 1 THEN substr(p_name, 1, 1) || substr(p_name, 4) ELSE p_name END AS name
    FROM part WHERE p_size > 25 OR p_size IS NULL) q JOIN matches m ON m.name = q.name JOIN (SELECT DISTINCT p_name, p_brand FROM part) ref ON ref.p_name = m.match) GROUP BY 1"""))
def route_supplement(t: Tables) -> DataFrame:
    """Stops without own routes take those of the reference stop with the best name."""
    n = F.col("p_name")
    name = F.when(F.length(n) % 2 == 1, F.concat(F.substring(n, 1, 1), F.expr("substring(p_name, 4)"))).otherwise(n)
    stops = t.part.select(F.col("p_partkey").alias("stop_id"), name.alias("name"))
    own = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("stop_id"), F.col("p_type").alias("route_id")).distinct()
    reference = src.stop_routes_reference(t.part, "p_brand", "p_name", text.stop_name)
    return tr.routes_per_stop(ma.supplement_routes(stops, own, reference, text.stop_name))
