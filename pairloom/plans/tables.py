"""Matching inputs over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sim, unit, g, x1, x2, y): customers by nation; recipients are the building segment."""
    orders = (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("sim"),
        F.col("c_custkey").cast("long").alias("unit"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("g"),
        (F.col("c_acctbal") / 1000).cast("double").alias("x1"),
    )
    return customers.join(orders, "unit", "left").select(
        "sim", "unit", "g", "x1", F.coalesce("n", F.lit(0)).cast("double").alias("x2"), (F.coalesce("total", F.lit(0.0)) / 100000).cast("double").alias("y")
    )


def indexed(all_units: DataFrame, k: int = 2) -> DataFrame:
    """Units of sims with at least 2 recipients and k donors for each, with their place p in their group and the sizes n_r and n_d."""
    sizes = all_units.groupBy("sim").agg(F.count_if(F.col("g") == 1).alias("n_r"), F.count_if(F.col("g") == 0).alias("n_d"))
    fit = sizes.where((F.col("n_r") >= 2) & (F.col("n_r") * k <= F.col("n_d")))
    place = F.row_number().over(Window.partitionBy("sim", "g").orderBy("unit")).cast("long")
    return all_units.join(fit, "sim").withColumn("p", place)


#: Common table expressions of the same, for the oracle.
UNITS = """units AS (
  SELECT c_nationkey::BIGINT AS sim, c_custkey::BIGINT AS unit, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS g,
         c_acctbal / 1000 AS x1, coalesce(n, 0)::DOUBLE AS x2, coalesce(total, 0) / 100000 AS y
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
INDEXED = f"""{UNITS}, ix AS (
  SELECT u.*, row_number() OVER (PARTITION BY sim, g ORDER BY unit)::BIGINT AS p FROM units u
  JOIN (SELECT sim FROM units GROUP BY sim HAVING count(*) FILTER (g = 1) >= 2 AND 2 * count(*) FILTER (g = 1) <= count(*) FILTER (g = 0)) USING (sim))"""
PAIRS = f"""{INDEXED}, pairs AS (
  SELECT r.sim, r.p AS rp, d.p AS dp, r.y AS ry, d.y AS dy, r.x1 AS rx1, r.x2 AS rx2, d.x1 AS dx1, d.x2 AS dx2,
         sqrt((r.x1 - d.x1) * (r.x1 - d.x1) + (r.x2 - d.x2) * (r.x2 - d.x2)) AS dist
  FROM ix r JOIN ix d ON r.sim = d.sim AND r.g = 1 AND d.g = 0)"""
KNN = f"""{PAIRS}, knn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sim, rp ORDER BY dist, dp) AS slot FROM pairs) WHERE slot <= 2)"""
KERNEL = f"""{PAIRS}, logw AS (
  SELECT *, -1.0 * ln(dist + min(dist) OVER (PARTITION BY sim, rp)) AS lw FROM pairs),
expw AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY sim, rp)) AS e FROM logw),
kernel AS (SELECT *, e / sum(e) OVER (PARTITION BY sim, rp) AS alpha FROM expw),
cdf AS (SELECT *, CASE WHEN dp = max(dp) OVER (PARTITION BY sim, rp) THEN 1.0
                       ELSE sum(alpha) OVER (PARTITION BY sim, rp ORDER BY dp ROWS UNBOUNDED PRECEDING) END AS c FROM kernel)"""


def uniform_sql(*key: str) -> str:
    """The key's uniform number in DuckDB; plain words are tags, the rest are expressions in brackets."""
    parts = ", ".join(f"{k}::VARCHAR" if k[0] == "(" else f"'{k}'" for k in key)
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


#: 1-to-1 draws of the kernel: (sim, rp, iter, dp, ry, dy).
DRAWS = f"""{KERNEL}, draws AS (
  SELECT k.sim, k.rp, i.iter, min(dp) AS dp, any_value(ry) AS ry, min_by(dy, dp) AS dy
  FROM cdf k, (SELECT unnest(range(1, 21)) AS iter) i
  WHERE {uniform_sql("u1", "(k.sim)", "(k.rp)", "(i.iter)")} <= c GROUP BY 1, 2, 3)"""
