"""Presents the warehouse tables as a lending portfolio: applications, relations, installments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"
STRONG = ("device", "account", "person")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(col: str):
    return F.datediff(F.col(col).cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an application: ``app_id, cust, day, amount, product, status, income, score, ring``."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_custkey").alias("cust"), _day("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("status"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("income"))
    out = o.join(c, "cust", "left")
    score = F.expr("(app_id * 2654435761 + 12345) % 1000003") / F.lit(1000003.0)
    ring = F.expr("case when (app_id * 40503 + 7) % 25 = 0 then 1 + app_id % 40 else -1 end")
    return out.select("app_id", "cust", "day", "amount", "product", "status", "income", score.alias("score"), ring.alias("ring"))


def installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as installments: ``app_id, no, emi, missed, dpd``."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("app_id"), "o_orderdate")
    li = _read(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("app_id")).select("app_id", F.col("l_linenumber").alias("no"), F.col("l_extendedprice").alias("emi"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("missed"), F.greatest(F.datediff("l_shipdate", "o_orderdate"), F.lit(0)).alias("dpd"))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long incidence ``relation, app_id, node`` of five relations, distinct, without nulls."""
    a = applications(spark, sf_dir).select("app_id", "cust", "day")
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("app_id"), "l_linenumber", "l_partkey", "l_suppkey", _day("l_shipdate").alias("sday"))
    li = li.join(a.select("app_id"), "app_id", "left_semi")
    txt = lambda *c: F.concat_ws("_", *[x.cast("string") for x in c])
    node = lambda relation, value: F.struct(F.lit(relation).alias("relation"), value.alias("node"))
    person = a.select(F.lit("person").alias("relation"), "app_id", txt(F.col("cust"), F.floor(F.col("day") / 90)).alias("node"))
    first, second = F.col("l_linenumber") == 1, F.col("l_linenumber") == 2
    nodes = F.array(
        F.when(first, node("device", txt(F.col("l_partkey"), F.floor(F.col("sday") / 30)))),
        F.when(second, node("account", txt(F.col("l_partkey"), F.col("l_suppkey")))),
        F.when(first, node("dealer", txt(F.col("l_suppkey")))),
        node("guarantor", txt(F.col("l_partkey"))),
    )
    # One pass over the line items; an application can repeat any of their nodes.
    lines = li.select("app_id", F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("x")).select("x.relation", "app_id", "x.node").distinct()
    return person.distinct().unionByName(lines).where("app_id is not null and node is not null")


#: The same binding as SQL, for the oracle queries.
SQL = f"""
apps AS (
  SELECT o_orderkey AS app_id, o_custkey AS cust, CAST(datediff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) AS BIGINT) AS day,
         o_totalprice AS amount, o_orderpriority AS product, o_orderstatus AS status, c_acctbal AS income,
         ((o_orderkey * 2654435761 + 12345) % 1000003) / CAST(1000003.0 AS DOUBLE) AS score,
         CASE WHEN (o_orderkey * 40503 + 7) % 25 = 0 THEN 1 + o_orderkey % 40 ELSE -1 END AS ring
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
li AS (SELECT *, datediff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS sday FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
inc AS (
  SELECT DISTINCT relation, app_id, node FROM (
    SELECT 'person' AS relation, app_id, cust || '_' || CAST(floor(day / 90.0) AS BIGINT) AS node FROM apps
    UNION ALL SELECT 'device', l_orderkey, l_partkey || '_' || CAST(floor(sday / 30.0) AS BIGINT) FROM li WHERE l_linenumber = 1
    UNION ALL SELECT 'account', l_orderkey, l_partkey || '_' || l_suppkey FROM li WHERE l_linenumber = 2
    UNION ALL SELECT 'dealer', l_orderkey, CAST(l_suppkey AS VARCHAR) FROM li WHERE l_linenumber = 1
    UNION ALL SELECT 'guarantor', l_orderkey, CAST(l_partkey AS VARCHAR) FROM li) WHERE app_id IS NOT NULL AND node IS NOT NULL)
"""
