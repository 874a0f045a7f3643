"""Five-year cash flow of a prevention programme, and the reference sector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sector, exposure, gross NPA (crore) of the current and the prior year.
SECTORS = [
    ("Agriculture & allied (tractor)", 4306.66, 443.46, 4726.15, 560.49),
    ("Industry - MSME", 454.18, 17.65, 824.70, 26.01),
    ("Industry - other", 33.53, 0.63, 147.01, 6.04),
    ("Services", 2258.50, 155.45, 1361.95, 32.84),
    ("Personal loans", 4774.84, 119.72, 4616.42, 177.29),
    ("Vehicles (2W/used-car/3W/CV)", 12963.80, 341.92, 11608.62, 460.63),
    ("Consumer durable", 6065.43, 62.01, 3689.42, 74.71),
    ("Advance to dealers", 228.17, 0.52, 184.25, 0.68),
    ("Other", 130.89, 0.00, 20.89, 0.00),
]
PRINTED = (31216.01, 1141.36)
WRITE_OFFS = 437.11
# Year, share of the book covered, prevention ramp, running cost, one-off cost.
YEARS = [(1, 0.15, 0.35, 2.5, 9.5), (2, 0.52, 0.70, 3.5, 0.0), (3, 1.00, 1.0, 4.5, 0.0), (4, None, 1.0, 5.0, 0.0), (5, None, 1.0, 5.5, 0.0)]
PARAMS = {"ring_share": 0.20, "prevention": 0.50, "recovery": 0.10, "friction": 0.0004, "discount": 0.12}
# Casualty history (year, value, cases).
HISTORY = [("FY24", 8917.0, 4105), ("FY25", 30367.0, 7924), ("FY26", 40774.0, 8640)]


def sectors(spark: SparkSession) -> DataFrame:
    """The sector table as a DataFrame."""
    return spark.createDataFrame(SECTORS, "sector string, exposure double, npa double, prior_exposure double, prior_npa double")


def books() -> tuple[float, float]:
    """The pilot book and the extended book."""
    size = {s[0]: s[1] for s in SECTORS}
    pilot = size["Vehicles (2W/used-car/3W/CV)"] + size["Consumer durable"]
    return pilot, pilot + size["Personal loans"] + size["Agriculture & allied (tractor)"]


def cash_flow(draws: DataFrame, net_book: float) -> DataFrame:
    """Yearly net of each parameter draw: ``draw, year, covered, avoided, recovered, cost, net, pv``.

    ``draws`` has the columns draw, ring_share, prevention, recovery; a pure projection.
    """
    spark, (pilot, wide) = draws.sparkSession, books()
    years = spark.createDataFrame([(y, pilot * c if c else wide, p, o + one) for y, c, p, o, one in YEARS], "year int, covered double, ramp double, base_cost double")
    x = draws.crossJoin(F.broadcast(years))  # five rows
    exposure = F.col("covered") * (WRITE_OFFS / net_book) * F.col("ring_share")
    x = x.withColumn("avoided", exposure * F.col("ramp") * F.col("prevention")).withColumn("recovered", exposure * F.col("recovery") * F.col("ramp") * F.col("prevention"))
    x = x.withColumn("cost", F.col("base_cost") + PARAMS["friction"] * F.col("covered")).withColumn("net", F.col("avoided") + F.col("recovered") - F.col("cost"))
    return x.select("draw", "year", "covered", "avoided", "recovered", "cost", "net", (F.col("net") / F.pow(F.lit(1 + PARAMS["discount"]), F.col("year"))).alias("pv"))


def base_draw(spark: SparkSession) -> DataFrame:
    """The deterministic parameters as a single draw."""
    return spark.createDataFrame([(0, PARAMS["ring_share"], PARAMS["prevention"], PARAMS["recovery"])], "draw long, ring_share double, prevention double, recovery double")


def monte_carlo(spark: SparkSession, net_book: float, n: int = 4000, seed: int = 7) -> DataFrame:
    """P10, P50, P90 of the net present value and the share above zero."""
    u = lambda lo, hi, s: F.lit(lo) + (hi - lo) * F.rand(seed + s)
    draws = spark.range(n).select(F.col("id").alias("draw"), u(0.10, 0.30, 1).alias("ring_share"), u(0.3, 0.6, 2).alias("prevention"), u(0.05, 0.15, 3).alias("recovery"))
    npv = cash_flow(draws, net_book).groupBy("draw").agg(F.sum("pv").alias("npv"))
    return npv.agg(F.percentile("npv", 0.1).alias("p10"), F.percentile("npv", 0.5).alias("p50"), F.percentile("npv", 0.9).alias("p90"), F.avg((F.col("npv") > 0).cast("double")).alias("share_positive"))
