"""Cluster scores: concentration, burst, density, corroboration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluation import numbered, percentiles

AXES = ("device", "account", "person", "guarantor", "burst")


def ring_scores(member: DataFrame, apps: DataFrame, inc: DataFrame, edges: DataFrame, min_size: int = 3, window: int = 14, by: str | None = None) -> DataFrame:
    """Score clusters ``member(cluster, app_id)`` of at least ``min_size`` applications.

    Concentration of a relation is 1 - distinct nodes / applications (guarantor: / links, from
    two links on); burst is the densest ``window`` days' share; density the linked pairs' share.
    With ``by`` (a column of ``member``, such as a snapshot, that each cluster has one value of), hot scores
    and ranks are taken among the applications and clusters of one value.
    """
    keys = [by] if by else []
    m = member.join(apps.select("app_id", "day", "score"), "app_id")
    hot = percentiles(m if by else apps, "score", [0.95], keys).withColumnRenamed("p0", "p95")
    size = m.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    m = m.join(size.select("cluster"), "cluster", "left_semi")
    m = m.join(hot, keys) if by else m.crossJoin(F.broadcast(hot))  # one row
    in14 = Window.partitionBy("cluster").orderBy("day").rangeBetween(0, window)
    base = m.withColumn("w", F.count("*").over(in14)).groupBy("cluster", *keys).agg(F.count("*").alias("n"), F.max("w").alias("w14"), F.avg("score").alias("mean_score"), F.avg((F.col("score") > F.col("p95")).cast("double")).alias("frac_hot"), (F.max("day") - F.min("day")).alias("span"))
    rel = member.join(inc, "app_id").groupBy("cluster").agg(*[x for r in AXES[:4] for x in (F.countDistinct(F.when(F.col("relation") == r, F.col("node"))).alias(f"d_{r}"), F.count(F.when(F.col("relation") == r, 1)).alias(f"l_{r}"))])
    s, d = member.select(F.col("app_id").alias("src"), F.col("cluster").alias("c1")), member.select(F.col("app_id").alias("dst"), F.col("cluster").alias("c1"))
    dens = edges.join(s, "src").join(d, ["dst", "c1"]).groupBy(F.col("c1").alias("cluster")).agg(F.count("*").alias("links"))
    return ranked(base.join(rel, "cluster", "left").join(dens, "cluster", "left"), keys)


def ranked(j: DataFrame, keys=()) -> DataFrame:
    """Scores from the counts of clusters: ``cluster``, ``keys``, ``n, w14, mean_score, frac_hot, span, links``, distinct nodes ``d_<relation>``, ``l_guarantor``.

    Ranks are taken among the clusters of one value of ``keys``.
    """
    keys = list(keys)
    conc = lambda r: F.greatest(F.lit(0.0), 1 - F.coalesce(f"d_{r}", F.lit(0)) / F.col("n")).alias(r)
    guar = F.when(F.col("l_guarantor") >= 2, 1 - F.col("d_guarantor") / F.col("l_guarantor")).otherwise(0.0).alias("guarantor")
    j = j.select("*", conc("device"), conc("account"), conc("person"), guar, (F.col("w14") / F.col("n")).alias("burst"), F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))
    top = F.greatest(*AXES)
    j = numbered(j.withColumn("structural", 0.8 * top + 0.2 * F.col("density")), [F.asc("mean_score"), F.asc("cluster")], keys)
    count = j.groupBy(*keys).agg(F.count("*").alias("cnt"))
    j = (j.join(count, keys) if keys else j.crossJoin(F.broadcast(count))).withColumn("r01", F.when(F.col("cnt") > 1, (F.col("place") - 1) / (F.col("cnt") - 1)).otherwise(0.0))  # one row
    dom = F.coalesce(*[F.when(F.col(a) == top, F.lit(a)) for a in AXES])
    j = j.withColumn("corroboration", 0.5 * F.col("r01") + 0.5 * F.col("frac_hot")).withColumn("ring_score", 0.65 * F.col("corroboration") + 0.35 * F.col("structural"))
    return j.select("cluster", *keys, "n", *AXES, "density", "mean_score", "frac_hot", "span", "structural", "corroboration", "ring_score", dom.alias("dominant_axis"))


def judged(scored: DataFrame, member: DataFrame, apps: DataFrame, min_members: int = 3) -> DataFrame:
    """Add ``n_fraud`` and ``is_true``: a cluster is a true ring if ``min_members`` of its applications belong to one ring.

    ``member(cluster, app_id)``, ``apps(app_id, ring)`` with rings from 1 on; others are no ring.
    """
    of = member.join(apps.where("ring > 0").select("app_id", "ring"), "app_id").groupBy("cluster", "ring").agg(F.count("*").alias("c"))
    per = of.groupBy("cluster").agg(F.sum("c").alias("n_fraud"), F.max("c").alias("largest"))
    out = scored.join(per, "cluster", "left")
    return out.select(*scored.columns, F.coalesce("n_fraud", F.lit(0)).cast("long").alias("n_fraud"), (F.coalesce("largest", F.lit(0)) >= min_members).alias("is_true"))


def budget(rings: DataFrame, total_fraud: DataFrame, clusters: int = 25) -> DataFrame:
    """What reviewing the best k clusters costs and finds: ``k, apps_reviewed, fraud_caught, recall, precision_clusters``.

    ``rings`` from ``judged``; ``total_fraud`` is one row with ``total``. A top-k report of ``clusters`` rows.
    """
    top = rings.orderBy(F.desc("ring_score"), "cluster").limit(clusters)
    best = Window.orderBy(F.desc("ring_score"), "cluster")
    k = top.withColumn("k", F.row_number().over(best)).crossJoin(F.broadcast(total_fraud))  # at most ``clusters`` rows
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    caught = F.sum("n_fraud").over(run)
    return k.select("k", F.sum("n").over(run).alias("apps_reviewed"), caught.alias("fraud_caught"), (caught / F.greatest("total", F.lit(1))).alias("recall"), F.avg(F.col("is_true").cast("double")).over(run).alias("precision_clusters"))


def at_threshold(rings: DataFrame, total_fraud: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row about the clusters that score at least ``threshold``, against all true rings and all fraud."""
    hi, true = F.col("ring_score") >= threshold, F.col("is_true")
    num = lambda c: F.count(F.when(c, 1))
    t = rings.agg(F.count("*").alias("clusters"), num(true).alias("true_rings"), num(hi).alias("flagged"), num(hi & true).alias("true_flagged"), F.coalesce(F.sum(F.when(hi, F.col("n_fraud"))), F.lit(0)).alias("fraud_covered"), num(hi & ~true).alias("false_positives"))
    false = percentiles(rings.where(hi & ~true), "n", [0.5]).withColumnRenamed("p0", "fp_median_apps")
    t = t.crossJoin(F.broadcast(total_fraud)).crossJoin(F.broadcast(false.agg(F.max("fp_median_apps").alias("fp_median_apps"))))  # one row each
    return t.select("clusters", "true_rings", "flagged", "true_flagged", (F.col("true_flagged") / F.greatest("true_rings", F.lit(1))).alias("ring_recall"), F.when(F.col("flagged") > 0, F.col("true_flagged") / F.col("flagged")).alias("precision"), "fraud_covered", (F.col("fraud_covered") / F.greatest("total", F.lit(1))).alias("app_recall"), "false_positives", F.coalesce("fp_median_apps", F.lit(0.0)).alias("fp_median_apps"))
