"""Case notes for many applications in one job: shared nodes, extreme signals with words, drawable links, JSON parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluation import percentiles, running

# The words of a note for each signal, and whether a high value is the bad one.
PHRASES = {
    "co_device": ("shares its device fingerprint with {n} other application(s)", True),
    "co_account": ("disburses to an account used by {n} other application(s)", True),
    "co_person": ("same applicant identity as {n} other application(s)", True),
    "co_guarantor": ("shares a guarantor with {n} other application(s)", True),
    "co_dealer": ("sourced by a dealer also on {n} other application(s) in this cluster", True),
    "node_deg_device": ("its device fingerprint appears on {n} applications in total", True),
    "node_deg_account": ("its disbursement account appears on {n} applications in total", True),
    "node_deg_guarantor": ("its guarantor backs {n} applications in total", True),
    "device_burst_7d": ("{n} applications filed on this device within 7 days", True),
    "device_burst_30d": ("{n} applications filed on this device within 30 days", True),
    "account_burst_7d": ("{n} applications to this account within 7 days", True),
    "guarantor_burst_30d": ("{n} applications backed by this guarantor within 30 days", True),
    "component_size": ("sits inside a connected cluster of {n} applications", True),
    "entropy_device": ("low identity diversity on the shared device (entropy {n})", False),
    "entropy_account": ("low identity diversity on the shared account (entropy {n})", False),
}


def repeats(inc: DataFrame, few: int = 16) -> DataFrame:
    """``relation, app_id, again``: over the partners of an application the shared nodes beyond the first, where there are any.

    Applications with at most ``few`` nodes in a relation are met by pairs of nodes: a pair that w nodes link meets
    w (w - 1) / 2 times, and one that a single node links never. Pairs with a larger application are met node by node.
    """
    nodes = inc.groupBy("relation", "app_id").agg(F.count("*").alias("nodes")).where("nodes > 1")
    on = inc.join(nodes, ["relation", "app_id"])
    small = on.where(F.col("nodes") <= few).groupBy("relation", "app_id").agg(F.sort_array(F.collect_list("node")).alias("list"))
    first = small.select("relation", "app_id", "list", F.posexplode("list").alias("at", "n1"))
    twice = first.select("relation", "app_id", "n1", F.explode(F.slice("list", F.col("at") + 2, F.lit(few))).alias("n2"))
    key = ["relation", "n1", "n2"]
    shared = twice.join(twice.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1"), key)
    pairs = shared.join(shared.select(*key, F.col("app_id").alias("other")), key).where("app_id <> other")
    w = (F.sqrt(8 * F.count("*") + 1) + 1) / 2
    low = pairs.groupBy("relation", "app_id", "other").agg((F.round(w) - 1).cast("long").alias("again"))
    big = on.where(F.col("nodes") > few).select("relation", "node", F.col("app_id").alias("other"))
    met = on.select("relation", "node", "app_id", "nodes").join(big, ["relation", "node"]).where("app_id <> other")
    met = met.groupBy("relation", "app_id", "other", (F.col("nodes") <= few).alias("small")).agg((F.count("*") - 1).alias("again")).where("again > 0")
    back = met.where("small").select("relation", F.col("other").alias("app_id"), F.col("app_id").alias("other"), "again")
    return low.union(met.select("relation", "app_id", "other", "again")).union(back).groupBy("relation", "app_id").agg(F.sum("again").alias("again"))


def neighbours(inc: DataFrame, limit: int = 12) -> DataFrame:
    """Applications on the same nodes: ``relation, app_id, others`` (distinct) and ``sample``, the smallest ``limit`` ids.

    The sample comes from the first ``limit + 1`` applications of each node. Partners are counted through the nodes, less
    those met again (``repeats``), so only partners with several shared nodes are listed. ``inc`` is read several times.
    """
    key = ["relation", "node"]
    first = Window.partitionBy(*key).orderBy("app_id")
    placed = inc.withColumn("i", F.row_number().over(first))
    head = placed.groupBy(*key).agg(F.count("*").alias("nd"), F.collect_list(F.when(F.col("i") <= limit + 1, F.col("app_id"))).alias("head")).where("nd > 1")
    on = inc.join(head, key)
    app = on.groupBy("relation", "app_id").agg(F.sum(F.col("nd") - 1).alias("through"), F.flatten(F.collect_list("head")).alias("near"))
    shared = inc.join(head.select(*key), key, "left_semi")
    sample = F.slice(F.array_sort(F.array_distinct(F.filter("near", lambda x: x != F.col("app_id")))), 1, limit)
    return app.join(repeats(shared), ["relation", "app_id"], "left").select("relation", "app_id", (F.col("through") - F.coalesce("again", F.lit(0))).alias("others"), sample.alias("sample"))


def signal_notes(values: DataFrame, apps: DataFrame, top: int = 5, extreme: float = 0.5) -> DataFrame:
    """The most extreme signals of each application: ``app_id, feature, value, portfolio_percentile, text, place``.

    ``values``: ``feature, app_id, v``, at most a row each; features without a phrase are left
    out and applications without a row have value 0. A signal's strength is its distance from the median in
    quartile ranges (none where that range is zero), and it must exceed ``extreme``; ties by feature.
    """
    words = values.sparkSession.createDataFrame([(f, t, h) for f, (t, h) in PHRASES.items()], "feature string, words string, high boolean")
    known = values.select("feature").distinct().join(F.broadcast(words), "feature")  # at most a row a phrase
    grid = apps.select("app_id").crossJoin(F.broadcast(known))
    full = grid.join(values, ["feature", "app_id"], "left").withColumn("v", F.coalesce(F.round(F.col("v").cast("double"), 6), F.lit(0.0)))
    q = percentiles(full, "v", [0.25, 0.5, 0.75], ["feature"]).select("feature", F.col("p1").alias("median"), F.nullif(F.col("p2") - F.col("p0"), F.lit(0.0)).alias("spread"))
    counts = full.groupBy("feature", "v").agg(F.count("*").alias("n"))
    below = running(counts, ["feature"], "v", ["n"]).join(counts.groupBy("feature").agg(F.sum("n").alias("all")), "feature")
    z = (F.col("v") - F.col("median")) / F.col("spread")
    rank = full.join(F.broadcast(q), "feature").withColumn("strength", F.when(F.col("high"), z).otherwise(-z)).where(F.col("strength") > extreme)
    rank = rank.join(below.select("feature", "v", (F.round(100 * F.col("run_n") / F.col("all"), 1)).alias("portfolio_percentile")), ["feature", "v"])
    number = F.when(F.col("v") == F.floor("v"), F.col("v").cast("long").cast("string")).otherwise(F.round("v", 2).cast("string"))
    order = Window.partitionBy("app_id").orderBy(F.desc("strength"), "feature")
    out = rank.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top)
    return out.select("app_id", "feature", F.round("v", 3).alias("value"), "portfolio_percentile", F.replace("words", F.lit("{n}"), number).alias("text"), "place")


def drawable_edges(member: DataFrame, inc: DataFrame, relations, low: int = 3, high: int = 90) -> DataFrame:
    """Links inside clusters ``member(cluster, app_id)`` of ``low`` to ``high`` applications: ``relation, src, dst, weight``.

    Nodes are paired inside one cluster only, so no pair is built in a larger one.
    """
    fit = member.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    rows = inc.where(F.col("relation").isin(list(relations))).join(member.join(fit.select("cluster"), "cluster"), "app_id")
    a, b = rows.withColumnRenamed("app_id", "src"), rows.withColumnRenamed("app_id", "dst")
    return a.join(b, ["cluster", "relation", "node"]).where("src < dst").groupBy("relation", "src", "dst").agg(F.count("*").alias("weight"))


def write_payload(parts: dict[str, DataFrame], folder: str) -> None:
    """Write each part as JSON lines below ``folder``, nested columns kept, from the executors."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
