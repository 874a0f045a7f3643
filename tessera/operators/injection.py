"""Rings planted into a foreign graph, for tests of what a method finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluation import numbered, percentiles


def _below(n, *key):
    """A whole number from 0 to n - 1 drawn by hash."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (str, int)) else k for k in key]), n)


def inject_rings(edges: DataFrame, vertices: DataFrame, rings: int, low: int = 8, high: int = 20, extra: int = 6, camouflage: float = 0.0, seed: int = 0):
    """Return ``(edges, labels)``: the graph with planted rings, and ``app_id, y, ring`` (0: none) for every vertex.

    Members have at least the median degree, each in one ring of ``low`` to ``high``; rings that the pool
    cannot fill are left out. A ring of k members gets ``extra * k // 2`` drawn links between two of
    them, and ``int(k * camouflage)`` unlabelled outsiders with a link each. Edges ``src < dst``
    count once each. Draws are hashes of ``seed``, so reruns agree; only ring sizes (``rings`` rows) are broadcast.
    """
    spark = edges.sparkSession
    simple = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
    ends = simple.distinct().select(F.explode(F.array("src", "dst")).alias("app_id")).groupBy("app_id").agg(F.count("*").alias("degree"))
    degree = vertices.select("app_id").distinct().join(ends, "app_id", "left").fillna(0, ["degree"])
    middle = percentiles(degree, "degree", [0.5])
    pool = degree.crossJoin(F.broadcast(middle)).where("degree >= p0").select("app_id")  # one row
    pool = numbered(pool.withColumn("h", F.xxhash64(F.lit(seed), "app_id")), [F.asc("h"), F.asc("app_id")])

    size = spark.range(1, rings + 1, 1, 1).select(F.col("id").alias("ring"), (low + _below(F.lit(high - low + 1), seed, "size", F.col("id"))).alias("k"))
    sized = size.toPandas()  # a row a ring, a parameter
    sized["last"] = sized["k"].cumsum()
    sized["cover"] = (sized["k"] * camouflage).astype("int64")
    sized["cover_last"] = sized["cover"].cumsum()
    n = pool.count()
    whole = spark.createDataFrame(sized[sized["last"] <= n].astype("int64").values.tolist(), "ring long, k long, last long, cover long, cover_last long")
    places = F.broadcast(whole.select("ring", "k", F.posexplode(F.sequence(F.col("last") - F.col("k") + 1, F.col("last"))).alias("i", "place")))
    member = pool.join(places, "place").select("ring", "k", "i", "app_id")

    links = whole.where(F.lit(extra) * F.col("k") >= 2).select("ring", "k", F.explode(F.sequence(F.lit(1), F.floor(F.lit(extra) * F.col("k") / 2).cast("int"))).alias("e"))
    links = links.withColumn("i", _below(F.col("k"), seed, "a", F.col("ring"), F.col("e")))
    links = links.withColumn("j", F.pmod(F.col("i") + 1 + _below(F.col("k") - 1, seed, "b", F.col("ring"), F.col("e")), F.col("k")))
    one, two = member.select("ring", "i", F.col("app_id").alias("a")), member.select("ring", F.col("i").alias("j"), F.col("app_id").alias("b"))
    planted = links.join(one, ["ring", "i"]).join(two, ["ring", "j"]).select("a", "b")

    outside = ends.join(member.select("app_id"), "app_id", "left_anti").withColumn("h", F.xxhash64(F.lit(seed + 1), "app_id"))
    outside = numbered(outside, [F.asc("h"), F.asc("app_id")])
    m = outside.count() if camouflage > 0 else 0
    if m:
        cover = whole.where((F.col("cover") > 0) & (F.col("cover") <= m)).select("ring", "k", F.explode(F.sequence(F.col("cover_last") - F.col("cover"), F.col("cover_last") - 1)).alias("c"))
        cover = cover.select("ring", (F.col("c") % m + 1).alias("place"), _below(F.col("k"), seed, "c", F.col("ring"), F.col("c")).alias("i"))
        planted = planted.union(cover.join(outside.select("place", F.col("app_id").alias("b")), "place").join(one, ["ring", "i"]).select("a", "b"))

    out = simple.union(planted.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    labels = vertices.select("app_id").distinct().join(member.select("app_id", "ring"), "app_id", "left")
    return out, labels.select("app_id", F.when(F.col("ring").isNotNull(), 1).otherwise(0).alias("y"), F.coalesce("ring", F.lit(0)).alias("ring"))
