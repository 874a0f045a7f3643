"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluation import group_folds
from tessera.sources.workdir import new_path, removed, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    leaves = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Label every vertex that an edge touches with the smallest vertex of its component.

    Returns ``node, component``. Self loops and repeated edges are harmless,
    edges with a null end are ignored, no edges give no rows. Neighbour lists
    are never collected: each round is two min-aggregates and two equi-joins
    whose hot keys adaptive execution can split. Every round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = raw.where("u = v").select(F.col("u").alias("node")).distinct()
    path = new_path(spark, "cc")
    cur = written(raw.where("u <> v").distinct(), "cc", path)
    mark = None
    for _ in range(max_rounds):
        nxt_path = new_path(spark, "cc")
        nxt = written(_small_star(_large_star(cur)), "cc", nxt_path)
        removed(spark, path)
        cur, path = nxt, nxt_path
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    lone = loops.join(cur.select(F.col("u").alias("node")).unionByName(cur.select(F.col("v").alias("node"))).distinct(), "node", "left_anti")
    return pairs.unionByName(roots).unionByName(lone.select("node", F.col("node").alias("component")))


def component_folds(edges: DataFrame, vertices: DataFrame, folds: int, share: float = 0.5) -> tuple[DataFrame, bool]:
    """Folds ``app_id, fold`` that keep components whole, and whether they could not.

    ``edges`` holds ``src, dst``. When one component has more than ``share`` of the vertices, the group of a
    vertex is floor(ln(1 + degree)), at most 63: a weaker promise, hence the second value.
    """
    comp = connected_components(edges, "src", "dst")
    of = written(vertices.select("app_id").join(comp, F.col("app_id") == F.col("node"), "left").select("app_id", F.coalesce("component", "app_id").alias("group")), "fold-groups")
    total, largest = of.count(), of.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    giant = largest > share * total
    if giant:
        deg = edges.select("src").union(edges.select("dst")).groupBy("src").agg(F.count("*").alias("d"))
        of = vertices.select("app_id").join(deg, F.col("app_id") == F.col("src"), "left").select("app_id", F.least(F.floor(F.log1p(F.coalesce("d", F.lit(0)))), F.lit(63)).alias("group"))
    return of.join(group_folds(of, folds), "group").select("app_id", "fold"), giant
