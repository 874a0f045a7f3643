"""Suspicion spread from a few confirmed seeds, many draws at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluation import numbered, precision_of_counts
from tessera.sources.workdir import written


def draw_seeds(positives: DataFrame, counts=(3, 5, 10), repeats: int = 20, seed: int = 0) -> DataFrame:
    """``draw, k, app_id``: for each count ``k`` and repeat, the k positives with the smallest hashes."""
    draws = F.explode(F.array(*[F.struct(F.lit(i * repeats + r).alias("draw"), F.lit(k).alias("k")) for i, k in enumerate(counts) for r in range(repeats)]))
    every = positives.select("app_id", draws.alias("d")).select("d.*", "app_id")
    order = Window.partitionBy("draw", "k").orderBy(F.xxhash64(F.lit(seed), "draw", "app_id"), "app_id")
    return every.withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("k")).drop("i")


def spread(edges: DataFrame, seeds: DataFrame, iterations: int = 50, alpha: float = 0.85, cut: int = 10) -> DataFrame:
    """Seeded PageRank of every draw: ``draw, app_id, rank``, without the vertices that no seed reaches.

    All draws move in one job an iteration; the state is written every ``cut`` iterations. Seeds start
    with equal shares, or in proportion to a positive column ``weight``.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    step = written(both.join(both.groupBy("src").agg(F.sum("weight").alias("tot")), "src").select("src", "dst", (F.col("weight") / F.col("tot")).alias("share")), "spread-edges")
    weight = F.col("weight").cast("double") if "weight" in seeds.columns else F.lit(1.0)
    total = F.broadcast(seeds.groupBy("draw").agg(F.sum(weight).alias("all")))  # a row a draw
    start = written(seeds.join(total, "draw").select("draw", "app_id", (weight / F.col("all")).alias("rank")), "spread-seeds")
    back, state = start.withColumn("rank", (1 - alpha) * F.col("rank")), start
    for i in range(1, iterations + 1):
        flow = state.join(step, state["app_id"] == step["src"]).select("draw", F.col("dst").alias("app_id"), (alpha * F.col("rank") * F.col("share")).alias("rank"))
        state = flow.unionByName(back).groupBy("draw", "app_id").agg(F.sum("rank").alias("rank"))
        if i % cut == 0 or i == iterations:
            state = written(state, "spread-state")
    return state


def evaluate(edges: DataFrame, labelled: DataFrame, counts=(3, 5, 10), repeats: int = 20, iterations: int = 50, seed: int = 0) -> DataFrame:
    """Mean and deviation of the average precision over draws, seeds left out: ``k, draws, ap_mean, ap_sd``.

    ``labelled`` holds ``app_id, y``. Unreached vertices share score 0 and enter as one count a draw.
    """
    seeds = written(draw_seeds(labelled.where("y = 1"), counts, repeats, seed), "seeds")
    reached = spread(edges, seeds, iterations).join(seeds.select("draw", "app_id"), ["draw", "app_id"], "left_anti").join(labelled.select("app_id", "y"), "app_id")
    got = written(reached.groupBy("draw", F.round("rank", 15).alias("score")).agg(F.sum("y").cast("long").alias("p"), F.count("*").alias("n")), "spread-counts")
    n, p = labelled.agg(F.count("*"), F.sum("y")).first()
    used = seeds.groupBy("draw", "k").agg(F.count("*").alias("s"))
    left = used.join(got.groupBy("draw").agg(F.sum("p").alias("gp"), F.sum("n").alias("gn")), "draw", "left")
    rest = left.select("draw", F.lit(0.0).alias("score"), (F.lit(int(p or 0)) - F.col("s") - F.coalesce("gp", F.lit(0))).alias("p"), (F.lit(int(n)) - F.col("s") - F.coalesce("gn", F.lit(0))).alias("n"))
    counts_of = got.unionByName(rest).groupBy("draw", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("n > 0")
    ap = precision_of_counts(counts_of, ["draw"]).join(used.select("draw", "k"), "draw")
    return ap.groupBy("k").agg(F.count("*").alias("draws"), F.avg("ap").alias("ap_mean"), F.stddev_pop("ap").alias("ap_sd"))


def two_stage(edges: DataFrame, scored: DataFrame, shares=(0.01, 0.02, 0.05), alphas=(0.5, 0.7, 0.85), weights=(0.3, 0.5, 1.0), iterations: int = 50) -> DataFrame:
    """Spread a model's own highest scores and add what arrives: ``share, alpha, weight, ap, recall_at_5pct``.

    ``scored`` holds ``app_id, y, score`` (null: 0). The top ``share`` of rows (at least one, ties by id) are seeds, weighted
    by their scores (no seed has score 0 or less); score and spread are each divided by their maximum, and a
    weight multiplies the second. No label enters the spread.
    """
    base = written(numbered(scored.select("app_id", "y", F.coalesce("score", F.lit(0.0)).alias("score")), [F.desc("score"), F.asc("app_id")]), "two-stage")
    n, best, positives = base.agg(F.count("*"), F.max("score"), F.sum("y")).first()
    best, found = max(best or 0.0, 1e-12), None
    cutoffs = [(i, float(p), max(int(p * n), 1)) for i, p in enumerate(shares)]
    draw = base.sparkSession.createDataFrame(cutoffs, "draw int, share double, cutoff long")
    seeds = written(base.join(F.broadcast(draw), (F.col("place") <= F.col("cutoff")) & (F.col("score") > 0)).select("draw", "app_id", F.col("score").alias("weight")), "two-stage-seeds")
    for alpha in alphas:
        ranks = spread(edges, seeds, iterations, alpha)
        top = ranks.groupBy("draw").agg(F.greatest(F.max("rank"), F.lit(1e-12)).alias("most"))
        part = ranks.join(F.broadcast(top), "draw").select("draw", "app_id", (F.col("rank") / F.col("most")).alias("arrived"), F.lit(float(alpha)).alias("alpha"))
        found = part if found is None else found.unionByName(part)
    grid = draw.select("draw", "share").crossJoin(base.sparkSession.createDataFrame([(float(a), float(w)) for a in alphas for w in weights], "alpha double, weight double"))
    keys = ["draw", "share", "alpha", "weight"]
    every = base.select("app_id", "y", "score").crossJoin(F.broadcast(grid)).join(found, ["draw", "alpha", "app_id"], "left")  # a row a setting
    total = F.round(F.col("score") / best + F.col("weight") * F.coalesce("arrived", F.lit(0.0)), 12)
    every = written(every.select(*keys, "app_id", "y", total.alias("score")), "two-stage-scores")
    ap = precision_of_counts(every.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("p"), F.count("*").alias("n")), keys)
    hits = numbered(every, [F.desc("score"), F.asc("app_id")], keys).where(F.col("place") <= max(round(0.05 * n), 1)).groupBy(*keys).agg((F.sum("y") / F.lit(max(int(positives or 0), 1))).alias("recall_at_5pct"))
    return ap.join(hits, keys).select("share", "alpha", "weight", "ap", "recall_at_5pct")
