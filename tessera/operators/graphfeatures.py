"""Graph features from incidence rows, as node-grouped sums: no pair of applications is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(inc: DataFrame) -> DataFrame:
    """Per relation and application: nodes (deg), mean applications on them (node_deg), pairs through them (co)."""
    size = inc.groupBy("relation", "node").agg(F.count("*").alias("nd"))
    return inc.join(size, ["relation", "node"]).groupBy("relation", "app_id").agg(F.count("*").alias("deg"), F.avg("nd").alias("node_deg"), F.sum(F.col("nd") - 1).alias("co"))


def hub_filtered(inc: DataFrame, cap: int) -> DataFrame:
    """Incidence rows of nodes with at most ``cap`` applications."""
    hubs = inc.groupBy("relation", "node").agg(F.count("*").alias("nd")).where(F.col("nd") > cap)
    return inc.join(hubs, ["relation", "node"], "left_anti")


def pair_edges(inc: DataFrame, relations) -> DataFrame:
    """Undirected edges ``src < dst`` with the number of shared nodes as weight.

    Quadratic in a node's applications by definition; filter hubs first.
    """
    r = inc.where(F.col("relation").isin(list(relations)))
    a, b = r.withColumnRenamed("app_id", "src"), r.withColumnRenamed("app_id", "dst")
    return a.join(b, ["relation", "node"]).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def star_edges(inc: DataFrame, relations, cap: int | None = None) -> DataFrame:
    """Edges from each application to the smallest one on each of its nodes: linear, same components."""
    r = inc.where(F.col("relation").isin(list(relations)))
    if cap is not None:
        r = hub_filtered(r, cap)
    low = r.groupBy("relation", "node").agg(F.min("app_id").alias("low"))
    return r.join(low, ["relation", "node"]).select(F.col("app_id").alias("a"), F.col("low").alias("b")).distinct()


def bursts(inc: DataFrame, days: DataFrame, windows=(7, 30)) -> DataFrame:
    """Other applications on the same nodes within +/- w days, summed over nodes; a missing day counts as 0."""
    base = inc.join(days.select("app_id", "day"), "app_id", "left").withColumn("day", F.coalesce("day", F.lit(0)))
    for w in windows:
        frame = Window.partitionBy("relation", "node").orderBy("day").rangeBetween(-w, w)
        base = base.withColumn(f"b{w}", F.count("*").over(frame) - 1)
    return base.groupBy("relation", "app_id").agg(*[F.sum(f"b{w}").alias(f"burst_{w}d") for w in windows])


def entropies(inc: DataFrame, who: DataFrame) -> DataFrame:
    """Entropy (nats) of the persons on a node with two or more applications; the largest of an application's nodes."""
    base = inc.join(who.select("app_id", F.col("cust").alias("who")), "app_id")
    cnt = base.groupBy("relation", "node", "who").agg(F.count("*").alias("c"))
    tot = cnt.groupBy("relation", "node").agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    ent = cnt.join(tot, ["relation", "node"]).groupBy("relation", "node").agg(F.when(F.max("t") >= 2, F.sum(-p * F.log(p + 1e-12))).otherwise(0.0).alias("h"))
    return inc.join(ent, ["relation", "node"]).groupBy("relation", "app_id").agg((F.max("h") + 0.0).alias("entropy"))


def neighbour_stats(inc: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """Mean, deviation and difference of a column over the neighbours, weighted by shared nodes; zeros without neighbours."""
    base = inc.join(values.select("app_id", F.col(col).cast("double").alias("v")), "app_id")
    node = base.groupBy("relation", "node").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    app = base.join(node, ["relation", "node"]).groupBy("relation", "app_id").agg(F.first("v").alias("v"), F.sum(F.col("n") - 1).alias("w"), F.sum(F.col("s") - F.col("v")).alias("s"), F.sum(F.col("q") - F.col("v") * F.col("v")).alias("q"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0)
    var = F.when(F.col("w") > 0, F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))).otherwise(0.0)
    return app.select("relation", "app_id", mean.alias("nbr_mean"), F.sqrt(var).alias("nbr_std"), F.when(F.col("w") > 0, F.col("v") - mean).otherwise(0.0).alias("nbr_diff"), F.when(F.col("w") > 0, 1).otherwise(0).alias("has_nbr"))


def two_hop(edges: DataFrame) -> DataFrame:
    """Walks of length two from each vertex to another one: the sum of its neighbours' degrees less its own."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    return both.join(deg.select(F.col("src").alias("dst"), "d"), "dst").groupBy("src").agg((F.sum("d") - F.count("*")).alias("walks2"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles at each vertex, by edges oriented from lower to higher degree."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    e = edges.select("src", "dst").join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.expr("ds < dd or (ds = dd and src < dst)")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    open_ = o.alias("x").join(o.select("a", F.col("b").alias("c")).alias("y"), "a").where("b < c").select("a", "b", "c")
    closed = open_.join(edges.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("app_id")).groupBy("app_id").agg(F.count("*").alias("triangles"))


def pagerank(edges: DataFrame, vertices: DataFrame, iterations: int = 30, alpha: float = 0.85, seeds: DataFrame | None = None, tol: float | None = None) -> DataFrame:
    """Power iteration ``app_id, rank``.

    Without ``seeds`` the teleport is uniform, edges count once each and the mass of isolated vertices is
    spread; with seeds (``app_id``) it returns to them in equal shares, edges are weighted and isolated mass
    is lost. With ``tol`` it ends once the ranks move by less than that in sum.
    """
    spark = edges.sparkSession
    w = F.col("weight") if seeds is not None else F.lit(1)
    both = edges.select("src", "dst", w.alias("w")).union(edges.select("dst", "src", w))
    out = both.groupBy("src").agg(F.sum("w").alias("tot"))
    n = vertices.count()
    if seeds is not None:
        start = vertices.join(seeds.select("app_id", F.lit(1.0 / max(1, seeds.count())).alias("s")), "app_id", "left").select("app_id", F.coalesce("s", F.lit(0.0)).alias("tele"))
    else:
        start = vertices.select("app_id", F.lit(1.0 / max(1, n)).alias("tele"))
    state = start.join(out, start["app_id"] == out["src"], "left").select("app_id", "tele", "tot", F.col("tele").alias("rank"))
    from tessera.sources.workdir import written

    both, state = written(both, "pr-edges"), written(state, "pr-state")
    for _ in range(iterations):
        leak = 0.0 if seeds is not None else (state.where("tot is null").agg(F.sum("rank")).first()[0] or 0.0)
        flow = both.join(state.select("app_id", (F.col("rank") / F.col("tot")).alias("r")), both["src"] == F.col("app_id")).groupBy("dst").agg(F.sum(F.col("r") * F.col("w")).alias("inflow"))
        base = (1 - alpha) * F.col("tele") + (alpha * leak / max(1, n))
        moved = state.join(flow, state["app_id"] == flow["dst"], "left").select("app_id", "tele", "tot", (alpha * F.coalesce("inflow", F.lit(0.0)) + base).alias("rank"), F.col("rank").alias("old"))
        state = written(moved, "pr-state", drops=(state,))
        if tol is not None and (state.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tol:
            break
    return state.select("app_id", "rank")


def rank_normalised(ranks: DataFrame, digits: int = 12) -> DataFrame:
    """``app_id, centrality``: 1 for the highest ``rank``, 0 for the lowest, evenly between; ties (to ``digits``) by id."""
    from tessera.functions.evaluation import numbered

    placed = numbered(ranks.select("app_id", F.round("rank", digits).alias("r")), [F.desc("r"), F.asc("app_id")])
    n = ranks.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("most"))
    return placed.crossJoin(F.broadcast(n)).select("app_id", (1 - (F.col("place") - 1) / F.col("most")).alias("centrality"))  # one row


def without_relation(columns, relation: str) -> list[str]:
    """The feature columns that do not come from ``relation``."""
    return [c for c in columns if f"_{relation}" not in c and not c.startswith(f"{relation}_")]


def cleaned(df: DataFrame, columns) -> DataFrame:
    """Infinite, NaN and null values of ``columns`` become zero."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.select(*[F.when(bad(c), 0.0).otherwise(F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns])
