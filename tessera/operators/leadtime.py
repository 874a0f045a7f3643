"""Replay of a portfolio's growth: at which snapshot would scored clusters have shown each ring?

Snapshots only grow, so none is built: a cluster is kept as its history. Where two
clusters merge, the one with the smaller application goes on and the other ends; what
a cluster counts (applications, nodes, links, ring members) is added up over the places
at which something joined it. Only clusters of scorable size are listed by snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluation import percentiles, ranged
from tessera.operators.components import connected_components
from tessera.operators.rings import AXES, ranked
from tessera.sources.workdir import written

THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
MIN_SIZES = (3, 4, 5, 6, 8)
SHIFT = 44  # ids of applications are below 2 ** SHIFT


def absorbed(links: DataFrame, places: int, ways: int = 6) -> DataFrame:
    """How components of a growing graph end: ``node, at, into``.

    ``links``: ``u, v, at``, ``at`` the place (0 to ``places`` - 1) from which on the link is there. For each vertex that does
    not stay the smallest of its component: the first place at which it is not, and the smallest one there.

    Places are refined ``ways`` by ``ways``. A level finds the components at its places, and each link goes on only into the
    stretch between two of them in which it appears, its ends replaced by their components at the stretch's start. So a link
    stands at most ``ways`` times on a level, and the levels grow with the logarithm of the places.
    """
    strides = [1]
    while strides[0] < places:
        strides.insert(0, strides[0] * ways)
    low = F.lit((1 << SHIFT) - 1)
    cur, found, outer = links.where(F.col("u") != F.col("v")).select("u", "v", "at"), None, strides[0]
    for stride in strides:
        cur = written(cur.groupBy("u", "v", F.floor(F.col("at") / outer).alias("stretch")).agg(F.min("at").alias("at")), "replay-links")
        first, last = F.ceil(F.col("at") / stride), F.least((F.col("stretch") + 1) * (outer // stride) - 1, F.lit((places - 1) // stride).cast("long"))
        here = cur.where(first <= last).withColumn("place", F.explode(F.when(first <= last, F.sequence(first * stride, last * stride, F.lit(stride).cast("long")))))
        vertex = lambda c: (F.shiftleft(F.col("place").cast("long"), SHIFT) + F.col(c)).alias(c)
        comp = connected_components(here.select(vertex("u"), vertex("v")), "u", "v")
        label = written(comp.select(F.shiftright("node", SHIFT).alias("place"), F.col("node").bitwiseAND(low).alias("node"), F.col("component").bitwiseAND(low).alias("into")).where("node <> into"), "replay-level")
        found = label if found is None else found.unionByName(label)
        if stride > 1:
            inside = cur.where(F.col("at") % stride != 0).withColumn("place", F.col("at") - F.col("at") % stride)
            for end in ("u", "v"):
                to = label.select("place", F.col("node").alias(end), "into")
                inside = inside.join(to, ["place", end], "left").withColumn(end, F.coalesce("into", end)).drop("into")
            cur = inside.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "at")
        outer = stride
    return found.groupBy("node").agg(F.min(F.struct(F.col("place").alias("at"), "into")).alias("x")).select("node", "x.at", "x.into")


def memberships(present: DataFrame, inc: DataFrame, relations, places: int, min_size: int = 3) -> DataFrame:
    """Return ``cluster, app_id, start, end``: the application is in the cluster at places ``start`` to ``end`` - 1.

    ``present``: ``app_id, place``, the first place that has the application. A cluster is named by its smallest application.
    Applications whose cluster has fewer than ``min_size`` in the end are left out, as it never had more before.
    """
    on = inc.where(F.col("relation").isin(list(relations))).join(present, "app_id")
    first = on.groupBy("relation", "node").agg(F.min(F.struct("place", "app_id")).alias("first"))
    links = on.join(first, ["relation", "node"]).select(F.col("app_id").alias("u"), F.col("first.app_id").alias("v"), F.col("place").alias("at"))
    ends = written(absorbed(links, places), "replay-absorbed")
    linked = ends.select(F.col("node").alias("app_id")).unionByName(ends.select(F.col("into").alias("app_id"))).distinct()
    step = present.join(linked, "app_id", "left_semi" if min_size > 1 else "left").select(F.col("app_id").alias("cluster"), "app_id", F.col("place").alias("start"))
    out = None
    while True:  # as often as the longest line of merges
        step = written(step.join(ends, F.col("cluster") == F.col("node"), "left").select("cluster", "app_id", "start", F.coalesce("at", F.lit(places).cast("long")).alias("end"), "into"), "replay-steps")
        out = step if out is None else out.unionByName(step)
        more = step.where("into is not null")
        if more.isEmpty():
            break
        step = more.select(F.col("into").alias("cluster"), "app_id", F.col("end").alias("start"))
    last = out.where("into is null")
    large = last.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    kept = last.join(large.select("cluster"), "cluster", "left_semi").select("app_id")
    return out.where("start < end").join(kept, "app_id", "left_semi").select("cluster", "app_id", "start", "end")


def percentile_by_place(rows: DataFrame, column: str, places: int, share: float) -> DataFrame:
    """Exact percentile, with linear interpolation, of the rows up to each place: ``place, value``; ``rows`` hold ``place`` and the column.

    Counts of ranges of values tell which range holds a place's percentile; only that range's values are read for it.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"), "place").agg(F.count("*").alias("n"))
    counts = written(ranged(counts, "value"), "replay-counts")
    every = rows.sparkSession.range(places).withColumnRenamed("id", "place")
    grid = counts.select("__range").distinct().crossJoin(F.broadcast(every))  # at most 256 rows a place
    cells = grid.join(counts.groupBy("__range", "place").agg(F.sum("n").alias("n")), ["__range", "place"], "left")
    until = Window.partitionBy("__range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("place").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("n", F.coalesce(F.sum("n").over(until), F.lit(0))).withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    at = (F.sum("n").over(Window.partitionBy("place")) - 1) * F.lit(float(share))
    has = lambda x: (F.col("before") <= x) & (x < F.col("before") + F.col("n"))
    cells = cells.withColumn("at", at).where(has(F.floor("at")) | has(F.ceil("at"))).select("__range", F.col("place").alias("upto"), "before", "at")
    near = counts.join(F.broadcast(cells), "__range").where("place <= upto")  # at most two rows a place
    near = near.groupBy("upto", "__range", "before", "at", "value").agg(F.sum("n").alias("n"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy("upto", "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("run", run)
    pick = lambda x: F.min(F.when(F.col("run") > x, F.col("value")))
    out = near.groupBy(F.col("upto").alias("place")).agg(pick(F.floor("at")).alias("low"), pick(F.ceil("at")).alias("high"), F.max(F.col("at") - F.floor("at")).alias("part"))
    return out.select("place", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def replay(apps: DataFrame, inc: DataFrame, edges: DataFrame, relations, days: list[int], min_members: int = 3, min_size: int = 3, window: int = 14) -> DataFrame:
    """Return ``snap, cluster, n, ring_score, ring, members`` of every scored cluster; ring and members are null without a ring.

    A row for each ring that has ``min_members`` applications in the cluster; one with nulls if no ring has any.
    ``apps``: ``app_id, day, score, ring`` (rings from 1 on). Applications are scored as given; the model is the caller's.
    ``cluster`` names the snapshot's place and the smallest application: place * 2 ** SHIFT + id. Scores are those of
    ``ring_scores`` on the applications up to the snapshot's day.
    """
    days = sorted(set(days))
    listed = f"array({', '.join(map(str, days))})"
    place = written(apps.where("day is not null").select("day").distinct().withColumn("place", F.expr(f"cast(size(filter({listed}, d -> d < day)) as bigint)")), "replay-days")
    present = written(apps.join(place.where(F.col("place") < len(days)), "day").select("app_id", "day", "score", "ring", "place"), "replay-present")
    member = written(memberships(present.select("app_id", "place"), inc, relations, len(days), min_size), "replay-members")
    m = written(member.join(present.drop("place"), "app_id"), "replay-rows")
    # What joins a cluster at each place, and its sums up to there.
    one = m.groupBy("cluster", "start").agg(F.count("*").alias("n"), F.count("score").alias("scores"), F.sum("score").alias("score"), F.min("day").alias("low"), F.max("day").alias("high"), F.max("end").alias("end"))
    on = member.join(inc.where(F.col("relation").isin(list(AXES[:4]))), "app_id")
    nodes = written(on.groupBy("cluster", "relation", "node", "start").agg(F.count("*").alias("links")), "replay-nodes")
    guarantors = nodes.where("relation = 'guarantor'").groupBy("cluster", "start").agg(F.sum("links").alias("l_guarantor"))
    fresh = nodes.groupBy("cluster", "relation", "node").agg(F.min("start").alias("start"))
    fresh = fresh.groupBy("cluster", "start").agg(*[F.count(F.when(F.col("relation") == r, 1)).alias(f"d_{r}") for r in AXES[:4]])
    ends = lambda name: member.select(F.col("app_id").alias(name), "cluster", F.col("start").alias(f"{name}_start"))
    pairs = edges.join(ends("src"), "src").join(ends("dst"), ["dst", "cluster"]).groupBy("cluster", F.greatest("src_start", "dst_start").alias("start")).agg(F.count("*").alias("links"))
    joined = one
    for part in (guarantors, fresh, pairs):
        joined = joined.unionByName(part, allowMissingColumns=True)
    sums = ["n", "scores", "score", "l_guarantor", *[f"d_{r}" for r in AXES[:4]], "links"]
    joined = joined.groupBy("cluster", "start").agg(*[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"), F.max("end").alias("end"))
    line = Window.partitionBy("cluster").orderBy("start")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    state = joined.select("cluster", "start", F.coalesce(F.lead("start").over(line), "end").alias("end"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in sums], (F.max("high").over(upto) - F.min("low").over(upto)).alias("span"))
    state = written(state.where(F.col("n") >= min_size), "replay-states")
    # The densest days of each state, from its counts by day.
    by_day = m.groupBy("cluster", "day", F.col("start").alias("since")).agg(F.count("*").alias("c"))
    dense = state.select("cluster", "start").join(by_day, "cluster").where("since <= start").groupBy("cluster", "start", "day").agg(F.sum("c").alias("c"))
    dense = dense.withColumn("w", F.sum("c").over(Window.partitionBy("cluster", "start").orderBy("day").rangeBetween(0, window))).groupBy("cluster", "start").agg(F.max("w").alias("w14"))
    bar = written(percentile_by_place(present, "score", len(days), 0.95).withColumnRenamed("value", "p95"), "replay-hot")
    least = bar.agg(F.min("p95").alias("least"))
    hot = m.join(F.broadcast(least), F.col("score") > F.col("least")).withColumn("place", F.explode(F.sequence("start", F.col("end") - 1)))
    hot = hot.join(F.broadcast(bar), "place").where("score > p95").groupBy("cluster", "place").agg(F.count("*").alias("hot"))  # a row a place
    some = F.when(F.col("scores") > 0, F.col("scores"))
    j = state.join(dense, ["cluster", "start"]).withColumn("place", F.explode(F.sequence("start", F.col("end") - 1))).join(hot, ["cluster", "place"], "left").join(F.broadcast(bar.select("place")), "place")
    snap = F.expr(f"element_at({listed}, cast(place + 1 as int))").alias("snap")
    j = j.select((F.shiftleft("place", SHIFT) + F.col("cluster")).alias("cluster"), snap, "n", "w14", (F.col("score") / some).alias("mean_score"), (F.coalesce("hot", F.lit(0)) / some).alias("frac_hot"), "span", *[f"d_{r}" for r in AXES[:4]], "l_guarantor", "links")
    scored = ranked(written(j, "replay-clusters"), ["snap"]).select("snap", "cluster", "n", "ring_score")
    scored = scored.withColumn("id", F.col("cluster").bitwiseAND(F.lit((1 << SHIFT) - 1))).withColumn("place", F.shiftright("cluster", SHIFT))
    of = Window.partitionBy("id", "ring").orderBy("start")
    rings = m.where("ring > 0").groupBy(F.col("cluster").alias("id"), "ring", "start").agg(F.count("*").alias("members"))
    rings = rings.select("id", "ring", "start", F.coalesce(F.lead("start").over(of), F.lit(len(days))).alias("until"), F.sum("members").over(of.rowsBetween(Window.unboundedPreceding, 0)).alias("members"))
    r = rings.withColumnRenamed("id", "of")
    both = scored.join(r, (F.col("id") == F.col("of")) & (F.col("start") <= F.col("place")) & (F.col("place") < F.col("until")), "left")
    return both.where(F.col("ring").isNull() | (F.col("members") >= min_members)).select("snap", "cluster", "n", "ring_score", "ring", "members")


def sweep(found: DataFrame, apps: DataFrame, cutoff: int, thresholds=THRESHOLDS, min_sizes=MIN_SIZES) -> DataFrame:
    """Lead times for each threshold and least cluster size.

    ``threshold, min_size, detected, before_completion, median_lead, false_clusters, evaluable``. A ring counts if its last
    application comes after ``cutoff``; it is detected at the first snapshot with a flagged cluster that holds it; the median is
    over leads above 0. A flagged cluster without a ring is false, counted once by its smallest application.
    """
    combos = ", ".join(f"struct({t}D as threshold, {m} as min_size)" for t in thresholds for m in min_sizes)
    flagged = found.where("ring is not null").withColumn("c", F.explode(F.expr(f"filter(array({combos}), c -> ring_score >= c.threshold and n >= c.min_size)"))).select("c.threshold", "c.min_size", "snap", "cluster", "ring")
    done = apps.where("ring > 0").groupBy("ring").agg(F.max("day").alias("completion")).where(F.col("completion") > cutoff)
    seen = flagged.join(done, "ring").groupBy("threshold", "min_size", "ring").agg((F.max("completion") - F.min("snap")).alias("lead"))
    hits = seen.groupBy("threshold", "min_size").agg(F.count("*").alias("detected"), F.count(F.when(F.col("lead") > 0, 1)).alias("before_completion"))
    median = percentiles(seen.where("lead > 0"), "lead", [0.5], ["threshold", "min_size"]).withColumnRenamed("p0", "median_lead")
    # One row a false cluster: its best score at each least size.
    best = lambda m: F.max(F.when(F.col("n") >= m, F.col("ring_score"))).alias(f"best{m}")
    alone = found.where("ring is null").groupBy(F.col("cluster").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("id")).agg(*[best(m) for m in min_sizes])
    reached = ", ".join(f"struct({t}D as threshold, {m} as min_size, best{m} as best)" for t in thresholds for m in min_sizes)
    false = alone.withColumn("c", F.explode(F.expr(f"filter(array({reached}), c -> c.best >= c.threshold)"))).groupBy("c.threshold", "c.min_size").agg(F.count("*").alias("false_clusters"))
    spark = found.sparkSession
    every = spark.createDataFrame([(float(t), int(m)) for t in thresholds for m in min_sizes], "threshold double, min_size int")
    keys = ["threshold", "min_size"]
    out = every.join(hits, keys, "left").join(median, keys, "left").join(false, keys, "left").crossJoin(F.broadcast(done.agg(F.count("*").alias("evaluable"))))  # one row
    return out.fillna(0, ["detected", "before_completion", "false_clusters"]).select(*keys, "detected", "before_completion", "median_lead", "false_clusters", "evaluable")


def chosen(swept: DataFrame, most_false: int = 75) -> DataFrame:
    """The setting to run: of those that show half the evaluable rings before completion with at most ``most_false``
    false clusters the one with fewest false, then the longest lead; if there is none, the one with fewest false.
    """
    need = F.greatest(F.lit(1), F.floor(F.col("evaluable") * 0.5))
    viable = (F.col("before_completion") >= need) & (F.col("false_clusters") <= most_false)
    lead = F.when(viable, -F.coalesce("median_lead", F.lit(0.0))).otherwise(0.0)
    return swept.withColumn("viable", viable).orderBy(F.desc("viable"), "false_clusters", lead, "threshold", "min_size").limit(1)
