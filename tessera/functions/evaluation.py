"""Ranking metrics over (y, score) columns, and splits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import written


def numbered(df: DataFrame, order, keys=(), name: str = "place", parts: int | None = None) -> DataFrame:
    """Add the 1-based place of each row in ``order`` (columns that settle all ties), per non-null ``keys``.

    Rows are range-partitioned by keys and order and written; a task numbers its own range, and the
    numbers of rows before it (one row a range and key) are joined on. No task sees the whole table.
    """
    keys, order = list(keys), list(order)
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = written(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    whole = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "__range").agg(F.count("*").alias("__n")).select(*keys, "__range", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    out = cut.withColumn("__inside", F.row_number().over(inside)).join(before, [*keys, "__range"])
    return out.select(*df.columns, (F.col("__inside") + F.col("__before")).cast("long").alias(name))


def percentiles(df: DataFrame, column: str, shares, keys=()) -> DataFrame:
    """Exact percentiles with linear interpolation per ``keys``: one column ``p<i>`` for each of ``shares``.

    From running counts over the distinct values, so no buffer holds them all; nulls do not count.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__all"))
    run = running(counts, keys, "value", ["n"])
    run = run.join(total, list(keys)) if keys else run.crossJoin(F.broadcast(total))  # one row
    out = []
    for i, share in enumerate(shares):
        at = (F.col("__all") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("run_n") > F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("run_n") > F.ceil(at), F.col("value")))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"p{i}"))
    return run.groupBy(*keys).agg(*out)


def ranged(df: DataFrame, order: str, ranges: int = 255) -> DataFrame:
    """Add ``__range``, the number of approximate quantiles of a numeric column that lie below its value (null: 0)."""
    cuts = df.agg(F.percentile_approx(order, [i / (ranges + 1) for i in range(1, ranges + 1)], 1000).alias("__cuts"))
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))
    return df.crossJoin(F.broadcast(cuts)).withColumn("__range", at).drop("__cuts")  # one row


def running(df: DataFrame, keys, order: str, columns, descending: bool = False) -> DataFrame:
    """Add inclusive running sums ``run_<column>`` in the order of a numeric column, per ``keys``.

    Rows must be distinct in ``keys`` and ``order``; a null ``order`` ranks lowest. The values are cut into ranges
    at approximate quantiles: a task sorts one range, and the sums of the ranges before it (at most 256 rows a
    key) are joined on. The result does not depend on where the cuts fall; a frame that went through ``ranged`` keeps its own.
    """
    keys = list(keys)
    cut = df if "__range" in df.columns else ranged(df, order)
    direction = F.desc if descending else F.asc
    whole = Window.partitionBy(*keys).orderBy(direction("__range")).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = before.select(*keys, "__range", *[F.coalesce(F.sum(f"__{c}").over(whole), F.lit(0)).alias(f"__{c}") for c in columns])
    inside = Window.partitionBy(*keys, "__range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, [*keys, "__range"])
    return out.select(*[c for c in df.columns if c != "__range"], *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(f"run_{c}") for c in columns])


def precision_of_counts(counts: DataFrame, keys=()) -> DataFrame:
    """Average precision ``ap`` from one row a distinct score: ``keys, score, p`` (positives) and ``n`` (all)."""
    s = running(counts, keys, "score", ["p", "n"], descending=True)
    return s.groupBy(*keys).agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("run_p") / F.col("run_n")) / F.sum("p")).alias("ap"))


def average_precision(df: DataFrame, keys=()) -> DataFrame:
    """Step-wise average precision with tied scores as one step, per ``keys``: ``ap``.

    One row a distinct score enters the running sums.
    """
    return precision_of_counts(df.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count("*").alias("n")), keys)


def roc_auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney area with average ranks: ``auc`` and the U statistic ``u``."""
    g = df.groupBy("score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    r = running(g, [], "score", ["n"]).withColumn("rank", F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2)
    t = r.agg(F.sum(F.col("rank") * F.col("p")).alias("rs"), F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"))
    u = F.col("rs") - F.col("np") * (F.col("np") + 1) / 2
    return t.select(F.when((F.col("np") > 0) & (F.col("nn") > 0), u / (F.col("np") * F.col("nn"))).alias("auc"), u.alias("u"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Rows times replicates that are drawn at once.
CELLS = 1 << 20


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _stirred(x: np.ndarray) -> np.ndarray:
    for shift, by in ((33, _P2), (29, _P3), (32, None)):
        x ^= x >> np.uint64(shift)
        if by is not None:
            x *= by
    return x


def _hash_int(value, state: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 32-bit integers after ``state``."""
    low = np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return _stirred(_turned((state + _P5 + np.uint64(4)) ^ (low * _P1), 23) * _P2 + _P3)


def _hash_long(value: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers after ``state``, value by state."""
    turned = _turned(value.astype(np.uint64) * _P2, 31) * _P1
    return _stirred(_turned((state + _P5 + np.uint64(8))[None, :] ^ turned[:, None], 27) * _P1 + _P4)


def _drawn(ids: np.ndarray, state: np.ndarray, steps: list[int]) -> np.ndarray:
    """How often each id counts in each replicate: the steps of the Poisson distribution that the low 40 bits reach."""
    u = _hash_long(ids, state) & np.uint64((1 << 40) - 1)
    k = np.zeros(u.shape, np.int64)
    for step in steps:
        over = u >= np.uint64(step)
        if not over.any():
            break
        k += over
    return k


def bootstrap(df: DataFrame, scores, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Average precision of each score column in each replicate: ``replicate, model, ap``.

    Poisson bootstrap: a row (``app_id, y``, scores) counts k times in a replicate, k drawn from Poisson(1)
    by a hash of seed, replicate and id, so reruns agree and all scores see the same draws.

    Rows are dealt over ranges of scores and written once; they are not multiplied by the replicates. A task streams
    through a range from the highest score and keeps running sums for all replicates; the sums of the ranges before
    it (a number a range and replicate) come from a first pass. Ids are hashed as 64-bit integers, others by their hash.
    """
    spark = df.sparkSession
    tail, at, term = [], 0.0, math.exp(-1)
    for k in range(12):
        at += term
        tail, term = [*tail, math.ceil(at * (1 << 40))], term / (k + 1)
    with np.errstate(over="ignore"):
        state = _hash_int(np.arange(replicates), _hash_int([seed], np.array([42], np.uint64)))
    key = F.col("app_id").cast("long") if dict(df.dtypes)["app_id"] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("app_id")
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(c).cast("double").alias("score")) for i, c in enumerate(scores)]))
    flat = df.select(F.coalesce(key, F.lit(-1)).alias("id"), F.coalesce(F.col("y"), F.lit(0)).cast("long").alias("y"), pair.alias("m")).select("id", "y", "m.*")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = written(flat.repartitionByRange(parts, F.asc("model"), F.desc("score")).withColumn("range", F.spark_partition_id()), "bootstrap")

    def sliced(batch):
        """Slices of a batch: where range and model stay the same, at most ``CELLS`` draws."""
        where, model, ids, y = (batch.column(c).to_numpy() for c in ("range", "model", "id", "y"))
        score, none = batch.column("score").to_numpy(zero_copy_only=False), batch.column("score").is_null().to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((np.diff(where) != 0) | (np.diff(model) != 0)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(ids)], strict=True):
            for a in range(lo, hi, max(1, CELLS // replicates)):
                b = min(hi, a + max(1, CELLS // replicates))
                yield (int(where[a]), int(model[a])), y[a:b, None], _drawn(ids[a:b], state, tail), score[a:b], none[a:b]

    def totals(batches):
        sums = {}
        for batch in batches:
            for at, y, k, _, _ in sliced(batch):
                p, n = sums.setdefault(at, (np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)))
                p += (y * k).sum(0)
                n += k.sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"range": pa.array([a for a, _ in sums], pa.int32()), "model": pa.array([m for _, m in sums], pa.int32()), "p": pa.array([p.tolist() for p, _ in sums.values()], pa.list_(pa.int64())), "n": pa.array([n.tolist() for _, n in sums.values()], pa.list_(pa.int64()))})

    total = {}
    for r in cut.mapInArrow(totals, "range int, model int, p array<long>, n array<long>").collect():  # a few rows a range
        total[r["range"], r["model"]] = total.get((r["range"], r["model"]), 0) + np.array([r["p"], r["n"]], np.int64)
    before, run = {}, {}
    for a, m in sorted(total):
        before[a, m] = run.get(m, np.zeros((2, replicates), np.int64))
        run[m] = before[a, m] + total[a, m]
    ahead = spark.sparkContext.broadcast(before)

    def precisions(batches):
        now = tie = None
        closed, area, first, open_ = None, None, None, None

        def close():
            nonlocal area, closed
            closed = closed + open_
            area += np.divide(open_[0] * closed[0], closed[1], out=np.zeros(replicates), where=closed[1] > 0)

        def row():
            close()
            p, n = closed - first
            return pa.RecordBatch.from_pydict({"replicate": pa.array(np.arange(replicates), pa.int32()), "model": pa.array(np.full(replicates, now[1]), pa.int32()), "area": pa.array(area), "p": pa.array(p), "n": pa.array(n)})

        for batch in batches:
            for at, y, k, score, none in sliced(batch):
                new = np.flatnonzero((score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1])) | (none[1:] != none[:-1])) + 1
                starts = np.concatenate([[0], new])
                group = np.stack([np.add.reduceat(y * k, starts, axis=0), np.add.reduceat(k, starts, axis=0)])
                head = (bool(none[0]), bool(np.isnan(score[0])), float(score[0]))
                if at != now:
                    if now is not None:
                        yield row()
                    now, first = at, ahead.value[at]
                    closed, area, open_ = first, np.zeros(replicates), group[:, 0]
                elif head[:2] == tie[:2] and (head[1] or head[2] == tie[2]):
                    open_ = open_ + group[:, 0]
                else:
                    close()
                    open_ = group[:, 0]
                if len(starts) > 1:
                    close()
                    sums = closed[:, None] + np.cumsum(group[:, 1:-1], axis=1)
                    area += np.divide(group[0, 1:-1] * sums[0], sums[1], out=np.zeros(sums[0].shape), where=sums[1] > 0).sum(0)
                    closed, open_ = closed + group[:, 1:-1].sum(1), group[:, -1]
                tie = (bool(none[-1]), bool(np.isnan(score[-1])), float(score[-1]))
        if now is not None:
            yield row()

    dealt = cut.repartition(parts, "range").sortWithinPartitions("range", "model", F.desc("score"))
    each = dealt.mapInArrow(precisions, "replicate int, model int, area double, p long, n long")
    name = F.element_at(F.array(*[F.lit(c) for c in scores]), F.col("model") + 1).alias("model")
    ap = F.when(F.sum("p") > 0, F.sum("area") / F.sum("p")).alias("ap")
    return each.groupBy("replicate", "model").agg(ap, F.sum("n").alias("n")).where("n > 0").select("replicate", name, "ap")


def bootstrap_interval(samples: DataFrame) -> DataFrame:
    """Mean and 95 % interval of each model over ``bootstrap`` rows; replicates without positives do not count."""
    return samples.where("ap is not null").groupBy("model").agg(F.count("*").alias("replicates"), F.avg("ap").alias("mean"), F.percentile("ap", 0.025).alias("low"), F.percentile("ap", 0.975).alias("high"))


def better_share(samples: DataFrame, old: str, new: str) -> DataFrame:
    """Mean gain of ``new`` over ``old``, its 95 % interval, and the share of replicates with a gain."""
    wide = samples.where("ap is not null").groupBy("replicate").pivot("model", [old, new]).agg(F.first("ap"))
    gain = F.col(new) - F.col(old)
    return wide.agg(F.avg(gain).alias("mean"), F.percentile(gain, 0.025).alias("low"), F.percentile(gain, 0.975).alias("high"), F.avg((gain > 0).cast("double")).alias("share_better"))


def paired_t(df: DataFrame, old: str, new: str) -> DataFrame:
    """Paired t over folds of two columns' average precision: ``folds, mean, t`` (null for a constant difference)."""
    ap = lambda c: average_precision(df.select("fold", "y", F.col(c).alias("score")), ["fold"]).withColumnRenamed("ap", c)
    d = ap(old).join(ap(new), "fold").select((F.col(new) - F.col(old)).alias("d")).where("d is not null")
    return d.agg(F.count("*").alias("folds"), F.avg("d").alias("mean"), F.when(F.stddev_samp("d") > 0, F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"))


def cohen_d(df: DataFrame, columns) -> DataFrame:
    """Difference of the means at y = 1 and y = 0 over the whole deviation, for each column: ``feature, d``."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    flat = df.select("y", one.alias("m")).select("y", "m.*")
    return flat.groupBy("feature").agg(((F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))) / (F.stddev_pop("v") + 1e-12)).alias("d"))


def recall_at(df: DataFrame, shares=(0.01, 0.05, 0.1)) -> DataFrame:
    """Recall among the top k = max(round-half-even(share * n), 1) by score, ties by ``app_id``."""
    tot = df.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    ranked = numbered(df.select("app_id", "y", "score"), [F.desc("score"), F.asc("app_id")], name="r")
    ks = tot.select("n", "p", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).withColumn("k", F.greatest(F.bround(F.col("share") * F.col("n")).cast("long"), F.lit(1)))
    return ranked.where("y = 1").join(F.broadcast(ks), F.expr("r <= k"), "right").groupBy("share", "k", "p").agg(F.count("r").alias("hits")).select("share", "k", (F.col("hits") / F.col("p")).alias("recall"))


def control_verdict(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Whether ``score`` is at chance on control labels ``y``: ``ap, base_rate, at_chance`` (ap below ``factor`` times the base rate)."""
    base = df.agg(F.avg("y").alias("base_rate"))
    return average_precision(df).crossJoin(base).select("ap", "base_rate", (F.col("ap") < factor * F.col("base_rate")).alias("at_chance"))


def leak_gap(df: DataFrame, random: str, disjoint: str, material: float = 0.01) -> DataFrame:
    """Average precision of scores from a random and from a group-disjoint split: ``random_ap, disjoint_ap, gap, inflated``."""
    ap = lambda c, n: average_precision(df.select("y", F.col(c).alias("score"))).select(F.col("ap").alias(n))
    both = ap(random, "random_ap").crossJoin(ap(disjoint, "disjoint_ap")).withColumn("gap", F.col("random_ap") - F.col("disjoint_ap"))
    return both.withColumn("inflated", F.col("gap") > material)


def group_folds(groups: DataFrame, folds: int) -> DataFrame:
    """Assign groups to folds, the largest to the lightest: ``group, fold``.

    ``groups`` has one row an application with a ``group``. Group sizes come to the driver
    as a histogram (size, number of groups), which is small whatever the number of groups;
    groups of one size are dealt in id order.
    """
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    hist = sorted(((r["size"], r["c"]) for r in size.groupBy("size").agg(F.count("*").alias("c")).collect()), reverse=True)
    load, plan = [0] * folds, []
    for s, c in hist:
        take = [0] * folds
        whole = max(0, c // folds - (max(load) - min(load)) // s - 1)
        for k in range(folds):
            take[k] += whole
            load[k] += whole * s
        for _ in range(c - whole * folds):
            k = load.index(min(load))
            take[k] += 1
            load[k] += s
        at = 0
        for k in range(folds):
            plan.append((s, at, at + take[k], k))
            at += take[k]
    spark = groups.sparkSession
    table = spark.createDataFrame(plan or [(0, 0, 0, 0)], "s long, lo long, hi long, fold int")
    ranked = numbered(size, [F.asc("group")], ["size"], "r").withColumn("r", F.col("r") - 1)
    return ranked.join(F.broadcast(table), F.expr("size = s and r >= lo and r < hi")).select("group", "fold")
