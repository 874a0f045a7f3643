"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

The rate of a document lies between 0 and ``most`` and minimises the relative
entropy (to the rate that a document has without constraints, half of ``most``)
under one token constraint for each source. Its dual is convex with one
multiplier a source; the solution tilts the odds of a document exponentially in
its tokens: rate = most * sigmoid(multiplier * size / mean size of the source).
Newton iterations find all multipliers together, each one a join and a sum over
the (source, size) histogram. Rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import new_path, removed, written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Return ``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, take the weights in turn and divide
    ``share`` of all tokens; a target stops at ``most`` times the source's size
    and the excess goes to the others by weight. In closed form: sources ordered
    by limit / weight fill up one after the other. The table has one row a
    source; only it passes through a global window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("ratio", "pos").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = totals.withColumn("pos", F.row_number().over(order)).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("pos") - 1, F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("w"))
    w = w.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("full", F.sum("limit").over(up) + F.col("ratio") * F.coalesce(F.sum("w").over(down), F.lit(0.0)) <= F.col("all"))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    rest_t = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0))
    return w.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), rest_t * F.col("w") / rest_w))).select("source", "source_size", "target")


def _rate(lam, size, mean, most):
    return F.lit(float(most)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * size / mean))))


def multipliers(hist: DataFrame, targets: DataFrame, most: float, max_iter: int = 60, tol: float = 1e-9) -> DataFrame:
    """Solve the dual: ``source, lam, mean, target, fixed`` (fixed: the rate of a source at a bound, else null).

    Safeguarded Newton: a step that leaves the bracket is replaced by bisection
    (or by doubling while an end is open). The state has a row a source and is
    written each iteration; the driver sees only the count of open sources.
    """
    spark = hist.sparkSession
    count = hist.groupBy("source").agg(F.sum("n").alias("docs"))
    state = targets.join(count, targets["source"].eqNullSafe(count["source"])).select(targets["source"], "target", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"))
    share = F.col("target") / (F.col("source_size") * F.lit(float(most)))
    fixed = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), 0.0).when(share >= 1 - 1e-12, float(most))
    state = state.withColumn("fixed", fixed).withColumn("lam", F.when(F.col("fixed").isNull(), F.log(share / (1 - share))).otherwise(0.0))
    state = state.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("open", F.col("fixed").isNull())
    path = new_path(spark, "mix")
    state = written(state, "mix", path)
    for _ in range(max_iter):
        if not state.where("open").limit(1).count():
            break
        s = state.where("open").select(F.col("source").alias("src"), "lam", "mean")
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        step = hist.join(s, hist["source"].eqNullSafe(s["src"])).groupBy("src").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / F.lit(float(most)))).alias("slope"))
        g = F.col("got") - F.col("target")
        lo, hi = F.when(g < 0, F.col("lam")).otherwise(F.col("lo")), F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - g / F.col("slope"))
        inside = newton.isNotNull() & (F.col("nlo").isNull() | (newton > F.col("nlo"))) & (F.col("nhi").isNull() | (newton < F.col("nhi"))) & (F.abs(newton - F.col("lam")) <= 1 + 2 * F.abs("lam"))
        wide = F.when(F.col("nlo").isNotNull() & F.col("nhi").isNotNull(), (F.col("nlo") + F.col("nhi")) / 2).when(g < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam"))
        moved = state.join(step, state["source"].eqNullSafe(step["src"]), "left").withColumn("nlo", lo).withColumn("nhi", hi)
        near = F.abs(g) <= F.greatest(F.lit(0.01), F.lit(tol) * F.col("target"))
        stay = ~F.col("open") | F.coalesce(near, F.lit(True))
        nxt = moved.select("source", "target", "source_size", "mean", "fixed", F.when(stay, F.col("lam")).when(inside, newton).otherwise(wide).alias("lam"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), (~stay).alias("open"))
        nxt_path = new_path(spark, "mix")
        nxt = written(nxt, "mix", nxt_path)
        removed(spark, path)
        state, path = nxt, nxt_path
    return state.select("source", "lam", "mean", "target", "source_size", "fixed")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, bucket_rows: int = 2000) -> DataFrame:
    """Return ``doc_id, source, size, source_size, target, rate, copies, taken`` for every row.

    ``size`` counts the words of the whole text (null: 0); ``taken`` = copies *
    size. A null source is a source of its own. A source without words has
    target 0 and takes nothing. Rows repeated with an id are separate documents;
    equal rows may differ in copies, the result as a whole is the same in
    each run. No documents, no rows.

    Rounding: each source walks its sizes downwards and takes as many copies of
    a size as bring the words taken nearest to the words wanted so far, so it
    ends within about half a small document of its target; the walk sees one
    entry for each distinct size, never the documents. Copies of a size go to
    its documents by hash: first to buckets of about ``bucket_rows`` rows in
    proportion, then by rank inside the bucket, so a size which a third of all
    rows share is ranked in many tasks.
    """
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), F.regexp_count(F.coalesce(docs[text].cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    base = written(base, "mix-sizes")
    buckets = max(1, -(-base.count() // bucket_rows))
    base = base.withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).cast("int"))
    cells = written(base.groupBy("source", "size", "b").agg(F.count("*").alias("n")), "mix-cells")
    hist = written(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-hist")
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = multipliers(hist, source_targets(totals, weights, share, most), most)
    solved = solved.withColumnRenamed("source", "src")
    rate = F.coalesce("fixed", _rate(F.col("lam"), F.col("size"), F.col("mean"), most))
    rated = hist.join(solved, hist["source"].eqNullSafe(solved["src"])).select("source", "size", "n", "source_size", "target", rate.alias("rate"))

    # Sizes go in runs of 256, so that the fold copies a run and not all that came before.
    k = f"greatest(0L, least({int(most)}L * x.n, cast(round(if(x.size = 0, x.n * x.rate, (a.want + x.n * x.size * x.rate - a.got) / x.size)) as bigint)))"
    entry = "array<struct<size: bigint, n: bigint, rate: double, k: bigint>>"
    run = f"""aggregate(c, named_struct('want', acc.want, 'got', acc.got, 'ks', cast(array() as {entry})), (a, x) -> named_struct(
        'want', a.want + x.n * x.size * x.rate, 'got', a.got + x.size * {k}, 'ks', concat(a.ks, array(named_struct('size', x.size, 'n', x.n, 'rate', x.rate, 'k', {k})))))"""
    runs = "transform(array(reverse(array_sort(collect_list(struct(size, n, rate))))), all -> transform(sequence(0, (size(all) - 1) div 256), i -> slice(all, i * 256 + 1, 256)))[0]"
    walk = f"""flatten(aggregate({runs}, named_struct('want', 0D, 'got', 0D, 'ks', cast(array() as array<{entry}>)),
        (acc, c) -> transform(array({run}), r -> named_struct('want', r.want, 'got', r.got, 'ks', concat(acc.ks, array(r.ks))))[0]).ks)"""
    ks = rated.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.expr(walk).alias("ks"))
    ks = ks.select("source", "source_size", "target", F.explode("ks").alias("x")).select("source", "source_size", "target", "x.*")

    up = Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    dealt = cells.withColumn("cum", F.sum("n").over(up)).withColumnRenamed("n", "cn")
    dealt = dealt.join(ks, key(dealt, ks)).select(dealt["source"], dealt["size"], "b", "cn", "cum", "n", "rate", "k", "source_size", "target")
    extra = F.expr("k % n")
    cut = lambda c: F.expr(f"cast((cast(k % n as decimal(20,0)) * ({c})) div n as bigint)")
    dealt = dealt.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("b").alias("b2"), F.expr("k div n").alias("each"), F.when(extra > 0, cut("cum") - cut("cum - cn")).otherwise(0).alias("more"), "rate", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "b").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id"))
    out = base.withColumn("rk", rank).join(dealt, F.expr("source <=> s2 and size = z2 and b = b2"))
    copies = (F.col("each") + F.when(F.col("rk") <= F.col("more"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
