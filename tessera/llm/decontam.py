"""Benchmark decontamination (DataFrame operations only).

A window of a document has as many words as a benchmark item. Of all windows of a
document those count that end with a shingle of the item (a word further to the
left never holds more of them, so the first best window is among these or is the
document's first) and that hold enough of its shingles to reach the threshold at
all. Every such window and every item gets a SimHash over its shingles. Both
are indexed under the item and radius + 1 blocks of the fingerprint, which finds
all pairs within the radius; survivors are verified by their exact weighted
similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import written

SPLIT = r"[^\p{L}\p{N}\p{M}]+"
BROADCAST_ROWS = 1_000_000
TASK_WINDOWS = 500
STRETCH = 4096


def words(text):
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), "")


def shingles(w, width: int):
    """Hashes of all runs of ``width`` words; of fewer words, of the whole sequence; of none, an empty array."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def simhash(hs: str) -> str:
    """SQL for the 64-bit SimHash of an array of hashes: a bit is set if over half the hashes have it."""
    return f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({hs}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int)) > size({hs}), shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"


def tagged(hs: str) -> str:
    """SQL that makes an array's repeats distinct, so that set operations count them."""
    return f"transform(array(sort_array({hs})), s -> transform(s, (h, i) -> xxhash64(h, i - cast(array_position(s, h) as int))))[0]"


def _blocks(fp: str, radius: int):
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.expr(f"shiftrightunsigned({fp}, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L") for i in range(radius + 1)])


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int, threshold: float, radius: int) -> DataFrame:
    """``doc_id, th, item_id, similarity, start_word``: the best window of each document (id and name of its text) for each item."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_id].alias("item_id"), words(benchmark[item_text]).alias("w")).where(F.size("w") > 0).withColumn("len", F.size("w"))
    # Items with the same words are one target.
    items = written(items.select("item_id", F.xxhash64("w").alias("target"), "len", shingles(F.col("w"), width).alias("hs")), "decontam-items")
    targets = items.dropDuplicates(["target"]).select("target", "len", "hs")
    keys = written(targets.select("target", "len", F.least("len", F.lit(width)).alias("width"), F.explode("hs").alias("h")), "decontam-keys")
    widths = sorted(r[0] for r in keys.select("width").distinct().collect())  # at most ``width`` values
    if not widths:
        return spark.createDataFrame([], f"doc_id long, th long, item_id {dict(benchmark.dtypes)[item_id]}, similarity double, start_word int")
    few = keys.count() <= BROADCAST_ROWS
    whole = docs[text].cast("string")
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(whole).alias("th"), words(whole).alias("w")).where(F.size("w") > 0)
    # A document's grams of each width; a shorter document gives one gram of all it has.
    each = base.select("doc_id", "th", F.size("w").alias("n"), F.explode(F.array(*[F.struct(F.lit(n).alias("width"), shingles(F.col("w"), n).alias("hs")) for n in widths])).alias("g"))
    grams = each.select("doc_id", "th", "n", F.col("g.width").alias("width"), F.posexplode("g.hs").alias("pos", "h"))
    # Places with a shingle of a target; a window holds at most as many of the target's shingles as it has such places.
    shingled = keys.select("target", "len", "width", "h").distinct()
    hits = grams.join(F.broadcast(shingled) if few else shingled, ["width", "h"]).select("doc_id", "th", "target", "len", "width", "n", "pos").distinct()
    at = Window.partitionBy("doc_id", "th", "target").orderBy("pos")
    hits = written(hits.withColumn("rank", F.row_number().over(at)), "decontam-hits")
    own, whose = F.least("len", "n") - F.col("width") + 1, F.col("len") - F.col("width") + 1
    need = F.greatest(F.lit(1), F.ceil(threshold * (own + whose) / (1 + threshold) - 1e-9)).cast("int")
    start = F.greatest(F.lit(0), F.col("pos") - (F.col("len") - F.col("width")))
    ends = hits.select("doc_id", "th", "target", "len", start.alias("start"), (F.col("rank") - need + 1).alias("least")).where("least > 0")
    firsts = hits.select(F.col("doc_id").alias("d1"), F.col("th").alias("t1"), F.col("target").alias("g1"), "rank", "pos")
    hits = ends.join(firsts, F.expr("doc_id <=> d1 and th = t1 and target = g1 and least = rank and pos >= start")).select("doc_id", "th", "target", "len", "start")
    # The spots of a stretch of words are one row, so that no row grows with a document.
    spots = hits.groupBy("doc_id", "th", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_set(F.struct("start", "len", "target")).alias("spots"))
    spots = written(spots.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "spots"), "decontam-spots")
    raw = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(whole).alias("th"), whole.alias("text"))
    found = raw.join(spots, F.expr("doc_id <=> d2 and th = t2")).select("doc_id", "th", words(F.col("text")).alias("w"), F.explode("spots").alias("s"))
    wins = found.select("doc_id", "th", "s.start", "s.target", F.expr("slice(w, s.start + 1, s.len)").alias("ww"))
    wins = wins.withColumn("hs", shingles(F.col("ww"), width)).withColumn("fp", F.expr(simhash("hs"))).withColumn("tags", F.expr(tagged("hs"))).drop("ww", "hs").distinct()
    wins = written(wins, "decontam-windows")
    # Windows are few bytes but much work each, so tasks are cut by their number, not their size.
    wins = wins.repartition(max(1, -(-wins.count() // TASK_WINDOWS)))
    aims = written(targets.select("target", F.expr(tagged("hs")).alias("itags"), F.expr(simhash("hs")).alias("ifp")), "decontam-targets")
    left = wins.select("doc_id", "th", "start", "target", "tags", "fp", F.posexplode(_blocks("fp", radius)).alias("blk", "val"))
    right = aims.select(F.col("target").alias("aim"), "itags", "ifp", F.posexplode(_blocks("ifp", radius)).alias("iblk", "ival"))
    # Of the blocks in which a pair agrees only the first counts, so each pair comes once.
    first = F.expr(" and ".join(["true"] + [f"(blk <= {i} or ((shiftrightunsigned(fp ^ ifp, {64 * i // (radius + 1)})) & {(1 << (64 * (i + 1) // (radius + 1) - 64 * i // (radius + 1))) - 1}L) <> 0)" for i in range(radius + 1)]))
    cand = left.join(right, F.expr("target = aim and blk = iblk and val = ival")).where(first).where(F.expr(f"bit_count(fp ^ ifp) <= {radius}"))
    # The guard keeps the exact test behind the distance wherever the optimizer moves it.
    inter = F.expr(f"if(bit_count(fp ^ ifp) <= {radius}, size(array_intersect(tags, itags)), 0)")
    sim = cand.select("doc_id", "th", "target", "start", inter.alias("both"), F.size("tags").alias("a"), F.size("itags").alias("b")).withColumn("similarity", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
    best = sim.where(F.col("similarity") >= threshold).groupBy("doc_id", "th", "target").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("m"))
    named = items.select("item_id", F.col("target").alias("aim")).distinct()
    return best.join(named, F.col("target") == F.col("aim")).select("doc_id", "th", "item_id", (-F.col("m.s")).alias("similarity"), F.col("m.start").alias("start_word"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """Return ``doc_id, item_id, similarity, start_word``: documents that hold an item, once per pair.

    Words are lower-cased runs of letters, marks and digits. Similarity: shared
    shingles (with repeats) over all shingles of the window and the item, shingles
    of ``width`` words; an item of fewer words is compared as a whole. The best
    window of a document counts, the first of equals. Null and empty texts match
    nothing; rows repeated with an id count as one document, rows with a null id
    are reported as one with a null id; items with the same words are each
    reported, an item repeated with its id once. Texts may be of any length,
    other columns of any name. Empty tables give no rows.

    At the threshold the expected distance of two fingerprints is about 10 bits
    with a deviation of 3, so ``radius`` 20 leaves out some 2 pairs in 10,000
    there. The items' shingles are broadcast only if counted to be at most
    ``BROADCAST_ROWS``; beyond that the join shuffles.
    """
    found = _found(docs, benchmark, doc_id, text, item_id, item_text, width, threshold, radius)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start_word")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("similarity"), F.col("m.start_word").alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """Drop the documents that hold a benchmark item; all columns are kept, whatever their names.

    Rows are judged by id and text together, so a clean row that shares only its
    id (or has none, like another) stays, and repeated rows stay or go together.
    Null and empty texts stay; an empty table gives an empty one, an empty
    benchmark drops nothing.
    """
    bad = _found(docs, benchmark, doc_id, text, item_id, item_text, width, threshold, radius).select("doc_id", "th").distinct()
    bad = written(bad, "contaminated")
    return docs.join(bad, docs[doc_id].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs[text].cast("string")) == bad["th"]), "left_anti")


def op5_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every contaminated document with the item that it holds."""
    return leaks(docs, benchmark)
