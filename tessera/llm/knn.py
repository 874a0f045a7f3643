"""Exact top-k inner products by a Voronoi join.

Pivots cut the data into cells. Each vector keeps two numbers about its cell:
its component along the pivot's direction and the length of the rest. For a
query the same two numbers bound the inner product with any vector of the cell
(Cauchy-Schwarz on the rest). Cells are cut into rings by the first number, and
a summary of each ring (ranges of both numbers, rows) bounds a query's product
with all its rows. Queries are grouped by neighbouring cells and first solve
inside the cells of their group; the k-th score found there is the query's own
bar. A ring is sent to a group only if one of its queries may find its bar
reached there. Groups are solved locally in blocks of bounded size.

Equal vectors are one query, and of equal candidates only the smallest ids can
be wanted, so copies cost next to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workdir import written

RESULT = "query_id long, rank int, vec_id long, score long"
PLACED = "vec_id long, cell int, along double, rest double, v binary"


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """Return ``vec_id, v`` with v = floor(scale * x) as longs, without unusable vectors.

    Unusable: a null id, a null vector, a null or non-finite component. Rows that
    share an id count as one, the smallest vector.
    """
    x = df[embedding]
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.where(df[vec_id].isNotNull() & F.coalesce(usable, F.lit(False))).select(df[vec_id].cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of longs as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def best(qid, qv, xid, xv, k: int):
    """Brute force over one block: the k best rows of each query, ties to smaller ids."""
    order = np.argsort(xid, kind="stable")
    xid, xv = xid[order], xv[order]
    exact = qv.shape[1] * max(1.0, np.abs(qv.astype(float)).max()) * max(1.0, np.abs(xv.astype(float)).max()) < 2**53
    s = (qv.astype(float) @ xv.T.astype(float)) if exact else qv @ xv.T
    low = np.partition(s, len(xid) - k, axis=1)[:, len(xid) - k] if len(xid) > k else None
    for i in range(len(qid)):
        near = np.flatnonzero(s[i] >= low[i]) if low is not None else np.arange(len(xid))
        pick = near[np.argsort(-s[i, near], kind="stable")[:k]]
        yield np.full(len(pick), qid[i]), xid[pick], s[i, pick].astype(np.int64)


def _solve(left: DataFrame, right: DataFrame, dim: int, k: int) -> DataFrame:
    """Solve each (grp, blk) of queries against its data: ``ask, vec_id, score``."""

    def unpack(pdf):
        return pdf["vec_id"].to_numpy(), np.frombuffer(b"".join(pdf["v"]), dtype="<i8").reshape(len(pdf), dim)

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        rows = list(best(*unpack(q), *unpack(x), k)) if len(q) and len(x) else []
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("ask", "vec_id", "score"), cols, strict=True)))

    keep = lambda d: d.select("grp", "blk", "vec_id", "v")
    return keep(left).groupBy("grp", "blk").cogroup(keep(right).groupBy("grp", "blk")).applyInPandas(run, "ask long, vec_id long, score long")


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("place", rank).where(F.col("place") <= k)


def _groups(piv: np.ndarray, asks_in: dict, rows_in: dict, group_queries: int, block_rows: int) -> list[tuple[int, int, int, int]]:
    """Deal cells to query groups: (cell, first group, groups, blocks of the group's own rows).

    Neighbouring cells share a group of at most ``group_queries`` queries, a crowded cell has several groups.
    """
    chain, left = [0], np.ones(len(piv), bool)
    left[0] = False
    while left.any():
        rest = np.flatnonzero(left)
        near = int(rest[((piv[rest] - piv[chain[-1]]) ** 2).sum(axis=1).argmin()])
        chain.append(near)
        left[near] = False
    out, group, used = [], -1, group_queries + 1
    for c in chain:
        n = asks_in.get(c, 0)
        if n > group_queries:
            out.append((c, group + 1, -(-n // group_queries)))
            group, used = group + out[-1][2], group_queries + 1
        elif n:
            if used + n > group_queries:
                group, used = group + 1, 0
            out.append((c, group, 1))
            used += n
    own: dict[int, int] = {}
    for c, g, _ in out:
        own[g] = own.get(g, 0) + rows_in.get(c, 0)
    return [(c, g, shares, max(1, -(-own[g] // block_rows))) for c, g, shares in out]


def top_k(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, pivots: int | None = None, max_pivots: int = 2048, rings: int = 8, group_queries: int = 512, block_rows: int = 8192, report: dict | None = None) -> DataFrame:
    """Return each query's ``k`` best other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` is a Column over ``vec_id``. Every usable row is a candidate
    (all, if fewer than ``k``); ties go to the smaller id. Rows that repeat an
    id count as one, null ids and unusable vectors take no part, other columns
    may have any names. Shorter vectors count as padded with zeros; scores
    beyond 64 bits are outside the contract. No usable rows give no result.

    The pivots are the rows with the smallest id hashes, as many as the root of
    the number of rows, at most ``max_pivots``; everything else covers all rows.
    To the driver come only tables over pivots and their rings. ``report``
    receives the numbers of distinct candidates, groups and rows sent.
    """
    spark = df.sparkSession
    vecs = written(quantised(df, vec_id, embedding, scale), "knn-vectors")
    n, dim = vecs.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(1, dim or 1)
    want = pivots or min(max_pivots, max(1, math.isqrt(n)))
    # Of equal vectors any query can want the k + 1 smallest ids at most; equal queries are one.
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    cand = vecs.withColumn("copy", first).where(F.col("copy") <= k + 1).drop("copy")
    asks = vecs.where(is_query).groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    picked = [r["v"] + [0] * (dim - len(r["v"])) for r in vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).collect()]
    if not picked:
        return spark.createDataFrame([], RESULT)
    piv = np.unique(np.array(picked, float), axis=0)
    norm = np.linalg.norm(piv, axis=1)
    shared = spark.sparkContext.broadcast((piv, piv / np.where(norm > 0, norm, 1)[:, None]))

    def assign(batches):
        piv, unit = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                v = _matrix(batch.column(1), dim)
                x = v.astype(float)
                cell = np.argmax(2 * x @ piv.T - (piv**2).sum(axis=1), axis=1)
                along = (x * unit[cell]).sum(axis=1)
                rest = np.linalg.norm(x - along[:, None] * unit[cell], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(along), pa.array(rest), pa.array([r.tobytes() for r in v.astype("<i8")], pa.binary())], names=["vec_id", "cell", "along", "rest", "v"])

    placed = written(cand.select("vec_id", "v").mapInArrow(assign, PLACED), "knn-cells")
    asked = written(asks.select("vec_id", "v").mapInArrow(assign, PLACED), "knn-queries")
    spans = F.broadcast(placed.groupBy("cell").agg(F.min("along").alias("lo"), F.max("along").alias("hi")))  # a row a pivot
    ring = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(rings - 1), F.floor((F.col("along") - F.col("lo")) / (F.col("hi") - F.col("lo")) * rings))).otherwise(0).cast("int")
    ringed = placed.join(spans, "cell").select("vec_id", "cell", ring.alias("ring"), "along", "rest", "v")
    summary = ringed.groupBy("cell", "ring").agg(F.min("along"), F.max("along"), F.max("rest"), F.count("*")).orderBy("cell", "ring").collect()
    rows_in, asks_in = {}, {r[0]: r[1] for r in asked.groupBy("cell").agg(F.count("*")).collect()}
    for r in summary:
        rows_in[r[0]] = rows_in.get(r[0], 0) + r[5]
    dealt = _groups(piv, asks_in, rows_in, group_queries, block_rows)
    if not dealt:
        return spark.createDataFrame([], RESULT)
    deal = F.broadcast(spark.createDataFrame(dealt, "cell int, first int, shares int, blocks int"))  # a row a pivot at most
    hashed = lambda col: F.pmod(F.xxhash64("vec_id"), col).cast("int")
    queries = asked.join(deal, "cell").withColumn("grp", F.col("first") + hashed(F.col("shares")))

    # First inside the group's own cells.
    own = ringed.join(deal, "cell").withColumn("grp", F.explode(F.expr("sequence(first, first + shares - 1)"))).withColumn("blk", hashed(F.col("blocks")))
    inside = _top(_solve(queries.withColumn("blk", F.explode(F.expr("sequence(0, blocks - 1)"))), own, dim, k + 1), k + 1)
    inside = written(inside, "knn-inside")
    bars = inside.where(F.col("place") == k + 1).select("ask", F.col("score").cast("double").alias("bar"))

    # Then the rings of other cells in which some query of the group may reach its bar.
    s_cell, s_ring = np.array([r[0] for r in summary]), np.array([r[1] for r in summary])
    s_lo, s_hi, s_rest = (np.array([r[i] for r in summary], float) for i in (2, 3, 4))
    home = np.full(len(piv), -1)
    for c, g, _, _ in dealt:
        home[c] = g  # the groups of a crowded cell have that cell alone
    rings_of = spark.sparkContext.broadcast((s_cell, s_ring, s_lo, s_hi, s_rest, home))

    def reached(batches):
        unit = shared.value[1]
        s_cell, s_ring, s_lo, s_hi, s_rest, home = rings_of.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                grp, cell, bar = (batch.column(i).to_numpy() for i in range(3))
                q = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<i8").reshape(len(grp), dim).astype(float)
                along = q @ unit.T
                rest = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - along**2, 0))
                along, rest = along[:, s_cell], rest[:, s_cell]
                most = np.maximum(along * s_lo, along * s_hi) + rest * s_rest
                slack = 1 + 1e-9 * (np.abs(along) * np.maximum(np.abs(s_lo), np.abs(s_hi)) + rest * s_rest)
                hit = (most + slack >= bar[:, None]) & (home[s_cell] != home[cell][:, None])
                for g in np.unique(grp):
                    m = np.flatnonzero(hit[grp == g].any(axis=0))
                    if len(m):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), g), pa.int32()), pa.array(s_cell[m], pa.int32()), pa.array(s_ring[m], pa.int32())], names=["grp", "cell", "ring"])

    barred = queries.join(bars, queries["vec_id"] == bars["ask"], "left").select("grp", "cell", F.coalesce("bar", F.lit(-math.inf)).alias("bar"), "v")
    reach = written(barred.mapInArrow(reached, "grp int, cell int, ring int").distinct(), "knn-reach")
    counted = F.broadcast(spark.createDataFrame([(int(r[0]), int(r[1]), int(r[5])) for r in summary], "cell int, ring int, n long"))  # a row a ring
    slots = written(reach.join(counted, ["cell", "ring"]).groupBy("grp").agg(F.sum("n").alias("n")).select("grp", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("slots")), "knn-slots")
    if report is not None:
        report.update(candidates=sum(rows_in.values()), groups=max(g + shares for _, g, shares, _ in dealt), sent=slots.agg(F.sum("n")).first()[0] or 0)
    sent = ringed.join(reach, ["cell", "ring"]).join(slots, "grp").withColumn("blk", hashed(F.col("slots")))
    outside = _solve(queries.join(slots, "grp").withColumn("blk", F.explode(F.expr("sequence(0, slots - 1)"))), sent, dim, k + 1)
    hits = _top(inside.drop("place").unionByName(outside), k + 1)
    lists = hits.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))  # k + 1 entries at most
    answers = asks.join(lists, asks["vec_id"] == lists["ask"]).select(F.col("v").alias("w"), "found")
    mine = vecs.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    each = mine.join(answers, mine["v"] == answers["w"]).select("query_id", F.posexplode(F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {int(k)})")).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op3_topk(embeddings: DataFrame) -> DataFrame:
    """The contract: every id divisible by 20 asks for its 20 best rows."""
    return top_k(embeddings, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
