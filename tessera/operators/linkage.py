"""Unsupervised record linkage: blocking, comparison levels, EM over patterns, accepted links."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import written

LEVELS = 4
#: Pairs of words that are compared beforehand and broadcast, at most.
WORD_PAIRS = 500_000


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, less half the displaced ones, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for ch, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """Jaro with the prefix boost (up to four characters), always applied."""
    j = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + same * p * (1 - j)


def jaro_column(a, b):
    """Column of Jaro similarities, in Arrow batches."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro(s or "", t or "") for s, t in zip(x, y, strict=True)], dtype=float)

    return similarity(a, b)


def jaro_winkler_column(a, b):
    """Column of Jaro-Winkler similarities, in Arrow batches; meant for distinct pairs."""

    @F.pandas_udf("double")
    def jw(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(s or "", t or "") for s, t in zip(x, y, strict=True)], dtype=float)

    return jw(a, b)


def skeleton(name):
    """Consonant skeleton: letters only, vowels become a, six characters."""
    return F.substring(F.translate(F.regexp_replace(F.lower(name), "[^a-z]", ""), "eiou", "aaaa"), 1, 6)


def person_keys(first, last, birth_year, pincode, mobile) -> list:
    """The four blocking keys of a person, each under its rule's name; null where a part is missing."""
    whole = lambda c: F.when(c != "", c)
    first, last, mobile = whole(first), whole(last), whole(mobile)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [
        F.concat(F.lit("mob|"), mobile),
        F.concat(F.lit("snd|"), skeleton(last), F.lit("|"), text(birth_year)),
        F.concat(F.lit("l3|"), F.substring(last, 1, 3), F.lit("|"), text(pincode)),
        F.concat(F.lit("fl|"), F.substring(first, 1, 1), F.lit("|"), F.substring(last, 1, 4), F.lit("|"), text(pincode)),
    ]


def units(rec: DataFrame, keys: list, fields=(), cap: int | None = None, share: int = 500) -> DataFrame:
    """Ids that nothing tells apart, in shares of about ``share``: ``u, ids, keys, rows``.

    ``keys`` are the blocking keys of any row of an id, ``rows`` the distinct values of ``fields`` on its rows, each with
    their number ``m`` (an id may be repeated); ``u`` is the smallest of ``ids``, so each share has its own. Ids without
    a key are left out, as is the null id. Only with ``cap`` do a key's rows with the smallest id hash alone stay.
    """
    from pyspark.sql import Window

    k = rec.select("id", F.explode(F.array(*keys)).alias("key")).where("key is not null and id is not null")
    if cap is not None:
        k = k.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.expr("(id * 2654435761) % 4294967296"), "id"))).where(F.col("r") <= cap)
    of = k.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    rows = rec.groupBy("id", *fields).agg(F.count("*").alias("m")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*fields, "m"))).alias("rows")) if fields else None
    of = of.join(rows, "id") if fields else of.withColumn("rows", F.expr("array(named_struct('m', 1L))"))
    of = written(of.withColumn("h", F.xxhash64("keys", "rows")), "link-ids")
    many = of.groupBy("h").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")).where("shares > 1")
    dealt = of.join(many, "h", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))))
    ids = dealt.groupBy("keys", "rows", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return written(ids.select(F.col("ids")[0].alias("u"), "ids", "keys", "rows"), "link-units")


def unit_pairs(unit: DataFrame, block: int = 2000) -> DataFrame:
    """Pairs of ``units`` that share a key, once each: ``u_a <= u_b, ids_a, ids_b, m`` and the fields with ``_a`` and ``_b``.

    A key above ``block`` ids is dealt over pairs of sub-blocks, so that no task has a whole large key and no pair is
    left out. A pair counts under the first key that it shares, so pairs are neither shuffled nor made distinct.
    A unit meets itself too, for the pairs inside it. Units whose ids have several rows come once a pair of rows, ``m`` times.
    """
    fields = [f.name for f in unit.schema["rows"].dataType.elementType if f.name != "m"]
    k = unit.select("u", "ids", "rows", "keys", F.posexplode("keys").alias("at", "key"))
    k = k.select("u", "ids", "key", F.slice("keys", F.lit(1), F.col("at")).alias("before"), F.explode("rows").alias("r")).select("u", "ids", "key", "before", "r.*")
    held = unit.select(F.explode("keys").alias("key"), F.size("ids").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))
    big = held.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("subs"))
    dealt = k.join(big, "key", "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("u"), F.col("subs")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ["u", "ids", "before", "m", *fields]]
    left = dealt.select("key", F.col("s").alias("i"), F.col("o").alias("j"), *named("a"))
    right = dealt.select("key", F.col("o").alias("i"), F.col("s").alias("j"), *named("b"))
    met = left.join(right, ["key", "i", "j"]).where("u_a <= u_b and (size(before_a) = 0 or size(before_b) = 0 or not arrays_overlap(before_a, before_b))")
    return met.select("u_a", "u_b", "ids_a", "ids_b", (F.col("m_a") * F.col("m_b")).alias("m"), *[f"{c}_{side}" for c in fields for side in "ab"])


def expanded(pairs: DataFrame, repeats: bool = True) -> DataFrame:
    """Pairs of ids ``a < b`` of ``unit_pairs``, with the fields of its struct ``of``, if any."""
    if repeats:
        pairs = pairs.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    of = ["of"] if "of" in pairs.columns else []
    each = pairs.select("u_a", "u_b", *of, "ids_b", F.explode("ids_a").alias("x")).select("u_a", "u_b", *of, "x", F.explode("ids_b").alias("y"))
    return each.where("u_a < u_b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *[f"{c}.*" for c in of])


def block_pairs(rec: DataFrame, keys: list, cap: int | None = None, block: int = 2000) -> DataFrame:
    """Candidate pairs ``a < b`` that share a blocking key, without a shuffle of pairs: see ``unit_pairs``.

    Only with ``cap`` (the reference's rule) are a key's rows limited.
    """
    return expanded(unit_pairs(units(rec, keys, cap=cap), block), repeats=False)


def similar(pairs: DataFrame, unit: DataFrame, c: str) -> DataFrame:
    """Add the Jaro-Winkler similarity ``<c>_jw`` to ``unit_pairs``, null for a null; it is the same in both directions.

    Words are compared once a pair of words that share a key, if these are few enough to broadcast; else within the batches.
    """
    k = unit.select(F.explode("keys").alias("key"), F.col(f"rows.{c}").alias("w")).select("key", F.explode("w").alias("w")).where("w is not null").distinct()
    bound = k.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
    if bound > WORD_PAIRS:
        return pairs.withColumn(f"{c}_jw", F.when(x.isNotNull() & y.isNotNull(), jaro_winkler_column(x, y)))
    words = k.select("key", F.col("w").alias("x")).join(k.select("key", F.col("w").alias("y")), "key").select("x", "y").distinct()
    words = written(words.withColumn(f"{c}_jw", jaro_winkler_column(F.col("x"), F.col("y"))), "link-words")
    return pairs.join(F.broadcast(words), (x == words["x"]) & (y == words["y"]), "left").drop("x", "y")  # at most WORD_PAIRS rows


def levels(unit: DataFrame, names: list[str], exact: list[str], block: int = 2000) -> DataFrame:
    """``unit_pairs`` with comparison levels as struct ``of``: names 0 exact, 1 >= .90, 2 >= .78, 3 else; others 0 equal, 1 else."""
    j = unit_pairs(unit, block)
    for c in names:
        j = similar(j, unit, c)
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    name = [F.when(same(c), 0).when(F.col(f"{c}_jw") >= 0.90, 1).when(F.col(f"{c}_jw") >= 0.78, 2).otherwise(3).alias(f"g_{c}") for c in names]
    other = [F.when(same(c), 0).otherwise(1).alias(f"g_{c}") for c in exact]
    return j.select("u_a", "u_b", "ids_a", "ids_b", "m", F.struct(*name, *other).alias("of"))


def pattern_counts(leveled: DataFrame) -> DataFrame:
    """Number ``n`` of pairs of ids at each pattern of ``levels``, from the units' sizes; no pair of ids is built."""
    a, b = F.size("ids_a").cast("long"), F.size("ids_b").cast("long")
    inside = (a * (a - 1) / 2).cast("long")
    n = F.col("m") * F.when(F.col("u_a") < F.col("u_b"), a * b).otherwise(inside)
    return leveled.select("of.*", n.alias("n")).where("n > 0").groupBy(*[f.name for f in leveled.schema["of"].dataType]).agg(F.sum("n").alias("n"))


def pava_decreasing(y) -> np.ndarray:
    """Least-squares non-increasing fit."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.array([v for v, n in blocks for _ in range(int(n))])


def fit_em(patterns: list[tuple[tuple[int, ...], int]], sizes: list[int], iterations: int = 25) -> dict:
    """EM over counted level patterns: ``m``, ``u`` (a list of levels a field) and ``pi``."""
    g = np.array([p for p, _ in patterns], int)
    c = np.array([n for _, n in patterns], float)
    total = c.sum()
    u, m = [], []
    for f, k in enumerate(sizes):
        freq = np.clip(np.bincount(g[:, f], weights=c, minlength=k) / total, 1e-6, None)
        up = pava_decreasing(freq[::-1])[::-1]
        u.append(up / up.sum())
        v = pava_decreasing(u[-1] * np.exp(-1.6 * np.arange(k)))
        m.append(v / v.sum())
    pi = 0.02
    for _ in range(iterations):
        llr = sum(np.log(np.clip(m[f][g[:, f]], 1e-9, None) / np.clip(u[f][g[:, f]], 1e-9, None)) for f in range(len(sizes)))
        z = np.clip(llr + math.log(pi / (1 - pi)), -60, 60)
        post = 1 / (1 + np.exp(-z))
        new = []
        for f, k in enumerate(sizes):
            v = pava_decreasing(np.clip(np.bincount(g[:, f], weights=c * post, minlength=k), 1e-9, None))
            new.append(v / v.sum())
        moved = max(float(np.abs(a - b).max()) for a, b in zip(m, new, strict=True))
        m, pi = new, float(np.clip((c * post).sum() / total, 1e-6, 1 - 1e-6))
        if moved < 1e-6:
            break
    return {"m": m, "u": u, "pi": pi}


def link_threshold(pi: float, p: float, rule: str = "posterior") -> float:
    """Log-likelihood cut for posterior ``p``; ``rule="reference"`` adds the prior odds as the original code does."""
    prior, cut = math.log(pi / (1 - pi)), math.log(p / (1 - p))
    return cut - prior if rule == "posterior" else cut + prior


def link(leveled: DataFrame, fields: list[str], sizes: list[int], min_posterior: float = 0.99, rule: str = "posterior") -> DataFrame:
    """Fit by EM on the pattern counts (a bounded table) and return the accepted pairs of ``levels`` with ``llr`` in ``of``.

    ``expanded`` gives their pairs of ids, ``link_edges`` as few edges as join the same ids.
    """
    cols = [f"g_{f}" for f in fields]
    patterns = [(tuple(r[c] for c in cols), r["n"]) for r in pattern_counts(leveled).collect()]
    if not patterns:
        return leveled.select("u_a", "u_b", "ids_a", "ids_b", "m", F.struct(F.lit(0.0).alias("llr")).alias("of"))
    fit = fit_em(patterns, sizes)
    weight = None
    for f, c in enumerate(cols):
        w = F.element_at(F.array(*[F.lit(float(np.log(max(fit["m"][f][i], 1e-9) / max(fit["u"][f][i], 1e-9)))) for i in range(sizes[f])]), F.col(f"of.{c}") + 1)
        weight = w if weight is None else weight + w
    held = leveled.where("u_a < u_b or size(ids_a) > 1").withColumn("of", F.struct(weight.alias("llr")))
    return held.where(F.col("of.llr") >= link_threshold(fit["pi"], min_posterior, rule))


def link_edges(links: DataFrame, unit: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the components of all pairs of ids in ``links``.

    Every id of a linked unit is linked to every id of another (or of its own) unit, so the ids of a linked unit hang together.
    """
    near = links.select("u_a", "u_b").distinct()
    near = written(near, "link-near")
    linked = near.select(F.col("u_a").alias("v")).union(near.select("u_b")).distinct()
    inner = unit.join(linked, F.col("u") == F.col("v")).select(F.col("u").alias("a"), F.explode("ids").alias("b"))
    return near.where("u_a < u_b").select(F.col("u_a").alias("a"), F.col("u_b").alias("b")).union(inner)


def resolved_ids(clusters: DataFrame) -> DataFrame:
    """Map ``id, cluster`` to ``id, resolved``: ``rp_<cluster>`` where several records share a cluster, else the id itself."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    many = F.concat(F.lit("rp_"), F.col("cluster").cast("string"))
    return clusters.join(size, "cluster").select("id", F.when(F.col("n") > 1, many).otherwise(F.col("id").cast("string")).alias("resolved"))


def rewritten(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace the person ids in ``column`` by their resolved ids (as text); unknown and null ids stay."""
    of = mapping.select(F.col("id").alias("__id"), F.col("resolved").alias("__resolved"))
    out = df.join(of, df[column] == F.col("__id"), "left")
    return out.select(*[F.coalesce(F.col("__resolved"), df[c].cast("string")).alias(c) if c == column else df[c] for c in df.columns])


def collapsed(persons: DataFrame, column: str, mapping: DataFrame, order: str) -> DataFrame:
    """Rewrite the ids of person records and keep the first record of each, by ``order`` (distinct values)."""
    new = rewritten(persons.withColumn("__order", F.col(order)), column, mapping)
    fields = F.struct(F.col("__order").alias("first"), *[F.col(c) for c in persons.columns])
    return new.groupBy(F.col(column).alias("__person")).agg(F.min_by(fields, "__order").alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in persons.columns])


def merge_diagnostics(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """One row on merges against ``truth(id, human)``: merged clusters, correct and false ones, records welded wrongly.

    A record without a known human counts as one more human.
    """
    per = mapping.join(truth, "id", "left").groupBy("resolved").agg(F.count("*").alias("n"), (F.countDistinct("human") + F.max(F.col("human").isNull().cast("int"))).alias("humans")).where("n > 1")
    wrong = F.col("humans") > 1
    return per.agg(F.count("*").alias("clusters_merged"), F.count(F.when(~wrong, 1)).alias("correct_merges"), F.count(F.when(wrong, 1)).alias("false_merges"), F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).cast("long").alias("records_welded_wrongly"))
