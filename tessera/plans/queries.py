"""Registered queries of the core library, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import evaluation
from tessera.operators import finance, graphfeatures, linkage, rings
from tessera.operators.components import connected_components
from tessera.sources.binding import SQL as BIND
from tessera.sources.binding import STRONG, applications, incidence, installments
from tessera.sources.workdir import written

QUERIES: dict = {}
SQL: dict = {}
NET_BOOK = 30355.0
STRONG_SQL = "('device', 'account', 'person')"


def r6(c):
    """Round to six digits, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` follows the binding's CTEs."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {'RECURSIVE ' if 'reach(' in sql else ''}{BIND} {sql}"
        return fn

    return add


def _y(a):
    return a.select("app_id", "score", F.when(F.col("ring") > 0, 1).otherwise(0).alias("y"))


Y = ", y AS (SELECT app_id, score, CASE WHEN ring > 0 THEN 1 ELSE 0 END AS y FROM apps)"


@query("scan_orders_app", "SELECT app_id, cust, day, round(amount, 6) + 0 AS amount, product, status, round(income, 6) + 0 AS income, round(score, 6) + 0 AS score, ring FROM apps")
def _(s, d):
    return applications(s, d).select("app_id", "cust", "day", r6("amount").alias("amount"), "product", "status", r6("income").alias("income"), r6("score").alias("score"), "ring")


@query("incidence_long", "SELECT relation, app_id, node FROM inc")
def _(s, d):
    return incidence(s, d)


@query("left_lookup_coalesce", "SELECT app_id, coalesce(c_mktsegment, 'none') AS segment FROM apps LEFT JOIN customer ON cust = c_custkey AND c_acctbal > 0")
def _(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    a = applications(s, d)
    return a.join(c, a["cust"] == c["c_custkey"], "left").select("app_id", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("semi_prefix_snapshot", "SELECT relation, count(*) AS n, count(DISTINCT node) AS nodes FROM inc WHERE app_id IN (SELECT app_id FROM apps WHERE day <= 1000) GROUP BY relation")
def _(s, d):
    a = applications(s, d).where("day <= 1000").select("app_id")
    return incidence(s, d).join(a, "app_id", "left_semi").groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"))


@query("anti_seed_drop", "SELECT app_id, day FROM apps WHERE app_id NOT IN (SELECT app_id FROM apps WHERE ring = 3)")
def _(s, d):
    a = applications(s, d)
    return a.join(a.where("ring = 3").select("app_id"), "app_id", "left_anti").select("app_id", "day")


@query("node_ratios", "SELECT app_id, round(income / (amount + 1), 6) + 0 AS income_to_amount, round(amount / greatest(n, 1), 6) + 0 AS amount_per_item, round((amount / greatest(n, 1)) / (abs(income) + 1), 6) + 0 AS burden, round(coalesce(down, 0) / (amount + 1), 6) + 0 AS down_to_amount, round(amount / greatest(n, 1), 6) + 0 AS scheduled_emi FROM apps JOIN (SELECT o_orderkey, count(l_orderkey) AS n, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS down FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_orderkey = app_id")
def _(s, d):
    n = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("app_id")).agg(F.count("*").alias("n"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).alias("down"))
    per = F.col("amount") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return applications(s, d).join(n, "app_id", "left").select("app_id", r6(F.col("income") / (F.col("amount") + 1)).alias("income_to_amount"), r6(per).alias("amount_per_item"), r6(per / (F.abs("income") + 1)).alias("burden"), r6(F.coalesce("down", F.lit(0.0)) / (F.col("amount") + 1)).alias("down_to_amount"), r6(per).alias("scheduled_emi"))


@query("freq_encode", "SELECT app_id, count(*) OVER (PARTITION BY product) AS product_freq FROM apps")
def _(s, d):
    a = applications(s, d)
    return a.join(a.groupBy("product").agg(F.count("*").alias("product_freq")), "product").select("app_id", "product_freq")


@query("category_code", "SELECT app_id, coalesce(c, -1) AS product_code FROM apps LEFT JOIN (SELECT product AS p, CAST(row_number() OVER (ORDER BY product) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT product FROM apps WHERE product IS NOT NULL)) ON product = p")
def _(s, d):
    a = applications(s, d)
    codes = a.select("product").where("product is not null").distinct().withColumn("c", F.row_number().over(Window.orderBy("product")) - 1)
    return a.join(codes, "product", "left").select("app_id", F.coalesce("c", F.lit(-1)).alias("product_code"))


EMI_SQL = ", e AS (SELECT l_orderkey AS app_id, l_linenumber AS no, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS missed, greatest(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) AS dpd FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("emi_aggregate", EMI_SQL + " SELECT a.app_id, count(e.app_id) AS n_emi, CAST(coalesce(sum(missed), 0) AS BIGINT) AS n_missed, CAST(coalesce(max(dpd), 0) AS BIGINT) AS max_dpd, CAST(coalesce(sum(dpd), 0) AS BIGINT) AS sum_dpd, round(coalesce(avg(dpd), 0), 6) + 0 AS mean_dpd, round(coalesce(avg(missed), 0), 6) + 0 AS miss_rate, CASE WHEN max(dpd) >= 30 THEN 1 ELSE 0 END AS ever_dpd30, coalesce(max(CASE WHEN no = 1 THEN missed END), 0) AS first_missed FROM apps a LEFT JOIN e ON e.app_id = a.app_id GROUP BY a.app_id")
def _(s, d):
    e = installments(s, d).groupBy("app_id").agg(F.count("*").alias("n_emi"), F.sum("missed").alias("n_missed"), F.max("dpd").cast("long").alias("max_dpd"), F.sum("dpd").cast("long").alias("sum_dpd"), F.avg("dpd").alias("mean_dpd"), F.avg("missed").alias("miss_rate"), F.max(F.when(F.col("no") == 1, F.col("missed"))).alias("first_missed"))
    z = applications(s, d).select("app_id").join(e, "app_id", "left").fillna(0)
    return z.select("app_id", "n_emi", "n_missed", "max_dpd", "sum_dpd", r6("mean_dpd").alias("mean_dpd"), r6("miss_rate").alias("miss_rate"), F.when(F.col("max_dpd") >= 30, 1).otherwise(0).alias("ever_dpd30"), "first_missed")


@query("winsorise", "SELECT app_id, round(least(greatest(amount, lo), hi), 6) + 0 AS amount FROM apps, (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM apps)")
def _(s, d):
    a = applications(s, d)
    q = evaluation.percentiles(a, "amount", [0.01, 0.99]).select(F.col("p0").alias("lo"), F.col("p1").alias("hi"))
    return a.crossJoin(F.broadcast(q)).select("app_id", r6(F.least(F.greatest("amount", "lo"), "hi")).alias("amount"))


@query("pct_rank", ", g AS (SELECT product, amount, count(*) AS n FROM apps GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY product ORDER BY amount ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY product) AS t FROM g) SELECT app_id, round((c - n + (n + 1) / 2.0) / t, 6) + 0 AS pct FROM apps JOIN r USING (product, amount)")
def _(s, d):
    a = applications(s, d)
    g = a.groupBy("product", "amount").agg(F.count("*").alias("n"))
    c = F.sum("n").over(Window.partitionBy("product").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0))
    r = g.withColumn("c", c).withColumn("t", F.sum("n").over(Window.partitionBy("product")))
    return a.join(r, ["product", "amount"]).select("app_id", r6((F.col("c") - F.col("n") + (F.col("n") + 1) / 2) / F.col("t")).alias("pct"))


DEG = ", nd AS (SELECT relation, node, count(*) AS nd FROM inc GROUP BY ALL)"


@query("rel_degree", DEG + " SELECT relation, app_id, count(*) AS deg, round(avg(nd), 6) + 0 AS node_deg, CAST(sum(nd - 1) AS BIGINT) AS co FROM inc JOIN nd USING (relation, node) GROUP BY ALL")
def _(s, d):
    return graphfeatures.degrees(incidence(s, d)).select("relation", "app_id", "deg", r6("node_deg").alias("node_deg"), "co")


@query("hub_filter", DEG + " SELECT relation, count(*) AS n FROM inc JOIN nd USING (relation, node) WHERE nd <= 40 GROUP BY relation")
def _(s, d):
    return graphfeatures.hub_filtered(incidence(s, d), 40).groupBy("relation").agg(F.count("*").alias("n"))


EDGES = f", ed AS (SELECT a.app_id AS src, b.app_id AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.relation = b.relation AND a.node = b.node AND a.app_id < b.app_id WHERE a.relation IN {STRONG_SQL} GROUP BY 1, 2)"


def _edges(s, d):
    return graphfeatures.pair_edges(incidence(s, d), STRONG)


@query("pair_edges_weighted", EDGES + " SELECT src, dst, weight FROM ed")
def _(s, d):
    return _edges(s, d)


@query("symmetrise_edges", EDGES + " SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed")
def _(s, d):
    e = _edges(s, d)
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).where("a <> b").distinct()


@query("burst_7d_30d", ", w AS (SELECT relation, app_id, count(*) OVER (PARTITION BY relation, node ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) - 1 AS b7, count(*) OVER (PARTITION BY relation, node ORDER BY day RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) - 1 AS b30 FROM inc JOIN apps USING (app_id) WHERE relation <> 'dealer') SELECT relation, app_id, CAST(sum(b7) AS BIGINT) AS burst_7d, CAST(sum(b30) AS BIGINT) AS burst_30d FROM w GROUP BY ALL")
def _(s, d):
    return graphfeatures.bursts(incidence(s, d).where("relation <> 'dealer'"), applications(s, d))


@query("entropy_node", ", b AS (SELECT relation, node, cust, count(*) AS c FROM inc JOIN apps USING (app_id) WHERE relation IN ('device', 'dealer', 'account') GROUP BY ALL), t AS (SELECT relation, node, sum(c) AS t FROM b GROUP BY ALL), h AS (SELECT relation, node, CASE WHEN max(t) >= 2 THEN sum(-(c / t) * ln(c / t + 1e-12)) ELSE 0 END AS h FROM b JOIN t USING (relation, node) GROUP BY ALL) SELECT relation, app_id, round(max(h), 6) + 0 AS entropy FROM inc JOIN h USING (relation, node) GROUP BY ALL")
def _(s, d):
    i = incidence(s, d).where("relation in ('device', 'dealer', 'account')")
    return graphfeatures.entropies(i, applications(s, d)).select("relation", "app_id", r6("entropy").alias("entropy"))


@query("nbr_stats", ", b AS (SELECT relation, node, app_id, CAST(round(amount * 100) AS BIGINT)::DOUBLE AS v FROM inc JOIN apps USING (app_id) WHERE relation <> 'person'), n AS (SELECT relation, node, count(*) AS n, sum(v) AS s FROM b GROUP BY ALL), a AS (SELECT relation, app_id, any_value(v) AS v, sum(n - 1) AS w, sum(s - v) AS s FROM b JOIN n USING (relation, node) GROUP BY ALL) SELECT relation, app_id, CASE WHEN w > 0 THEN s / w ELSE 0 END AS nbr_mean, CASE WHEN w > 0 THEN v - s / w ELSE 0 END AS nbr_diff, CASE WHEN w > 0 THEN 1 ELSE 0 END AS has_nbr FROM a")
def _(s, d):
    n = graphfeatures.neighbour_stats(incidence(s, d).where("relation <> 'person'"), applications(s, d).withColumn("cents", F.round(F.col("amount") * 100).cast("long")), "cents")
    return n.select("relation", "app_id", "nbr_mean", "nbr_diff", "has_nbr")


def _components(s, d, cap=None, inc=None):
    """Every application's component over the strong relations; alone: its own id."""
    inc = inc if inc is not None else incidence(s, d)
    c = connected_components(graphfeatures.star_edges(inc, STRONG, cap), "a", "b")
    a = applications(s, d).select("app_id")
    return a.join(c, a["app_id"] == c["node"], "left").select("app_id", F.coalesce("component", "app_id").alias("component"))


COMP = f", se AS (SELECT DISTINCT a.app_id AS a, b.app_id AS b FROM inc a JOIN inc b USING (relation, node) WHERE relation IN {STRONG_SQL}), reach(a, b) AS (SELECT app_id, app_id FROM apps UNION SELECT reach.a, se.b FROM reach JOIN se ON reach.b = se.a), comp AS (SELECT a AS app_id, min(b) AS component FROM reach GROUP BY a)"


@query("components_strong", COMP + " SELECT app_id, component FROM comp")
def _(s, d):
    return _components(s, d)


@query("components_capped", COMP.replace("FROM inc a JOIN", "FROM (SELECT * FROM inc SEMI JOIN (SELECT relation, node FROM inc GROUP BY ALL HAVING count(*) <= 2) USING (relation, node)) a JOIN") + " SELECT app_id, component FROM comp")
def _(s, d):
    return _components(s, d, cap=2)


@query("component_size", COMP + " SELECT app_id, count(*) OVER (PARTITION BY component) AS component_size FROM comp")
def _(s, d):
    c = _components(s, d)
    return c.join(c.groupBy("component").agg(F.count("*").alias("component_size")), "component").select("app_id", "component_size")


@query("crossfold_edge_rate", EDGES + COMP + " SELECT count(*) AS edges, round(avg(CASE WHEN x.component % 5 <> y.component % 5 THEN 1 ELSE 0 END), 6) + 0 AS crossing FROM ed JOIN comp x ON x.app_id = src JOIN comp y ON y.app_id = dst")
def _(s, d):
    c = written(_components(s, d), "components")
    a, b = c.select(F.col("app_id").alias("src"), F.col("component").alias("x")), c.select(F.col("app_id").alias("dst"), F.col("component").alias("y"))
    return _edges(s, d).join(a, "src").join(b, "dst").agg(F.count("*").alias("edges"), r6(F.avg((F.col("x") % 5 != F.col("y") % 5).cast("double"))).alias("crossing"))


@query("kfold_assign")
def _(s, d):
    g = written(_components(s, d), "components").withColumnRenamed("component", "group")
    return g.join(evaluation.group_folds(g, 5), "group").select("app_id", "group", "fold")


HASH = "(app_id * 2654435761 + 99) % 4294967296"


@query("stratified_split", Y + f" SELECT app_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {HASH}, app_id) - 1) % 5 AS INTEGER) AS fold FROM y")
def _(s, d):
    place = evaluation.numbered(_y(applications(s, d)).withColumn("h", F.expr(HASH)), [F.asc("h"), F.asc("app_id")], ["y"])
    return place.select("app_id", "y", ((F.col("place") - 1) % 5).cast("int").alias("fold"))


def _shuffled(s, d):
    """Labels dealt anew inside each fold: ``app_id, fold, y``."""
    f = _y(applications(s, d)).withColumn("fold", F.expr("app_id % 5")).withColumn("h", F.expr(HASH))
    own = evaluation.numbered(f, [F.asc("app_id")], ["fold"], "i").select("app_id", "fold", "i")
    other = evaluation.numbered(f, [F.asc("h"), F.asc("app_id")], ["fold"], "i").select("fold", "i", "y")
    return own.join(other, ["fold", "i"]).select("app_id", "fold", "y")


SHUFFLED = Y + f", f AS (SELECT *, app_id % 5 AS fold FROM y), a AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY app_id) AS i, row_number() OVER (PARTITION BY fold ORDER BY {HASH}, app_id) AS j FROM f)"


@query("shuffle_control", SHUFFLED + " SELECT a.app_id, a.fold, b.y AS y FROM a JOIN a b ON a.fold = b.fold AND a.i = b.j")
def _(s, d):
    return _shuffled(s, d)


APSQL = "g AS (SELECT {k} score, sum(y) AS p, count(*) AS n FROM {t} GROUP BY ALL), r AS (SELECT *, sum(p) OVER ({w} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER ({w} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS upto FROM g)"


@query("avg_precision", Y + ", " + APSQL.format(k="", t="y", w="") + " SELECT round(sum(p * tp / upto) / sum(p), 6) + 0 AS ap FROM r")
def _(s, d):
    return evaluation.average_precision(_y(applications(s, d))).select(r6("ap").alias("ap"))


@query("control_verdict", SHUFFLED + ", sh AS (SELECT a.score, b.y FROM a JOIN a b ON a.fold = b.fold AND a.i = b.j), " + APSQL.format(k="", t="sh", w="") + ", ap AS (SELECT sum(p * tp / upto) / sum(p) AS ap FROM r), ba AS (SELECT avg(y) AS base_rate FROM sh) SELECT round(ap, 6) + 0 AS ap, round(base_rate, 6) + 0 AS base_rate, ap < 1.5 * base_rate AS at_chance FROM ap, ba")
def _(s, d):
    x = _shuffled(s, d).join(applications(s, d).select("app_id", "score"), "app_id")
    return evaluation.control_verdict(x).select(r6("ap").alias("ap"), r6("base_rate").alias("base_rate"), "at_chance")


@query("leak_gap", Y + ", two AS (SELECT y.y, unnest([{'model': 'a', 'score': apps.score}, {'model': 'b', 'score': apps.amount}], recursive := true) FROM apps JOIN y USING (app_id)), " + APSQL.format(k="model,", t="two", w="PARTITION BY model") + ", ap AS (SELECT model, sum(p * tp / upto) / sum(p) AS ap FROM r GROUP BY model) SELECT round(a.ap, 6) + 0 AS random_ap, round(b.ap, 6) + 0 AS disjoint_ap, round(a.ap - b.ap, 6) + 0 AS gap, a.ap - b.ap > 0.01 AS inflated FROM ap a, ap b WHERE a.model = 'a' AND b.model = 'b'")
def _(s, d):
    a = applications(s, d).withColumn("y", F.when(F.col("ring") > 0, 1).otherwise(0))
    return evaluation.leak_gap(a, "score", "amount").select(r6("random_ap").alias("random_ap"), r6("disjoint_ap").alias("disjoint_ap"), r6("gap").alias("gap"), "inflated")


@query("best_single_feature", Y + ", f AS (SELECT app_id, unnest([{'feature': 'amount', 'score': amount}, {'feature': 'day', 'score': CAST(day AS DOUBLE)}, {'feature': 'income', 'score': income}, {'feature': '-amount', 'score': -amount}, {'feature': '-day', 'score': -CAST(day AS DOUBLE)}, {'feature': '-income', 'score': -income}], recursive := true) FROM apps), x AS (SELECT feature, f.score, y FROM f JOIN y USING (app_id)), " + APSQL.format(k="feature,", t="x", w="PARTITION BY feature") + " SELECT feature, round(sum(p * tp / upto) / sum(p), 6) + 0 AS ap FROM r GROUP BY feature")
def _(s, d):
    a = applications(s, d).withColumn("y", F.when(F.col("ring") > 0, 1).otherwise(0))
    cols = {"amount": F.col("amount"), "day": F.col("day").cast("double"), "income": F.col("income")}
    cols |= {f"-{k}": -v for k, v in cols.items()}
    x = a.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("score")) for k, v in cols.items()])).alias("f")).select("y", "f.*")
    return evaluation.average_precision(x, ["feature"]).select("feature", r6("ap").alias("ap"))


AUC = Y + ", g AS (SELECT score, sum(y) AS p, count(*) AS n FROM y GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0 AS rk FROM g), t AS (SELECT sum(rk * p) AS rs, CAST(sum(p) AS DOUBLE) AS np, CAST(sum(n - p) AS DOUBLE) AS nn FROM r)"


@query("roc_auc", AUC + " SELECT round((rs - np * (np + 1) / 2) / (np * nn), 6) + 0 AS auc FROM t")
def _(s, d):
    return evaluation.roc_auc(_y(applications(s, d))).select(r6("auc").alias("auc"))


@query("mann_whitney", AUC + " SELECT round(rs - np * (np + 1) / 2, 6) + 0 AS u, round((rs - np * (np + 1) / 2 - np * nn / 2) / sqrt(np * nn * (np + nn + 1) / 12), 6) + 0 AS z FROM t")
def _(s, d):
    y = _y(applications(s, d))
    n = y.agg(F.sum("y").cast("double").alias("np"), F.sum(1 - F.col("y")).cast("double").alias("nn"))
    z = (F.col("u") - F.col("np") * F.col("nn") / 2) / F.sqrt(F.col("np") * F.col("nn") * (F.col("np") + F.col("nn") + 1) / 12)
    return evaluation.roc_auc(y).crossJoin(n).select(r6("u").alias("u"), r6(z).alias("z"))


@query("recall_at_k", Y + ", r AS (SELECT y, row_number() OVER (ORDER BY score DESC, app_id) AS r FROM y), k AS (SELECT s AS share, greatest(CAST(round_even(s * (SELECT count(*) FROM y), 0) AS BIGINT), 1) AS k FROM (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS s)) SELECT share, k, round(sum(CASE WHEN r <= k THEN y ELSE 0 END) / (SELECT sum(y) FROM y), 6) + 0 AS recall FROM r, k GROUP BY share, k")
def _(s, d):
    return evaluation.recall_at(_y(applications(s, d))).select("share", "k", r6("recall").alias("recall"))


@query("lift_base_rate", Y + ", r AS (SELECT y, row_number() OVER (ORDER BY score DESC, app_id) AS r FROM y) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) + 0 AS base_rate, round(avg(CASE WHEN r <= 100 THEN y END) / avg(y), 6) + 0 AS lift_100 FROM r")
def _(s, d):
    r = evaluation.numbered(_y(applications(s, d)), [F.desc("score"), F.asc("app_id")], name="r")
    return r.agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), r6(F.avg("y")).alias("base_rate"), r6(F.avg(F.when(F.col("r") <= 100, F.col("y"))) / F.avg("y")).alias("lift_100"))


def _ring_parts(s, d):
    """Cluster members and their scores; the incidence is written once and read by every part."""
    inc = written(incidence(s, d), "incidence")
    c = written(_components(s, d, inc=inc).select(F.col("component").alias("cluster"), "app_id"), "components")
    return c, rings.ring_scores(c, applications(s, d), inc, graphfeatures.pair_edges(inc, STRONG))


def _ring_table(s, d):
    return _ring_parts(s, d)[1]


RING = EDGES + COMP + f""", m AS (SELECT component AS cluster, app_id, day, score, ring FROM comp JOIN apps USING (app_id)),
sz AS (SELECT cluster, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 3), mm AS (SELECT m.*, n FROM m JOIN sz USING (cluster)),
w AS (SELECT *, count(*) OVER (PARTITION BY cluster ORDER BY day RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS w14 FROM mm),
base AS (SELECT cluster, any_value(n) AS n, max(w14) AS w14, avg(score) AS mean_score, avg(CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM apps) THEN 1 ELSE 0 END) AS frac_hot, max(day) - min(day) AS span FROM w GROUP BY cluster),
rl AS (SELECT cluster, count(DISTINCT node) FILTER (WHERE relation = 'device') AS dd, count(DISTINCT node) FILTER (WHERE relation = 'account') AS da, count(DISTINCT node) FILTER (WHERE relation = 'person') AS dp, count(DISTINCT node) FILTER (WHERE relation = 'guarantor') AS dg, count(*) FILTER (WHERE relation = 'guarantor') AS lg FROM mm JOIN inc USING (app_id) GROUP BY cluster),
de AS (SELECT x.component AS cluster, count(*) AS links FROM ed JOIN comp x ON x.app_id = src JOIN comp y ON y.app_id = dst WHERE x.component = y.component GROUP BY 1),
ax AS (SELECT base.*, greatest(0, 1 - coalesce(dd, 0) / n) AS device, greatest(0, 1 - coalesce(da, 0) / n) AS account, greatest(0, 1 - coalesce(dp, 0) / n) AS person, CASE WHEN lg >= 2 THEN 1 - dg / lg ELSE 0 END AS guarantor, w14 / n AS burst, least(1, coalesce(links, 0) / (n * (n - 1) / 2)) AS density FROM base LEFT JOIN rl USING (cluster) LEFT JOIN de USING (cluster)),
sc AS (SELECT *, greatest(device, account, person, guarantor, burst) AS top, CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY mean_score, cluster) - 1) / (count(*) OVER () - 1) ELSE 0 END AS r01 FROM ax),
fin AS (SELECT *, 0.8 * top + 0.2 * density AS structural, 0.5 * r01 + 0.5 * frac_hot AS corroboration, CASE WHEN device = top THEN 'device' WHEN account = top THEN 'account' WHEN person = top THEN 'person' WHEN guarantor = top THEN 'guarantor' ELSE 'burst' END AS dominant_axis FROM sc)"""


@query("ring_concentration", RING + " SELECT cluster, n, round(device, 6) + 0 AS device, round(account, 6) + 0 AS account, round(person, 6) + 0 AS person, round(guarantor, 6) + 0 AS guarantor FROM fin")
def _(s, d):
    return _ring_table(s, d).select("cluster", "n", *[r6(c).alias(c) for c in ("device", "account", "person", "guarantor")])


@query("ring_burst14", RING + " SELECT cluster, round(burst, 6) + 0 AS burst, span FROM fin")
def _(s, d):
    return _ring_table(s, d).select("cluster", r6("burst").alias("burst"), "span")


@query("ring_density", RING + " SELECT cluster, round(density, 6) + 0 AS density FROM fin")
def _(s, d):
    return _ring_table(s, d).select("cluster", r6("density").alias("density"))


@query("ring_score", RING + " SELECT cluster, n, round(structural, 6) + 0 AS structural, round(0.65 * corroboration + 0.35 * structural, 4) + 0 AS ring_score, dominant_axis FROM fin")
def _(s, d):
    return _ring_table(s, d).select("cluster", "n", r6("structural").alias("structural"), (F.round("ring_score", 4) + 0.0).alias("ring_score"), "dominant_axis")


JUDGED = RING + ", rl3 AS (SELECT cluster, ring, count(*) AS c FROM m WHERE ring > 0 GROUP BY ALL), fr AS (SELECT cluster, CAST(sum(c) AS BIGINT) AS f, max(c) >= 3 AS is_true FROM rl3 GROUP BY cluster), jd AS (SELECT cluster, n, 0.65 * corroboration + 0.35 * structural AS s, coalesce(f, 0) AS f, coalesce(is_true, FALSE) AS is_true FROM fin LEFT JOIN fr USING (cluster)), tt AS (SELECT greatest(count(*), 1) AS total FROM apps WHERE ring > 0)"


def _judged(s, d):
    c, t = _ring_parts(s, d)
    a = applications(s, d)
    return written(rings.judged(t, c, a), "rings"), a.where("ring > 0").agg(F.count("*").alias("total"))


@query("budget_curve", JUDGED + ", rk AS (SELECT *, row_number() OVER (ORDER BY s DESC, cluster) AS k FROM jd) SELECT k, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS apps_reviewed, CAST(sum(f) OVER (ORDER BY k) AS BIGINT) AS fraud_caught, round(sum(f) OVER (ORDER BY k) / total, 6) + 0 AS recall, round(avg(CASE WHEN is_true THEN 1 ELSE 0 END) OVER (ORDER BY k), 6) + 0 AS precision_clusters FROM rk, tt QUALIFY k <= 25")
def _(s, d):
    return rings.budget(*_judged(s, d)).select("k", "apps_reviewed", "fraud_caught", r6("recall").alias("recall"), r6("precision_clusters").alias("precision_clusters"))


@query("rings_at_threshold", JUDGED + " SELECT count(*) AS clusters, count(*) FILTER (WHERE is_true) AS true_rings, count(*) FILTER (WHERE s >= 0.5) AS flagged, count(*) FILTER (WHERE s >= 0.5 AND is_true) AS true_flagged, round(count(*) FILTER (WHERE s >= 0.5 AND is_true) / greatest(count(*) FILTER (WHERE is_true), 1), 6) + 0 AS ring_recall, round(count(*) FILTER (WHERE s >= 0.5 AND is_true) / nullif(count(*) FILTER (WHERE s >= 0.5), 0), 6) + 0 AS precision, CAST(coalesce(sum(f) FILTER (WHERE s >= 0.5), 0) AS BIGINT) AS fraud_covered, round(coalesce(sum(f) FILTER (WHERE s >= 0.5), 0) / any_value(total), 6) + 0 AS app_recall, count(*) FILTER (WHERE s >= 0.5 AND NOT is_true) AS false_positives, coalesce(quantile_cont(n, 0.5) FILTER (WHERE s >= 0.5 AND NOT is_true), 0)::DOUBLE AS fp_median_apps FROM jd, tt")
def _(s, d):
    t = rings.at_threshold(*_judged(s, d))
    return t.select(*[r6(c).alias(c) if c in ("ring_recall", "precision", "app_recall") else F.col(c).cast("double").alias(c) if c == "fp_median_apps" else c for c in t.columns])


@query("skeleton_key", "SELECT p_partkey, substring(translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'eiou', 'aaaa'), 1, 6) AS skeleton FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", linkage.skeleton(F.col("p_name")).alias("skeleton"))


@query("sha_hash", "SELECT c_custkey, substring(sha256(c_name), 1, 16) AS h FROM customer")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 16).alias("h"))


def _records(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))


def _keys():
    """The two blocking keys of a part; a missing part of one leaves no key, as in SQL."""
    return [F.concat(F.lit("bt|"), "brand", F.lit("|"), "type"), F.concat(F.lit("ss|"), linkage.skeleton(F.col("last")), F.lit("|"), "size")]


def _pairs(s, d):
    return linkage.block_pairs(_records(s, d), _keys())


REC = ", rec AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part), ky AS (SELECT id, unnest(['bt|' || brand || '|' || type, 'ss|' || substring(translate(regexp_replace(lower(last), '[^a-z]', '', 'g'), 'eiou', 'aaaa'), 1, 6) || '|' || size]) AS key FROM rec), pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ky x JOIN ky y ON x.key = y.key AND x.id < y.id)"
JW = "(jaro_similarity({0}, {1}) + 0.1 * (CASE WHEN substring({0}, 1, 4) = substring({1}, 1, 4) AND length({0}) >= 4 AND length({1}) >= 4 THEN 4 WHEN substring({0}, 1, 3) = substring({1}, 1, 3) AND length({0}) >= 3 AND length({1}) >= 3 THEN 3 WHEN substring({0}, 1, 2) = substring({1}, 1, 2) AND length({0}) >= 2 AND length({1}) >= 2 THEN 2 WHEN substring({0}, 1, 1) = substring({1}, 1, 1) AND length({0}) >= 1 AND length({1}) >= 1 THEN 1 ELSE 0 END) * (1 - jaro_similarity({0}, {1})))"
LEV = REC + ", lv AS (SELECT a, b, " + ", ".join(f"CASE WHEN x.{c} = y.{c} THEN 0 WHEN {JW.format(f'x.{c}', f'y.{c}')} >= 0.90 THEN 1 WHEN {JW.format(f'x.{c}', f'y.{c}')} >= 0.78 THEN 2 ELSE 3 END AS g_{c}" for c in ("first", "last")) + ", " + ", ".join(f"CASE WHEN x.{c} = y.{c} THEN 0 ELSE 1 END AS g_{c}" for c in ("brand", "type", "size")) + " FROM pr JOIN rec x ON x.id = a JOIN rec y ON y.id = b)"
FIELDS, SIZES = ["first", "last", "brand", "type", "size"], [4, 4, 2, 2, 2]


def _leveled(s, d, unit=None):
    return linkage.levels(unit or linkage.units(_records(s, d), _keys(), FIELDS), FIELDS[:2], FIELDS[2:])


@query("er_block_pairs", REC + " SELECT a, b FROM pr")
def _(s, d):
    return _pairs(s, d)


@query("er_jaro_winkler", REC + f" SELECT a, b, round({JW.format('x.last', 'y.last')}, 6) + 0 AS jw FROM pr JOIN rec x ON x.id = a JOIN rec y ON y.id = b")
def _(s, d):
    unit = linkage.units(_records(s, d), _keys(), ["last"])
    j = linkage.similar(linkage.unit_pairs(unit), unit, "last")
    return linkage.expanded(j.withColumn("of", F.struct(r6("last_jw").alias("jw"))))


@query("er_jaro_shuffled", ", w AS (SELECT p_partkey AS id, p_name AS x, reverse(p_type) AS t, split_part(p_name, ' ', 2) || reverse(split_part(p_name, ' ', 1)) AS y FROM part) SELECT id, round(jaro_similarity(x, y), 6) + 0 AS jaro_name, round(jaro_similarity(reverse(x), y), 6) + 0 AS jaro_back, round(jaro_similarity(t, x), 6) + 0 AS jaro_type FROM w")
def _(s, d):
    w = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x"), F.reverse("p_type").alias("t"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.reverse(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("y"))
    return w.select("id", r6(linkage.jaro_column(F.col("x"), F.col("y"))).alias("jaro_name"), r6(linkage.jaro_column(F.reverse("x"), F.col("y"))).alias("jaro_back"), r6(linkage.jaro_column(F.col("t"), F.col("x"))).alias("jaro_type"))


_PK = ", pk AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, CAST(p_size AS VARCHAR) AS b, p_brand AS z, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || p_size END AS m FROM part), kk AS (SELECT id, unnest([CASE WHEN m <> '' THEN 'mob|' || m END, CASE WHEN l <> '' THEN 'snd|' || substring(translate(regexp_replace(lower(l), '[^a-z]', '', 'g'), 'eiou', 'aaaa'), 1, 6) || '|' || b END, CASE WHEN l <> '' THEN 'l3|' || substring(l, 1, 3) || '|' || z END, CASE WHEN f <> '' AND l <> '' THEN 'fl|' || substring(f, 1, 1) || '|' || substring(l, 1, 4) || '|' || z END]) AS key FROM pk)"


def _person_keys(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    first, last = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    mobile = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat("p_type", F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), F.explode(F.array(*linkage.person_keys(first, last, F.col("p_size"), F.col("p_brand"), mobile))).alias("key")).where("key is not null")


@query("er_person_keys", _PK + " SELECT id, key FROM kk WHERE key IS NOT NULL")
def _(s, d):
    return _person_keys(s, d)


#: Parts of one brand, type and size as records of a person, for the queries on resolved ids.
_CL = ", cl AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size, substring(p_type, 1, 4)) AS cluster, split_part(p_name, ' ', 1) AS human FROM part), mp AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY cluster) > 1 THEN 'rp_' || cluster ELSE CAST(id AS VARCHAR) END AS resolved FROM cl)"


def _resolved(s, d):
    p = s.read.parquet(f"{d}/part.parquet").withColumn("kind", F.substring("p_type", 1, 4))
    keys = ["p_brand", "p_size", "kind"]
    low = p.groupBy(*keys).agg(F.min("p_partkey").alias("cluster"))
    return linkage.resolved_ids(p.join(low, keys).select(F.col("p_partkey").alias("id"), "cluster"))


@query("er_map_ids", _CL + " SELECT id, resolved FROM mp")
def _(s, d):
    return _resolved(s, d)


@query("er_rewrite", _CL + " SELECT l_orderkey, l_linenumber, coalesce(resolved, CAST(l_partkey AS VARCHAR)) AS l_partkey FROM lineitem LEFT JOIN mp ON l_partkey = id")
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return linkage.rewritten(li, "l_partkey", _resolved(s, d))


@query("er_collapse", _CL + " SELECT resolved AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(p_type, p_partkey) AS p_type FROM part JOIN mp ON p_partkey = id GROUP BY resolved")
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    return linkage.collapsed(p, "p_partkey", _resolved(s, d), "p_partkey")


@query("er_diagnose", _CL + ", g AS (SELECT resolved, count(*) AS n, count(DISTINCT human) AS h FROM mp JOIN cl USING (id) GROUP BY resolved HAVING count(*) > 1) SELECT count(*) AS clusters_merged, count(*) FILTER (WHERE h = 1) AS correct_merges, count(*) FILTER (WHERE h > 1) AS false_merges, CAST(coalesce(sum(n) FILTER (WHERE h > 1), 0) AS BIGINT) AS records_welded_wrongly FROM g")
def _(s, d):
    truth = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("human"))
    return linkage.merge_diagnostics(_resolved(s, d), truth)


@query("er_levels", LEV + " SELECT * FROM lv")
def _(s, d):
    return linkage.expanded(_leveled(s, d))


@query("er_pattern_counts", LEV + " SELECT g_first, g_last, g_brand, g_type, g_size, count(*) AS n FROM lv GROUP BY ALL")
def _(s, d):
    return linkage.pattern_counts(_leveled(s, d))


@query("er_clusters")
def _(s, d):
    unit = linkage.units(_records(s, d), _keys(), FIELDS)
    c = connected_components(linkage.link_edges(linkage.link(_leveled(s, d, unit), FIELDS, SIZES), unit), "a", "b")
    return _records(s, d).join(c, F.col("id") == c["node"], "left").select("id", F.coalesce("component", "id").alias("cluster"))


PRSQL = EDGES + ", bo AS (SELECT src AS a, dst AS b, weight AS w FROM ed UNION ALL SELECT dst, src, weight FROM ed), dg AS (SELECT a, {t} AS t FROM bo GROUP BY a), nn AS (SELECT count(*) AS n FROM apps), r0 AS (SELECT app_id, {tele} AS tele, t, {tele} AS r FROM apps LEFT JOIN dg ON a = app_id)"
STEP = ", r{i} AS (SELECT app_id, tele, t, 0.85 * coalesce(f, 0) + 0.15 * tele {leak} AS r FROM r{j} LEFT JOIN (SELECT b, sum(r / t * {w}) AS f FROM bo JOIN r{j} ON app_id = a GROUP BY b) ON b = app_id)"


def _unrolled(tele, t, w, leak):
    return PRSQL.format(t=t, tele=tele) + "".join(STEP.format(i=i, j=i - 1, w=w, leak=leak.format(j=i - 1)) for i in (1, 2, 3)) + " SELECT app_id, round(r, 9) + 0 AS rank FROM r3"


@query("pagerank_k3", _unrolled("(1.0 / (SELECT n FROM nn))::DOUBLE", "count(*)", "1", "+ 0.85 * coalesce((SELECT sum(r) FROM r{j} WHERE t IS NULL), 0) / (SELECT n FROM nn)"))
def _(s, d):
    return graphfeatures.pagerank(_edges(s, d), applications(s, d).select("app_id"), 3).select("app_id", (F.round("rank", 9) + 0.0).alias("rank"))


@query("ppr_seeded_k3", _unrolled("(CASE WHEN ring = 1 THEN 1.0 / (SELECT count(*) FROM apps WHERE ring = 1) ELSE 0 END)::DOUBLE", "sum(w)", "w", ""))
def _(s, d):
    a = applications(s, d)
    return graphfeatures.pagerank(_edges(s, d), a.select("app_id"), 3, seeds=a.where("ring = 1").select("app_id")).select("app_id", (F.round("rank", 9) + 0.0).alias("rank"))


@query("pagerank_normalised", _unrolled("(1.0 / (SELECT n FROM nn))::DOUBLE", "count(*)", "1", "+ 0.85 * coalesce((SELECT sum(r) FROM r{j} WHERE t IS NULL), 0) / (SELECT n FROM nn)").replace(" SELECT app_id, round(r, 9) + 0 AS rank FROM r3", " SELECT app_id, round(1 - (row_number() OVER (ORDER BY round(r, 12) DESC, app_id) - 1) / greatest((SELECT n FROM nn) - 1, 1), 6) + 0 AS centrality FROM r3"))
def _(s, d):
    r = graphfeatures.pagerank(_edges(s, d), applications(s, d).select("app_id"), 3)
    return graphfeatures.rank_normalised(r).select("app_id", r6("centrality").alias("centrality"))


@query("pagerank_settled")
def _(s, d):
    return graphfeatures.pagerank(_edges(s, d), applications(s, d).select("app_id"), 30, tol=1e-10)


BOTH = EDGES + ", bo AS (SELECT src AS a, dst AS b FROM ed UNION ALL SELECT dst, src FROM ed)"


@query("two_hop", BOTH + " SELECT x.a AS app_id, count(*) AS walks2 FROM bo x JOIN bo y ON x.b = y.a WHERE y.b <> x.a GROUP BY 1")
def _(s, d):
    return graphfeatures.two_hop(_edges(s, d)).where("walks2 > 0").select(F.col("src").alias("app_id"), "walks2")


@query("triangles", BOTH + ", t AS (SELECT e.src AS x, e.dst AS y, f.dst AS z FROM ed e JOIN ed f ON e.dst = f.src JOIN ed g ON g.src = e.src AND g.dst = f.dst) SELECT app_id, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS app_id FROM t) GROUP BY 1")
def _(s, d):
    return graphfeatures.triangles(_edges(s, d))


@query("degree_bucket", BOTH + " SELECT a AS app_id, CAST(least(floor(ln(1 + count(*))), 63) AS BIGINT) AS bucket FROM bo GROUP BY a")
def _(s, d):
    e = _edges(s, d)
    return e.select("src").union(e.select("dst")).groupBy(F.col("src").alias("app_id")).agg(F.least(F.floor(F.log1p(F.count("*"))), F.lit(63)).alias("bucket"))


@query("subsample_induced", EDGES + f", k AS (SELECT app_id FROM apps WHERE ring > 0 OR {HASH} % 10 < 4) SELECT src, dst, weight FROM ed WHERE src IN (SELECT app_id FROM k) AND dst IN (SELECT app_id FROM k)")
def _(s, d):
    k = applications(s, d).where(F.expr(f"ring > 0 or {HASH} % 10 < 4")).select("app_id")
    return _edges(s, d).join(k.withColumnRenamed("app_id", "src"), "src", "left_semi").join(k.withColumnRenamed("app_id", "dst"), "dst", "left_semi")


@query("explain_signals", DEG + ", f AS (SELECT relation AS feature, app_id, CAST(sum(nd - 1) AS DOUBLE) AS v FROM inc JOIN nd USING (relation, node) GROUP BY ALL), q AS (SELECT feature, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM f GROUP BY feature), z AS (SELECT app_id, feature, v, (v - med) / nullif(iqr, 0) AS z FROM f JOIN q USING (feature)) SELECT app_id, feature, round(v, 6) + 0 AS value, round(z, 6) + 0 AS z, row_number() OVER (PARTITION BY app_id ORDER BY z DESC, feature) AS place FROM z WHERE z > 0.5 QUALIFY place <= 5")
def _(s, d):
    f = graphfeatures.degrees(incidence(s, d)).select(F.col("relation").alias("feature"), "app_id", F.col("co").cast("double").alias("v"))
    q = evaluation.percentiles(f, "v", [0.25, 0.5, 0.75], ["feature"]).select("feature", F.col("p1").alias("med"), (F.col("p2") - F.col("p0")).alias("iqr"))
    z = f.join(F.broadcast(q), "feature").withColumn("z", (F.col("v") - F.col("med")) / F.when(F.col("iqr") != 0, F.col("iqr"))).where("z > 0.5")
    w = Window.partitionBy("app_id").orderBy(F.desc("z"), "feature")
    return z.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("app_id", "feature", r6("v").alias("value"), r6("z").alias("z"), "place")


@query("explain_shared", DEG + ", n AS (SELECT i.relation, i.app_id, i.node, nd - 1 AS others FROM inc i JOIN nd USING (relation, node) WHERE nd > 1) SELECT relation, app_id, count(*) AS shared_nodes, CAST(sum(others) AS BIGINT) AS others FROM n GROUP BY ALL")
def _(s, d):
    i = incidence(s, d)
    nd = i.groupBy("relation", "node").agg(F.count("*").alias("nd")).where("nd > 1")
    return i.join(nd, ["relation", "node"]).groupBy("relation", "app_id").agg(F.count("*").alias("shared_nodes"), F.sum(F.col("nd") - 1).alias("others"))


@query("explain_neighbours", ", pr AS (SELECT DISTINCT a.relation, a.app_id, b.app_id AS other FROM inc a JOIN inc b ON a.relation = b.relation AND a.node = b.node AND a.app_id <> b.app_id), rk AS (SELECT *, row_number() OVER (PARTITION BY relation, app_id ORDER BY other) AS i FROM pr) SELECT relation, app_id, count(*) AS others, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (WHERE i <= 12) AS sample FROM rk GROUP BY ALL")
def _(s, d):
    from tessera.operators.casenotes import neighbours

    n = neighbours(written(incidence(s, d), "incidence"))
    return n.select("relation", "app_id", "others", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


def _signals(s, d):
    """Every signal that has a phrase, long: ``feature, app_id, v``."""
    a, inc = applications(s, d), written(incidence(s, d), "incidence")
    deg = graphfeatures.degrees(inc)
    burst = graphfeatures.bursts(inc.where("relation in ('device', 'account', 'guarantor')"), a)
    h = graphfeatures.entropies(inc.where("relation in ('device', 'account')"), a)
    size = _components(s, d, inc=inc)
    size = size.join(size.groupBy("component").agg(F.count("*").alias("n")), "component")
    named = lambda df, name, c: df.select(name.alias("feature"), "app_id", F.col(c).cast("double").alias("v"))
    rel = F.col("relation")
    parts = [
        named(deg, F.concat(F.lit("co_"), rel), "co"),
        named(deg.where("relation in ('device', 'account', 'guarantor')"), F.concat(F.lit("node_deg_"), rel), "node_deg"),
        named(burst.where("relation <> 'guarantor'"), F.concat(rel, F.lit("_burst_7d")), "burst_7d"),
        named(burst.where("relation <> 'account'"), F.concat(rel, F.lit("_burst_30d")), "burst_30d"),
        named(h, F.concat(F.lit("entropy_"), rel), "entropy"),
        named(size, F.lit("component_size"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _words_sql():
    from tessera.operators.casenotes import PHRASES

    return ", ".join(f"('{f}', '{t}', {h})" for f, (t, h) in PHRASES.items())


SIGNALS = DEG + COMP + f""", dg AS (SELECT relation, app_id, avg(nd) AS node_deg, sum(nd - 1) AS co FROM inc JOIN nd USING (relation, node) GROUP BY ALL),
bw AS (SELECT relation, app_id, count(*) OVER (PARTITION BY relation, node ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) - 1 AS b7, count(*) OVER (PARTITION BY relation, node ORDER BY day RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) - 1 AS b30 FROM inc JOIN apps USING (app_id) WHERE relation IN ('device', 'account', 'guarantor')),
bu AS (SELECT relation, app_id, sum(b7) AS b7, sum(b30) AS b30 FROM bw GROUP BY ALL),
eb AS (SELECT relation, node, cust, count(*) AS c FROM inc JOIN apps USING (app_id) WHERE relation IN ('device', 'account') GROUP BY ALL),
et AS (SELECT relation, node, sum(c) AS t FROM eb GROUP BY ALL),
eh AS (SELECT relation, node, CASE WHEN max(t) >= 2 THEN sum(-(c / t) * ln(c / t + 1e-12)) ELSE 0 END AS h FROM eb JOIN et USING (relation, node) GROUP BY ALL),
cs AS (SELECT component, count(*) AS n FROM comp GROUP BY ALL),
sg AS (SELECT 'co_' || relation AS feature, app_id, CAST(co AS DOUBLE) AS v FROM dg UNION ALL SELECT 'node_deg_' || relation, app_id, node_deg FROM dg WHERE relation IN ('device', 'account', 'guarantor') UNION ALL SELECT relation || '_burst_7d', app_id, b7 FROM bu WHERE relation <> 'guarantor' UNION ALL SELECT relation || '_burst_30d', app_id, b30 FROM bu WHERE relation <> 'account' UNION ALL SELECT 'entropy_' || relation, app_id, max(h) FROM inc JOIN eh USING (relation, node) GROUP BY ALL UNION ALL SELECT 'component_size', app_id, n FROM comp JOIN cs USING (component)),
ph(feature, words, high) AS (VALUES {_words_sql()}),
fu AS (SELECT ph.feature, a.app_id, words, high, coalesce(round(v, 6), 0) + 0 AS v FROM apps a CROSS JOIN (SELECT * FROM ph WHERE feature IN (SELECT feature FROM sg)) ph LEFT JOIN sg ON sg.feature = ph.feature AND sg.app_id = a.app_id),
qs AS (SELECT feature, quantile_cont(v, 0.5) AS med, nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0) AS iqr FROM fu GROUP BY feature),
zs AS (SELECT fu.*, CASE WHEN high THEN (v - med) / iqr ELSE -((v - med) / iqr) END AS strength, round(100 * cume_dist() OVER (PARTITION BY feature ORDER BY v), 1) AS pct FROM fu JOIN qs USING (feature))"""


@query("explain_notes", SIGNALS + " SELECT app_id, feature, round(v, 3) + 0 AS value, pct AS portfolio_percentile, replace(words, '{n}', CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(round(v, 2) AS VARCHAR) END) AS text, row_number() OVER (PARTITION BY app_id ORDER BY strength DESC, feature) AS place FROM zs WHERE strength > 0.5 QUALIFY place <= 5")
def _(s, d):
    from tessera.operators.casenotes import signal_notes

    return signal_notes(written(_signals(s, d), "signals"), applications(s, d))


@query("drawable_edges", COMP + f", fit AS (SELECT component FROM comp GROUP BY component HAVING count(*) BETWEEN 3 AND 90) SELECT a.relation, a.app_id AS src, b.app_id AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.relation = b.relation AND a.node = b.node AND a.app_id < b.app_id JOIN comp ON comp.app_id = a.app_id JOIN fit USING (component) WHERE a.relation IN {STRONG_SQL} GROUP BY ALL")
def _(s, d):
    from tessera.operators.casenotes import drawable_edges

    inc = written(incidence(s, d), "incidence")
    member = _components(s, d, inc=inc).select(F.col("component").alias("cluster"), "app_id")
    return drawable_edges(member, inc, STRONG)


@query("injected_rings")
def _(s, d):
    from tessera.operators.injection import inject_rings

    return inject_rings(_edges(s, d), applications(s, d).select("app_id"), 10, camouflage=0.5)[1]


@query("curated_union", " SELECT app_id FROM (SELECT app_id FROM apps ORDER BY score DESC, app_id LIMIT 150) UNION SELECT app_id FROM apps WHERE ring > 0")
def _(s, d):
    a = applications(s, d)
    return a.orderBy(F.desc("score"), "app_id").limit(150).select("app_id").union(a.where("ring > 0").select("app_id")).distinct()


@query("leadtime_first_detect", ", h AS (SELECT ring, day, row_number() OVER (PARTITION BY ring ORDER BY day, app_id) AS i FROM apps WHERE ring > 0), f AS (SELECT ring, min(day) FILTER (WHERE i >= 3) AS third, max(day) AS completion FROM h GROUP BY ring) SELECT ring, third + (7 - third % 7) % 7 AS detected, completion, completion - (third + (7 - third % 7) % 7) AS lead FROM f WHERE third IS NOT NULL")
def _(s, d):
    a = applications(s, d).where("ring > 0")
    h = a.withColumn("i", F.row_number().over(Window.partitionBy("ring").orderBy("day", "app_id")))
    f = h.groupBy("ring").agg(F.min(F.when(F.col("i") >= 3, F.col("day"))).alias("third"), F.max("day").alias("completion")).where("third is not null")
    snap = F.expr("third + (7 - third % 7) % 7")
    return f.select("ring", snap.alias("detected"), "completion", (F.col("completion") - snap).alias("lead"))


@query("leadtime_sweep", ", h AS (SELECT ring, day, row_number() OVER (PARTITION BY ring ORDER BY day, app_id) AS i FROM apps WHERE ring > 0), c AS (SELECT ring, max(day) AS completion FROM h GROUP BY ring), x AS (SELECT k, ring, min(day) AS t FROM h, (SELECT unnest([3, 4, 5, 6, 8]) AS k) WHERE i >= k GROUP BY ALL) SELECT k AS min_size, count(*) AS detected, count(*) FILTER (WHERE completion > t) AS before_completion, round(quantile_cont(completion - t, 0.5), 6) + 0 AS median_lead FROM x JOIN c USING (ring) GROUP BY k")
def _(s, d):
    a = applications(s, d).where("ring > 0")
    h = a.withColumn("i", F.row_number().over(Window.partitionBy("ring").orderBy("day", "app_id")))
    c = h.groupBy("ring").agg(F.max("day").alias("completion"))
    x = h.withColumn("min_size", F.explode(F.expr("filter(array(3, 4, 5, 6, 8), k -> k <= i)"))).groupBy("min_size", "ring").agg(F.min("day").alias("t"))
    lead = F.col("completion") - F.col("t")
    return x.join(c, "ring").groupBy("min_size").agg(F.count("*").alias("detected"), F.count(F.when(lead > 0, 1)).alias("before_completion"), r6(F.percentile(lead, 0.5)).alias("median_lead"))


def _replayed(s, d, step=7):
    """Weekly snapshots of the second half of the time."""
    from tessera.operators import leadtime

    a = written(applications(s, d), "applications")
    inc = written(incidence(s, d), "incidence")
    last = a.agg(F.max("day")).first()[0] or 0
    days = list(range(last // 2, last + 1, step))
    found = leadtime.replay(a, inc, graphfeatures.pair_edges(inc, STRONG), STRONG, days)
    swept = written(leadtime.sweep(written(found, "replayed"), a, last // 2), "swept")
    best = leadtime.chosen(swept).select("threshold", "min_size", F.lit(True).alias("chosen"))
    return swept.join(best, ["threshold", "min_size"], "left").fillna(False, ["chosen"])


@query("leadtime_replay")
def _(s, d):
    return _replayed(s, d)


_SECT = ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, e, f in finance.SECTORS)
_P, _W = finance.books()
_YEAR = ", ".join(f"({y}, {(_P * c if c else _W)!r}::DOUBLE, {p}::DOUBLE, {o + one}::DOUBLE)" for y, c, p, o, one in finance.YEARS)
_FLOW = f", yr(year, covered, ramp, base_cost) AS (VALUES {_YEAR}), cf AS (SELECT year, covered, covered * ({finance.WRITE_OFFS}::DOUBLE / {NET_BOOK}) * 0.2 * ramp * 0.5 AS avoided, covered * ({finance.WRITE_OFFS}::DOUBLE / {NET_BOOK}) * 0.2 * 0.1 * ramp * 0.5 AS recovered, base_cost + 0.0004 * covered AS cost FROM yr)"


@query("finance_cashflow", _FLOW + " SELECT year, round(avoided, 4) + 0 AS avoided, round(recovered, 4) + 0 AS recovered, round(cost, 4) + 0 AS cost, round(avoided + recovered - cost, 4) + 0 AS net FROM cf")
def _(s, d):
    f = finance.cash_flow(finance.base_draw(s), NET_BOOK)
    return f.select("year", *[(F.round(c, 4) + 0.0).alias(c) for c in ("avoided", "recovered", "cost", "net")])


@query("finance_npv", _FLOW + " SELECT round(sum((avoided + recovered - cost) / power(1.12::DOUBLE, year)), 4) + 0 AS npv FROM cf")
def _(s, d):
    return finance.cash_flow(finance.base_draw(s), NET_BOOK).agg((F.round(F.sum("pv"), 4) + 0.0).alias("npv"))


@query("sector_reconcile", f", se(sector, e, n, pe, pn) AS (VALUES {_SECT}) SELECT round(sum(e), 2) + 0 AS exposure, round(sum(n), 2) + 0 AS npa, abs(sum(e) - 31216.01) < 0.02 AND abs(sum(n) - 1141.36) < 0.02 AS reconciles FROM se")
def _(s, d):
    t = finance.sectors(s).agg(F.sum("exposure").alias("e"), F.sum("npa").alias("n"))
    ok = (F.abs(F.col("e") - finance.PRINTED[0]) < 0.02) & (F.abs(F.col("n") - finance.PRINTED[1]) < 0.02)
    return t.select((F.round("e", 2) + 0.0).alias("exposure"), (F.round("n", 2) + 0.0).alias("npa"), ok.alias("reconciles"))


_HIST = ", ".join(f"('{y}', {v}::DOUBLE, {c}::DOUBLE)" for y, v, c in finance.HISTORY)


@query("severity_surge", f", hi(year, v, c) AS (VALUES {_HIST}) SELECT year, round(v / c, 6) + 0 AS severity, round((v / c) / (SELECT v / c FROM hi WHERE year = 'FY24'), 6) + 0 AS surge FROM hi")
def _(s, d):
    h = s.createDataFrame([(y, v, float(c)) for y, v, c in finance.HISTORY], "year string, v double, c double").withColumn("sev", F.col("v") / F.col("c"))
    first = finance.HISTORY[0][1] / finance.HISTORY[0][2]
    return h.select("year", r6("sev").alias("severity"), r6(F.col("sev") / first).alias("surge"))


@query("mc_npv")
def _(s, d):
    return finance.monte_carlo(s, NET_BOOK)


@query("oof_logistic")
def _(s, d):
    from tessera.operators.models import out_of_fold

    return out_of_fold(written(_features(s, d), "features"), ["amount", "income", "co_device", "co_account", "co_person"], folds=3)


def _features(s, d):
    a = applications(s, d).withColumn("y", F.when(F.col("ring") > 0, 1.0).otherwise(0.0)).withColumn("fold", F.expr("cast(app_id % 3 as int)"))
    co = graphfeatures.degrees(incidence(s, d)).groupBy("app_id").pivot("relation", ["device", "account", "person", "dealer", "guarantor"]).agg(F.first("co"))
    co = co.select("app_id", *[F.coalesce(c, F.lit(0)).cast("double").alias(f"co_{c}") for c in ("device", "account", "person", "dealer", "guarantor")])
    return a.join(co, "app_id", "left").fillna(0.0)


@query("features_wide", DEG + ", c AS (SELECT relation, app_id, CAST(sum(nd - 1) AS BIGINT) AS co FROM inc JOIN nd USING (relation, node) GROUP BY ALL) SELECT a.app_id, " + ", ".join(f"coalesce(max(co) FILTER (WHERE relation = '{r}'), 0)::DOUBLE AS co_{r}" for r in ("device", "account", "person", "dealer", "guarantor")) + " FROM apps a LEFT JOIN c USING (app_id) GROUP BY a.app_id")
def _(s, d):
    return _features(s, d).select("app_id", *[f"co_{r}" for r in ("device", "account", "person", "dealer", "guarantor")])


@query("features_ablated", DEG + ", c AS (SELECT relation, app_id, CAST(sum(nd - 1) AS BIGINT) AS co FROM inc JOIN nd USING (relation, node) GROUP BY ALL) SELECT a.app_id, " + ", ".join(f"coalesce(max(co) FILTER (WHERE relation = '{r}'), 0)::DOUBLE AS co_{r}" for r in ("account", "person", "dealer", "guarantor")) + " FROM apps a LEFT JOIN c USING (app_id) GROUP BY a.app_id")
def _(s, d):
    f = _features(s, d)
    return f.select("app_id", *graphfeatures.without_relation([c for c in f.columns if c.startswith("co_")], "device"))


@query("features_cleaned", "SELECT app_id, round(coalesce(CASE WHEN day % 7 <> 0 THEN amount / (day % 7) END, 0), 6) + 0 AS per_day FROM apps")
def _(s, d):
    a = applications(s, d).select("app_id", F.when(F.col("day") % 7 == 0, F.lit(float("inf"))).otherwise(F.try_divide("amount", F.col("day") % 7)).alias("per_day"))
    return graphfeatures.cleaned(a, ["per_day"]).select("app_id", r6("per_day").alias("per_day"))


@query("stream_burst_batch", ", w AS (SELECT user_id, ts, unnest(range(0, 2)) AS k FROM events), b AS (SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 7 DAY AS st FROM w) SELECT user_id, CAST(st AS TIMESTAMP) AS start, count(*) AS events FROM b GROUP BY ALL HAVING count(*) >= 5")
def _(s, d):
    from tessera.streaming.burst import burst_alerts

    return burst_alerts(s.read.parquet(f"{d}/events.parquet"))


@query("cohen_d", Y + ", f AS (SELECT app_id, unnest([{'feature': 'amount', 'v': amount}, {'feature': 'income', 'v': income}, {'feature': 'day', 'v': CAST(day AS DOUBLE)}], recursive := true) FROM apps) SELECT feature, round((avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0)) / (stddev_pop(v) + 1e-12), 6) + 0 AS d FROM f JOIN y USING (app_id) GROUP BY feature")
def _(s, d):
    a = applications(s, d).withColumn("y", F.when(F.col("ring") > 0, 1).otherwise(0))
    return evaluation.cohen_d(a, ["amount", "income", "day"]).select("feature", r6("d").alias("d"))


def _two_scores(s, d):
    a = applications(s, d).where("amount is not null")
    return a.select("app_id", F.expr("cast(floor(app_id / 25) as long) % 5").alias("fold"), F.when(F.col("ring") > 0, 1).otherwise(0).alias("y"), "score", F.col("amount").alias("other"))


_TWO = ", z AS (SELECT CAST(floor(app_id / 25.0) AS BIGINT) % 5 AS fold, CASE WHEN ring > 0 THEN 1 ELSE 0 END AS y, unnest([{'model': 'score', 'score': apps.score}, {'model': 'other', 'score': amount}], recursive := true) FROM apps WHERE amount IS NOT NULL), "


@query("paired_t", _TWO + APSQL.format(k="fold, model,", t="z", w="PARTITION BY fold, model") + ", ap AS (SELECT fold, model, sum(p * tp / upto) / sum(p) AS ap FROM r GROUP BY ALL), df AS (SELECT a.ap - b.ap AS d FROM ap a JOIN ap b ON a.fold = b.fold AND a.model = 'other' AND b.model = 'score') SELECT count(*) AS folds, round(avg(d), 6) + 0 AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) + 0 AS t FROM df")
def _(s, d):
    return evaluation.paired_t(_two_scores(s, d), "score", "other").select("folds", r6("mean").alias("mean"), r6("t").alias("t"))


@query("bootstrap_ci")
def _(s, d):
    return evaluation.bootstrap_interval(evaluation.bootstrap(_two_scores(s, d), ["score", "other"], replicates=200))


_LAPC = ("co_device", "co_account", "co_person")


@query("laplacian_quadratic", DEG + EDGES + ", c AS (SELECT relation, app_id, CAST(sum(nd - 1) AS BIGINT) AS co FROM inc JOIN nd USING (relation, node) GROUP BY ALL), x AS (SELECT a.app_id, " + ", ".join(f"coalesce(max(co) FILTER (WHERE relation = '{c[3:]}'), 0)::DOUBLE AS {c}" for c in _LAPC) + " FROM apps a LEFT JOIN c USING (app_id) GROUP BY a.app_id), q AS (SELECT weight, " + ", ".join(f"a.{c} - b.{c} AS {c}" for c in _LAPC) + " FROM ed JOIN x a ON a.app_id = src JOIN x b ON b.app_id = dst) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(weight * {a} * {b}), 4) + 0 AS v FROM q" for a in _LAPC for b in _LAPC))
def _(s, d):
    from tessera.operators.models import laplacian_quadratic

    m = laplacian_quadratic(_edges(s, d), _features(s, d), list(_LAPC))
    return s.createDataFrame([(a, b, round(float(m[i, j]), 4)) for i, a in enumerate(_LAPC) for j, b in enumerate(_LAPC)], "a string, b string, v double")


_MODEL_COLUMNS = ["amount", "income", "co_device", "co_account", "co_person"]


def _oof(kind, **params):
    def run(s, d):
        from tessera.operators.models import out_of_fold

        return out_of_fold(written(_features(s, d), "features"), _MODEL_COLUMNS, 3, kind, edges=written(_edges(s, d), "edges") if kind == "graph" else None, **params)

    return run


query("oof_gbt")(_oof("gbt", maxIter=20))
query("oof_forest")(_oof("forest"))
query("oof_graph_logistic")(_oof("graph"))


@query("nested_selection")
def _(s, d):
    from tessera.operators.models import nested

    return nested(written(_features(s, d), "features"), _MODEL_COLUMNS, 3, "logistic", [{"c": 0.01}, {"c": 1.0}])[0]


@query("typology_holdout")
def _(s, d):
    from tessera.operators.models import held_out_groups

    f = written(_features(s, d).withColumn("typology", F.when(F.col("ring") > 0, F.col("ring") % 4)), "features")
    return held_out_groups(f, _MODEL_COLUMNS, "typology")


@query("coldstart_draws")
def _(s, d):
    from tessera.operators.coldstart import evaluate

    return evaluate(_edges(s, d), _y(applications(s, d)))


@query("two_stage_spread")
def _(s, d):
    from tessera.operators.coldstart import two_stage

    return two_stage(written(_edges(s, d), "edges"), _y(applications(s, d)))


@query("component_folds")
def _(s, d):
    from tessera.operators.components import component_folds

    return component_folds(_edges(s, d), applications(s, d).select("app_id"), 5)[0]


@query("labelled_graph", EDGES + ", k AS (SELECT app_id, row_number() OVER (ORDER BY app_id) - 1 AS node, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS y FROM apps WHERE status <> 'P'), i AS (SELECT a.node AS s, b.node AS t FROM ed JOIN k a ON a.app_id = src JOIN k b ON b.app_id = dst), g AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM i UNION ALL SELECT t FROM i) GROUP BY node) SELECT app_id, node, y, coalesce(degree, 0) AS degree FROM k LEFT JOIN g USING (node)")
def _(s, d):
    from tessera.sources.graphfiles import labelled_graph

    nodes, edges = labelled_graph(applications(s, d).select("app_id", F.col("status").alias("label")), _edges(s, d), drop=("P",), positive=("F",))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node", "left").select("app_id", "node", "y", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("generated_portfolio")
def _(s, d):
    from tessera.sources.portfolio import generate

    t = generate(s)
    return t["applications"].join(t["application_labels"], "application_id")
