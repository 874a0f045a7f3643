"""Hand-computed fixtures of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import evaluation
from tessera.functions.evaluation import average_precision, group_folds, roc_auc, running
from tessera.operators import coldstart, graphfeatures, linkage, models, rings
from tessera.operators.components import component_folds, connected_components
from tessera.sources import graphfiles, portfolio

APPS = [("a1", "p1", "d1", "c1", "L1", 0, 100.0, 0.9), ("a2", "p2", "d1", "c2", "L1", 5, 200.0, 0.8), ("a3", "p3", "d1", "c3", "L1", 20, 300.0, 0.2), ("a4", "p4", "d2", "c3", "L1", 25, 400.0, 0.7), ("a5", "p5", "d3", "c4", "L2", 100, 500.0, 0.1), ("a6", "p5", "d4", "c5", "L2", 101, 600.0, 0.3)]
LINKS = [("a1", "g1"), ("a4", "g1"), ("a1", "g2")]


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame([(a, p, day, amount, s) for a, p, _, _, _, day, amount, s in APPS], "app_id string, cust string, day long, amount double, score double")


@pytest.fixture(scope="module")
def inc(spark):
    rows = [(r, a[0], a[i]) for a in APPS for r, i in (("person", 1), ("device", 2), ("account", 3), ("dealer", 4))] + [("guarantor", a, g) for a, g in LINKS]
    return spark.createDataFrame(rows, "relation string, app_id string, node string")


def by(df, rel, col):
    got = {r["app_id"]: r[col] for r in df.where(f"relation = '{rel}'").collect()}
    return [got.get(f"a{i}", 0) for i in range(1, 7)]


def test_degrees(inc):
    d = graphfeatures.degrees(inc)
    assert by(d, "device", "co") == [2, 2, 2, 0, 0, 0]
    assert by(d, "dealer", "co") == [3, 3, 3, 3, 1, 1]
    assert by(d, "guarantor", "deg") == [2, 0, 0, 1, 0, 0]
    assert by(d, "guarantor", "node_deg") == [1.5, 0, 0, 2, 0, 0]


def test_bursts_and_entropy(inc, apps):
    b = graphfeatures.bursts(inc, apps)
    assert by(b, "device", "burst_7d") == [1, 1, 0, 0, 0, 0]
    assert by(b, "guarantor", "burst_30d") == [1, 0, 0, 1, 0, 0]
    e = by(graphfeatures.entropies(inc, apps), "device", "entropy")
    assert e == pytest.approx([1.098612] * 3 + [0, 0, 0], abs=1e-5)


def test_neighbour_stats(inc, apps):
    n = graphfeatures.neighbour_stats(inc, apps, "amount")
    assert by(n, "device", "nbr_mean") == pytest.approx([250, 200, 150, 0, 0, 0])
    assert by(n, "device", "nbr_std") == pytest.approx([50, 100, 50, 0, 0, 0])
    assert by(n, "device", "nbr_diff") == pytest.approx([-150, 0, 150, 0, 0, 0])


def test_ring_score(spark, inc, apps):
    rel = ("device", "account", "person", "guarantor")
    edges = graphfeatures.pair_edges(inc, rel)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a3", "a4"), ("a5", "a6")}
    comp = connected_components(graphfeatures.star_edges(inc, rel), "a", "b")
    assert {(r["node"], r["component"]) for r in comp.collect()} == {("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("a4", "a1"), ("a5", "a5"), ("a6", "a5")}
    row = rings.ring_scores(comp.withColumnsRenamed({"component": "cluster", "node": "app_id"}), apps, inc, edges).first()
    assert row["ring_score"] == pytest.approx(0.279583, abs=1e-6)
    assert (row["density"], row["dominant_axis"]) == (pytest.approx(0.833333, abs=1e-6), "device")


def test_metrics(spark):
    ap = lambda rows: average_precision(spark.createDataFrame(rows, "y int, score double")).first()["ap"]
    assert ap(list(zip([1, 1, 0, 1, 0, 0], [0.9, 0.5, 0.5, 0.5, 0.1, 0.3], strict=True))) == pytest.approx(0.833333, abs=1e-6)
    assert ap([(1, 0.5), (0, 0.5)]) == 0.5
    auc = roc_auc(spark.createDataFrame(list(zip([1, 1, 0, 1, 0, 0], [0.9, 0.5, 0.5, 0.5, 0.1, 0.3], strict=True)), "y int, score double")).first()["auc"]
    assert auc == pytest.approx(0.888889, abs=1e-6)


def test_folds_keep_groups_and_balance(spark):
    rows = [(i, g) for g, n in enumerate([7, 5, 5, 3, 1, 1, 1, 1]) for i in range(n)]
    f = group_folds(spark.createDataFrame(rows, "id int, group int"), 3).collect()
    assert sorted(r["group"] for r in f) == list(range(8))
    size = dict(enumerate([7, 5, 5, 3, 1, 1, 1, 1]))
    load = [sum(size[r["group"]] for r in f if r["fold"] == k) for k in range(3)]
    assert max(load) - min(load) <= 1


def test_linkage_functions():
    assert linkage.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert linkage.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert linkage.jaro("Arunkumar", "Arun") == pytest.approx(0.814815, abs=1e-6)
    assert linkage.pava_decreasing([0.5, 0.1, 0.3, 0.1]) == pytest.approx([0.5, 0.2, 0.2, 0.1])
    assert linkage.link_threshold(0.072, 0.99, "reference") == pytest.approx(2.038754, abs=1e-5)
    assert linkage.link_threshold(0.072, 0.99) == pytest.approx(7.151485, abs=1e-5)


def test_components_chain_and_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}


def test_entry_imports():
    import __spark_entry__ as e

    assert "ring_score" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_guards_and_split(spark, tmp_path):
    from tessera.sources.guards import validate_at_application, validate_observable, write_split

    df = spark.createDataFrame([(1, 2.0, 5), (2, 3.0, -1)], "app_id long, amount double, ring_id long")
    with pytest.raises(ValueError):
        validate_observable(df)
    with pytest.raises(ValueError):
        validate_at_application(spark.createDataFrame([(1, 2)], "app_id long, max_dpd long"))
    write_split(df, ["ring_id"], "app_id", str(tmp_path), "apps")
    assert validate_observable(spark.read.parquet(f"{tmp_path}/raw/apps.parquet")).count() == 2
    assert spark.read.parquet(f"{tmp_path}/labels/apps.parquet").columns == ["app_id", "ring_id"]


def step_ap(y, score):
    """Average precision of few rows, ties as one step."""
    got, tp, at, total = 0.0, 0, 0, sum(y)
    for v in sorted(set(score), reverse=True):
        p = sum(a for a, b in zip(y, score, strict=True) if b == v)
        tp, at = tp + p, at + score.count(v)
        got += p * tp / at
    return got / total


def test_running_sums_over_many_ranges(spark):
    rows = [(k, float(v), (v * 7 + k) % 5) for k in (0, 1) for v in range(600)] + [(0, None, 3)]
    df = spark.createDataFrame(rows, "k int, v double, c long")
    for down in (False, True):
        got = {(r["k"], r["v"]): r["run_c"] for r in running(df, ["k"], "v", ["c"], descending=down).collect()}
        for k in (0, 1):
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: -1.0 if r[1] is None else r[1], reverse=down)
            total = 0
            for _, v, c in mine:
                total += c
                assert got[k, v] == total
    assert running(df.where("v > 1000"), ["k"], "v", ["c"]).count() == 0
    assert average_precision(df.where("k > 5").select(F.col("c").alias("y"), F.col("v").alias("score"))).first()["ap"] is None


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.2).astype(int)
    rows = [(i, int(v), float(round(v + rng.normal(), 1)), float(rng.integers(0, 4))) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "app_id long, y int, good double, poor double")
    draws = evaluation.bootstrap(df, ["good", "poor"], replicates=150)
    ci = {r["model"]: r for r in evaluation.bootstrap_interval(draws).collect()}
    ap = []
    for _ in range(150):
        pick = rng.integers(0, 300, 300)
        ap.append(step_ap([rows[i][1] for i in pick], [rows[i][2] for i in pick]))
    assert ci["good"]["replicates"] == 150
    assert ci["good"]["mean"] == pytest.approx(np.mean(ap), abs=0.03)
    assert ci["good"]["high"] - ci["good"]["low"] == pytest.approx(np.percentile(ap, 97.5) - np.percentile(ap, 2.5), rel=0.35)
    gain = evaluation.better_share(draws, "poor", "good").first()
    assert gain["share_better"] > 0.9 and gain["mean"] > 0


def test_bootstrap_multiplies_no_rows_and_matches_its_draws(spark, monkeypatch):
    replicates, seed = 7, 3
    rows = [(i * 7919 - 400, int(i % 5 == 0), float(i % 11) if i % 13 else None, float("nan") if i % 17 == 0 else i / 3 - 40) for i in range(400)]
    df = spark.createDataFrame(rows, "app_id long, y int, good double, poor double")
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", "app_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = {(r["replicate"], r["app_id"]): r["u"] for r in df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("replicate", "app_id", u.alias("u")).collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    want = {}
    for b in range(replicates):
        for c, name in ((2, "good"), (3, "poor")):
            groups = {}
            for r in rows:
                k = int((drawn[b, r[0]] >= steps).sum())
                rank = (-2, 0) if r[c] is None else (0, 0) if math.isnan(r[c]) else (-1, r[c])
                g = groups.setdefault(rank, [0, 0])
                g[0] += k * r[1]
                g[1] += k
            p = n = area = 0
            for rank in sorted(groups, reverse=True):
                p, n = p + groups[rank][0], n + groups[rank][1]
                area += groups[rank][0] * p / n if n else 0
            want[b, name] = area / p
    for cells in (evaluation.CELLS, 21):
        monkeypatch.setattr(evaluation, "CELLS", cells)
        got = evaluation.bootstrap(df, ["good", "poor"], replicates=replicates, seed=seed)
        assert {(r["replicate"], r["model"]): r["ap"] for r in got.collect()} == pytest.approx(want)
        assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert evaluation.bootstrap(df.where("app_id is null"), ["good"], replicates=3).count() == 0


def test_graph_logistic_equals_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + rng.normal(size=60) > 0.8).astype(float)
    pairs = [(i, (i * 7 + 1) % 60, 1 + i % 3) for i in range(60) if i != (i * 7 + 1) % 60]
    rows = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(60)], "app_id long, y double, u double, v double")
    edges = spark.createDataFrame([*pairs, (0, 999, 1)], "src long, dst long, weight long")
    m = sum(w * np.outer(x[i] - x[j], x[i] - x[j]) for i, j, w in pairs)
    assert np.allclose(models.laplacian_quadratic(edges, rows, ["u", "v"]), m)
    w = models.graph_logistic(rows, ["u", "v"], edges, lam=0.5)
    p = 1 / (1 + np.exp(-x @ w))
    r = np.where(y == 1, 30 / y.sum(), 30 / (60 - y.sum()))
    assert np.allclose(x.T @ (r * (p - y)) + 0.5 * m @ w, 0, atol=1e-4)


def test_models_under_folds(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 2), float(i % 2) + (i % 7) / 10, 1.0) for i in range(60)], "app_id long, fold int, y double, a double, b double")
    edges = spark.createDataFrame([(i, i + 2, 1) for i in range(58)], "src long, dst long, weight long")
    for kind, extra in (("logistic", {}), ("graph", {}), ("forest", {}), ("gbt", {"maxIter": 3})):
        got = models.out_of_fold(rows, ["a", "b"], 3, kind, edges=edges, **extra)
        assert got.count() == 60
        assert average_precision(got).first()["ap"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        models.out_of_fold(rows, ["a"], 3, "none")
    got, picked = models.nested(rows, ["a", "b"], 3, "logistic", [{"c": 1.0}, {"c": 0.5}])
    assert got.count() == 60 and picked == [{"c": 1.0}] * 3
    one_class = models.out_of_fold(rows.withColumn("y", F.lit(0.0)), ["a", "b"], 3)
    assert {r["score"] for r in one_class.collect()} == {0.0}


def test_coldstart_matches_dense_iteration(spark):
    pairs = [(0, 1, 2), (1, 2, 1), (2, 3, 1), (4, 5, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight long")
    seeds = spark.createDataFrame([(0, 0), (0, 4), (1, 2)], "draw int, app_id long")
    a = np.zeros((6, 6))
    for i, j, w in pairs:
        a[i, j] = a[j, i] = w
    got = {(r["draw"], r["app_id"]): r["rank"] for r in coldstart.spread(edges, seeds, iterations=12, cut=5).collect()}
    for draw, at in ((0, [0, 4]), (1, [2])):
        s = np.zeros(6)
        s[at] = 1 / len(at)
        r = s.copy()
        for _ in range(12):
            r = 0.85 * a.T @ (r / a.sum(1)) + 0.15 * s
        assert [got.get((draw, i), 0.0) for i in range(6)] == pytest.approx(list(r), abs=1e-12)
    labelled = spark.createDataFrame([(i, int(i in (0, 1, 3))) for i in range(6)], "app_id long, y int")
    out = coldstart.evaluate(edges, labelled, counts=(1, 2), repeats=4, iterations=5).collect()
    assert {r["k"]: r["draws"] for r in out} == {1: 4, 2: 4}


def test_component_folds(spark):
    v = spark.range(10).select(F.col("id").alias("app_id"))
    small = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    folds, giant = component_folds(small, v, 2)
    got = {r["app_id"]: r["fold"] for r in folds.collect()}
    assert not giant and len(got) == 10 and got[0] == got[1] and got[2] == got[3]
    folds, giant = component_folds(spark.createDataFrame([(0, i) for i in range(1, 8)], "src long, dst long"), v, 2)
    assert giant and folds.count() == 10


def test_graph_files(spark, tmp_path):
    np.savez(tmp_path / "g.npz", edge_index=np.array([[0, 1, 2, 2, 3], [1, 0, 2, 3, 4]]), y=np.array([1, 2, 0, 1, 1]))
    edges = graphfiles.npz_edges(spark, str(tmp_path / "g.npz"), rows=2)
    assert {tuple(r) for r in graphfiles.simple_edges(edges, edges).collect()} == {(0, 1, 1), (2, 3, 1), (3, 4, 1)}
    nodes, kept = graphfiles.labelled_graph(graphfiles.npz_labels(spark, str(tmp_path / "g.npz")), edges)
    assert {tuple(r) for r in nodes.collect()} == {(0, 0, 1), (1, 1, 0), (3, 2, 1), (4, 3, 1)}
    assert {tuple(r) for r in kept.collect()} == {(0, 1, 1), (2, 3, 1)}


def test_portfolio(spark, tmp_path):
    p = portfolio.Profile(persons=3000, dealers=120)
    t = {k: v.cache() for k, v in portfolio.generate(spark, p).items()}
    apps, labels = t["applications"], t["application_labels"]
    n = apps.count()
    assert apps.select("application_id").distinct().count() == n == labels.count()
    bad = labels.where("ring_id > 0").count() / n
    assert 0.01 < bad < 0.07
    for child, key, parent, other in (("applications", "person_id", "persons", "person_id"), ("applications", "device_id", "devices", "device_id"), ("applications", "account_id", "accounts", "account_id"), ("applications", "dealer_id", "dealers", "dealer_id"), ("guarantor_links", "guarantor_person_id", "persons", "person_id"), ("emi_schedule", "application_id", "applications", "application_id")):
        assert t[child].select(F.col(key).alias("k")).join(t[parent].select(F.col(other).alias("k")), "k", "left_anti").count() == 0, child
    assert t["persons"].select("person_id").distinct().count() == t["persons"].count() == t["person_identity_truth"].count()
    sizes = [r[0] for r in t["persons"].where("household_id >= 0 and not endswith(person_id, 'b')").groupBy("household_id").count().select("count").collect()]
    assert min(sizes) == 1 and max(sizes) == 5
    share = apps.where("product = 'two_wheeler'").count() / n
    assert abs(share - 0.46) < 0.05
    kiosk = apps.where(F.col("device_id").startswith("kio")).count() / n
    assert abs(kiosk - 0.14) < 0.04
    self_links = t["guarantor_links"].join(apps, "application_id").where("guarantor_person_id = person_id").count()
    assert self_links == 0
    miss = {r["bad"]: r["m"] for r in t["emi_schedule"].join(labels, "application_id").groupBy((F.col("ring_id") > 0).alias("bad")).agg(F.avg("missed").alias("m")).collect()}
    assert miss[True] > 2 * miss[False] > 0
    again = portfolio.generate(spark, p)["applications"]
    assert again.exceptAll(apps).count() == 0
    with pytest.raises(ValueError):
        portfolio.generate(spark, portfolio.Profile(typologies=("none",)))


def test_block_above_2000_rows_keeps_all_pairs(spark):
    from tessera.operators.linkage import block_pairs

    rec = spark.range(2105).select("id", F.lit("k").alias("key"), (F.col("id") % 900).cast("string").alias("other"))
    keys = [F.col("key"), F.col("other")]
    assert block_pairs(rec, keys).count() == 2105 * 2104 // 2
    assert block_pairs(rec, keys, block=100).count() == 2105 * 2104 // 2
    assert block_pairs(rec, keys[:1], cap=50).count() == 50 * 49 // 2
