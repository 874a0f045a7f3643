"""Numbering, percentiles, names, models and scratch folders on small inputs."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import evaluation
from tessera.operators import graphfeatures, linkage, models, rings
from tessera.sources import workdir
from tessera.streaming.burst import burst_alerts


def test_numbered_and_percentiles(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), float(rng.randrange(40))) for i in range(500)]
    df = spark.createDataFrame(rows, "app_id long, k int, score double")
    got = {r["app_id"]: r["place"] for r in evaluation.numbered(df, [F.desc("score"), F.asc("app_id")], parts=7).collect()}
    assert got == {i: n for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    got = {r["app_id"]: r["place"] for r in evaluation.numbered(df, [F.asc("score"), F.asc("app_id")], ["k"], parts=7).collect()}
    for k in range(5):
        assert [got[i] for i, _, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))] == list(range(1, sum(r[1] == k for r in rows) + 1))
    p = evaluation.percentiles(df, "score", [0.05, 0.5, 0.95]).first()
    assert list(p) == pytest.approx(np.percentile([r[2] for r in rows], [5, 50, 95]))
    per = {r["k"]: r["p0"] for r in evaluation.percentiles(df, "score", [0.9], ["k"]).collect()}
    assert per == pytest.approx({k: np.percentile([r[2] for r in rows if r[1] == k], 90) for k in range(5)})
    assert evaluation.numbered(df.limit(0), [F.asc("app_id")]).count() == 0


def test_jaro_floors_transpositions():
    assert linkage.jaro("cefebcafa", "cfbcfeeaa") == pytest.approx(0.8426, abs=1e-4)
    assert linkage.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4) and linkage.jaro("", "a") == 0.0


def test_resolution_keeps_first_and_counts_humans(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "id long, cluster long")
    mapping = linkage.resolved_ids(clusters)
    assert {r["id"]: r["resolved"] for r in mapping.collect()} == {1: "rp_1", 2: "rp_1", 3: "3", 4: "rp_4", 5: "rp_4"}
    apps = spark.createDataFrame([(10, 2), (11, 3), (12, None), (13, 99)], "app_id long, person long")
    assert {r["app_id"]: r["person"] for r in linkage.rewritten(apps, "person", mapping).collect()} == {10: "rp_1", 11: "3", 12: None, 13: "99"}
    persons = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "e")], "id long, name string")
    assert {tuple(r) for r in linkage.collapsed(persons, "id", mapping, "id").collect()} == {("rp_1", "a"), ("3", None), ("rp_4", "d")}
    truth = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id long, human string")
    assert tuple(linkage.merge_diagnostics(mapping, truth).first()) == (2, 1, 1, 2)


def test_rings_are_judged_by_one_ring(spark):
    scored = spark.createDataFrame([(1, 4, 0.9), (2, 3, 0.6), (3, 5, 0.2)], "cluster long, n long, ring_score double")
    member = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(4, 7)] + [(3, i) for i in range(7, 12)], "cluster long, app_id long")
    apps = spark.createDataFrame([(i, 1 if i < 3 else 2 if i in (4, 5) else 3 if i == 6 else -1) for i in range(12)], "app_id long, ring long")
    j = rings.judged(scored, member, apps)
    assert {(r["cluster"], r["n_fraud"], r["is_true"]) for r in j.collect()} == {(1, 3, True), (2, 3, False), (3, 0, False)}
    total = apps.where("ring > 0").agg(F.count("*").alias("total"))
    assert [(r["k"], r["apps_reviewed"], r["fraud_caught"], r["precision_clusters"]) for r in rings.budget(j, total).orderBy("k").collect()] == [(1, 4, 3, 1.0), (2, 7, 6, 0.5), (3, 12, 6, pytest.approx(1 / 3))]
    t = rings.at_threshold(j, total).first()
    assert (t["flagged"], t["true_flagged"], t["ring_recall"], t["precision"], t["fp_median_apps"]) == (2, 1, 1.0, 0.5, 3.0)


def test_pagerank_settles(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 5)], "src long, dst long, weight long")
    vertices = spark.createDataFrame([(i,) for i in range(1, 6)], "app_id long")
    got = {r["app_id"]: r["rank"] for r in graphfeatures.pagerank(edges, vertices, 50, tol=1e-10).collect()}
    a = np.zeros((5, 5))
    for s, d in ((0, 1), (1, 2), (0, 2)):
        a[s, d] = a[d, s] = 1
    r, deg = np.full(5, 0.2), a.sum(axis=1)
    for _ in range(200):
        r = 0.85 * (a @ np.divide(r, deg, where=deg > 0, out=np.zeros(5))) + 0.15 / 5 + 0.85 * r[deg == 0].sum() / 5
    assert [got[i] for i in range(1, 6)] == pytest.approx(list(r), abs=1e-8)
    central = {r["app_id"]: r["centrality"] for r in graphfeatures.rank_normalised(spark.createDataFrame(list(got.items()), "app_id long, rank double")).collect()}
    assert central == pytest.approx({1: 1.0, 2: 0.75, 3: 0.5, 4: 0.25, 5: 0.0})


def test_features_cleaned_and_ablated(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, None), (4, -2.0), (5, float("-inf"))], "app_id long, x double")
    assert [r["x"] for r in graphfeatures.cleaned(df, ["x"]).orderBy("app_id").collect()] == [0.0, 0.0, 0.0, -2.0, 0.0]
    assert graphfeatures.without_relation(["co_device", "device_deg", "co_account", "amount"], "device") == ["co_account", "amount"]


def test_held_out_groups_score_the_unseen_type(spark):
    rng = random.Random(2)
    rows = [(i, 1.0 if i % 3 == 0 else 0.0, (i // 3) % 2 if i % 3 == 0 else None, i % 3, float(i % 3 == 0) + rng.random() / 2, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "app_id long, y double, typology int, fold int, a double, b double")
    out = models.held_out_groups(df, ["a", "b"], "typology").collect()
    assert len(out) == 2 and {r["typology"] if "typology" in r.asDict() else r[0] for r in out} == {0, 1}


def test_streamed_bursts_match_the_batch(spark, tmp_path):
    rows = [(u, f"2024-01-{d:02d} 0{u}:00:00") for u in (1, 2) for d in range(1, 29, u)]
    events = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    want = {tuple(r) for r in burst_alerts(spark.read.parquet(f"{tmp_path}/events")).collect()}
    stream = burst_alerts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("bursts").collect()} == want and want


def test_scratch_tables_can_be_swept(spark):
    before = set(workdir._live)
    kept = workdir.written(spark.range(3).toDF("a"), "kept")
    with workdir.swept(spark) as keep:
        lost = workdir.written(spark.range(4).toDF("a"), "lost")
        out = workdir.written(lost, "out")
        keep.add(out)
    assert kept.count() == 3 and out.count() == 4 and lost._scratch not in workdir._live
    again = workdir.written(out, "again", drops=(out,))
    assert again.count() == 4 and out._scratch not in workdir._live
    workdir.removed(spark, again._scratch)
    workdir.removed(spark, kept._scratch)
    assert set(workdir._live) == before
    assert workdir.unused(spark.range(1).toDF("Salt"), "salt") == "salt_"


def test_sweeping_spares_other_threads_and_settings_return(spark):
    other, before = [], [spark.conf.get(k, None) for k in (workdir.CLEANUP, workdir.ARROW_ROWS)]
    with workdir.swept(spark):
        thread = threading.Thread(target=lambda: other.append(workdir.written(spark.range(3), "other")))
        thread.start()
        thread.join()
        mine = workdir.written(spark.range(3), "mine")
        with workdir._cleaning(spark):
            assert int(spark.conf.get(workdir.ARROW_ROWS)) == workdir.BATCH_ROWS
    assert other[0].count() == 3
    assert mine._scratch not in workdir._live
    assert [spark.conf.get(k, None) for k in (workdir.CLEANUP, workdir.ARROW_ROWS)] == before
    workdir.removed(spark, other[0]._scratch)
