"""The replay of all snapshots at once against one snapshot at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphfeatures, leadtime, rings
from tessera.operators.components import connected_components

RELATIONS = ("device", "account", "person")


def test_replay_matches_single_snapshots(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(60), rng.random(), 1 + i % 3 if i % 5 == 0 else -1) for i in range(90)]
    apps = spark.createDataFrame(rows, "app_id long, day long, score double, ring long")
    links = {(r, i, f"{r}{rng.randrange(45)}") for i in range(90) for r in RELATIONS} | {("guarantor", i, f"g{rng.randrange(20)}") for i in range(90)}
    inc = spark.createDataFrame(sorted(links), "relation string, app_id long, node string")
    edges, days = graphfeatures.pair_edges(inc, RELATIONS), [10, 25, 59]
    found = leadtime.replay(apps, inc, edges, RELATIONS, days, min_members=2)
    got = {(r["snap"], r["cluster"] & ((1 << leadtime.SHIFT) - 1), r["ring"]): (r["n"], r["ring_score"], r["members"]) for r in found.collect()}
    want, ring_of = {}, {i: g for i, _, _, g in rows}
    for day in days:
        now = apps.where(F.col("day") <= day)
        here = inc.join(now.select("app_id"), "app_id", "left_semi").select("relation", "app_id", "node")
        comp = connected_components(graphfeatures.star_edges(here, RELATIONS), "a", "b")
        member = now.select("app_id").join(comp, F.col("app_id") == F.col("node"), "left").select(F.coalesce("component", "app_id").alias("cluster"), "app_id")
        scores = rings.ring_scores(member, now, here, graphfeatures.pair_edges(here, RELATIONS)).collect()
        of = {}
        for r in member.collect():
            of.setdefault(r["cluster"], []).append(r["app_id"])
        for r in scores:
            counts = {}
            for i in of[r["cluster"]]:
                if ring_of[i] > 0:
                    counts[ring_of[i]] = counts.get(ring_of[i], 0) + 1
            if not counts:
                want[day, r["cluster"], None] = (r["n"], pytest.approx(r["ring_score"]), None)
            for g, k in counts.items():
                if k >= 2:
                    want[day, r["cluster"], g] = (r["n"], pytest.approx(r["ring_score"]), k)
    assert got == want and len(want) > 4


def test_sweep_and_choice(spark):
    found = spark.createDataFrame([(10, 5, 4, 0.9, 1, 3), (20, 5, 6, 0.6, 1, 3), (10, 7, 3, 0.7, None, None), (20, (1 << leadtime.SHIFT) + 7, 3, 0.7, None, None), (20, 9, 8, 0.8, 2, 4)], "snap long, cluster long, n long, ring_score double, ring long, members long")
    apps = spark.createDataFrame([(1, 5, 1), (2, 30, 1), (3, 20, 2), (4, 4, 3), (5, 9, -1)], "app_id long, day long, ring long")
    t = {(r["threshold"], r["min_size"]): r for r in leadtime.sweep(found, apps, 8, (0.5, 0.65, 0.85), (3, 5)).collect()}
    assert (t[0.5, 3]["detected"], t[0.5, 3]["before_completion"], t[0.5, 3]["median_lead"], t[0.5, 3]["false_clusters"]) == (2, 1, 20.0, 1)
    assert t[0.5, 5]["median_lead"] == 10.0 and t[0.65, 5]["detected"] == 1 and t[0.85, 5]["detected"] == 0 and t[0.85, 5]["evaluable"] == 2
    best = leadtime.chosen(leadtime.sweep(found, apps, 8, (0.5, 0.65, 0.85), (3, 5))).first()
    assert (best["threshold"], best["min_size"], best["viable"]) == (0.85, 3, True)


def test_histories_match_components_at_every_place(spark):
    rng, n, places = random.Random(5), 70, 45
    present = [(i, rng.randrange(places)) for i in range(n)]
    at, links = dict(present), sorted({("device", rng.randrange(n), f"d{rng.randrange(55)}") for _ in range(95)})
    rows = leadtime.memberships(spark.createDataFrame(present, "app_id long, place long"), spark.createDataFrame(links, "relation string, app_id long, node string"), ["device"], places, 1).collect()
    got = {(t, r["app_id"]): r["cluster"] for r in rows for t in range(r["start"], r["end"])}
    assert len(got) == sum(r["end"] - r["start"] for r in rows) == sum(places - p for _, p in present)
    biggest = 0
    for t in range(places):
        name = {i: i for i, p in present if p <= t}
        for _ in range(n):
            low = {}
            for _, i, node in links:
                if i in name:
                    low[node] = min(low.get(node, n), name[i])
            for _, i, node in links:
                if i in name:
                    name[i] = min(name[i], low[node])
        assert {i: got[t, i] for i in name} == name
        biggest = max(biggest, max(sum(1 for x in name.values() if x == c) for c in set(name.values())))
    assert biggest > 30


def test_replay_keeps_no_application_by_snapshot(spark, monkeypatch):
    sizes, plain = {}, leadtime.written

    def counted(df, name, *rest, **more):
        out = plain(df, name, *rest, **more)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(leadtime, "written", counted)
    n, days = 600, list(range(0, 300, 3))
    apps = spark.range(n).selectExpr("id as app_id", "id % 300 as day", "(id * 37 % 601) / 601D as score", "cast(-1 as bigint) as ring")
    inc = spark.range(n).selectExpr("'device' as relation", "id as app_id", "cast(id div 2 as string) as node").union(spark.range(4).selectExpr("'account'", "id", "'a'"))
    found = leadtime.replay(apps, inc, graphfeatures.pair_edges(inc, RELATIONS), RELATIONS, days)
    assert found.agg(F.max("n")).first()[0] == 4 and found.count() == 99  # from day 3 on, three applications or four
    assert max(sizes.values()) <= 2 * n, sizes


def test_replay_of_nothing(spark):
    apps = spark.createDataFrame([], "app_id long, day long, score double, ring long")
    inc = spark.createDataFrame([], "relation string, app_id long, node string")
    assert leadtime.replay(apps, inc, graphfeatures.pair_edges(inc, RELATIONS), RELATIONS, [0, 7]).count() == 0
