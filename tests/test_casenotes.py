"""Case notes, planted rings, two-stage spreading and JSON parts against plain Python."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import casenotes
from tessera.operators.coldstart import two_stage
from tessera.operators.injection import inject_rings


def _incidence(spark, rows):
    return spark.createDataFrame(rows, "relation string, app_id long, node string")


def test_neighbours_count_shared_partners_once(spark):
    rows = [("device", i, "hub") for i in range(20)] + [("guarantor", 1, "g"), ("guarantor", 2, "g"), ("guarantor", 1, "h"), ("guarantor", 2, "h"), ("guarantor", 3, "h"), ("device", 50, "alone")]
    got = {(r["relation"], r["app_id"]): (r["others"], r["sample"]) for r in casenotes.neighbours(_incidence(spark, rows)).collect()}
    assert got[("guarantor", 1)] == (2, [2, 3]) and got[("guarantor", 3)] == (2, [1, 2])
    assert got[("device", 0)] == (19, list(range(1, 13))) and got[("device", 19)] == (19, list(range(12)))
    assert ("device", 50) not in got
    assert casenotes.neighbours(_incidence(spark, [])).count() == 0


def test_neighbours_with_several_shared_nodes_are_not_listed_by_node(spark):
    rng = np.random.default_rng(8)
    rows = sorted({("guarantor", int(a), f"g{n}") for a in range(40) for n in rng.integers(0, 30, 1 + a % 6)} | {("guarantor", a, f"g{n}") for a in (41, 42) for n in range(25)} | {("device", a, f"d{a % 7}") for a in range(40)})
    of, on = {}, {}
    for r, a, n in rows:
        of.setdefault((r, a), set()).add(n)
        on.setdefault((r, n), set()).add(a)
    want = {(r, a): sorted(set().union(*(on[r, n] for n in ns)) - {a}) for (r, a), ns in of.items()}
    for few in (16, 3):
        got = casenotes.repeats(_incidence(spark, rows), few)
        assert {(x["relation"], x["app_id"]): x["again"] for x in got.collect()} == {k: g for k, v in want.items() if (g := sum(len(on[k[0], n]) - 1 for n in of[k]) - len(v))}
    got = {(x["relation"], x["app_id"]): (x["others"], x["sample"]) for x in casenotes.neighbours(_incidence(spark, rows)).collect()}
    assert got == {k: (len(v), v[:12]) for k, v in want.items() if v}


def test_notes_take_low_entropy_as_bad_and_leave_flat_features_out(spark):
    apps = spark.createDataFrame([(i,) for i in range(5)], "app_id long")
    v = [("co_device", i, float(i * i)) for i in range(1, 5)] + [("entropy_device", i, float(i)) for i in range(5)] + [("co_person", 0, 1.0), ("unknown", 0, 9.0)]
    got = {(r["app_id"], r["feature"]): r for r in casenotes.signal_notes(spark.createDataFrame(v, "feature string, app_id long, v double"), apps).collect()}
    assert set(got) == {(3, "co_device"), (4, "co_device"), (0, "entropy_device")}
    top = got[(4, "co_device")]
    assert (top["text"], top["portfolio_percentile"], top["place"]) == ("shares its device fingerprint with 16 other application(s)", 100.0, 1)
    assert got[(0, "entropy_device")]["portfolio_percentile"] == 20.0


def test_drawable_edges_leave_large_clusters_out(spark):
    member = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 10 + i) for i in range(5)] + [(3, 20), (3, 21)], "cluster long, app_id long")
    inc = _incidence(spark, [("device", i, "a") for i in range(3)] + [("account", 0, "b"), ("account", 1, "b")] + [("device", 10 + i, "c") for i in range(5)] + [("device", 20, "d"), ("device", 21, "d"), ("dealer", 0, "x"), ("dealer", 1, "x")])
    got = {tuple(r) for r in casenotes.drawable_edges(member, inc, ("device", "account"), high=4).collect()}
    assert got == {("device", 0, 1, 1), ("device", 0, 2, 1), ("device", 1, 2, 1), ("account", 0, 1, 1)}


def test_payload_keeps_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [2, 3])], "app_id long, sample array<long>")
    casenotes.write_payload({"notes": df}, f"file://{tmp_path}")
    lines = [x for f in Path(tmp_path, "notes").glob("part-*") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"app_id": 1, "sample": [2, 3]}]


@pytest.mark.parametrize("camouflage", [0.0, 0.5])
def test_planted_rings(spark, camouflage):
    edges = spark.createDataFrame([(i, j) for i in range(200) for j in range(i + 1, 200) if (i * 7 + j * 13) % (i + 5) == 0], "src long, dst long")
    vertices = spark.range(220).withColumnRenamed("id", "app_id")
    out, labels = inject_rings(edges, vertices, 4, low=5, high=9, camouflage=camouflage, seed=2)
    again = inject_rings(edges, vertices, 4, low=5, high=9, camouflage=camouflage, seed=2)[1]
    rows = {r["app_id"]: (r["y"], r["ring"]) for r in labels.collect()}
    assert rows == {r["app_id"]: (r["y"], r["ring"]) for r in again.collect()} and len(rows) == 220
    old, new = {(r.src, r.dst) for r in edges.collect()}, {(r.src, r.dst) for r in out.collect()}
    degree = {v: 0 for v in rows}
    for a, b in old:
        degree[a] += 1
        degree[b] += 1
    middle = np.median(list(degree.values()))
    sizes = {}
    for v, (y, g) in rows.items():
        assert (g > 0) == (y == 1) and (y == 0 or degree[v] >= middle)
        sizes[g] = sizes.get(g, 0) + (g > 0)
    assert set(sizes) == {0, 1, 2, 3, 4} and all(5 <= k <= 9 for g, k in sizes.items() if g)
    assert old <= new and all(a < b for a, b in new)
    inner = [(a, b) for a, b in new - old if rows[a][1] == rows[b][1] > 0]
    cover = [(a, b) for a, b in new - old if (rows[a][1] > 0) != (rows[b][1] > 0)]
    assert inner and len(inner) + len(cover) == len(new - old)
    assert len(cover) <= sum(k // 2 for k in sizes.values()) and bool(cover) == bool(camouflage)
    few = inject_rings(edges, vertices, 400, seed=2)[1]
    assert 0 < few.agg(F.max("ring")).first()[0] < 400


def test_two_stage_against_dense(spark):
    links = [(0, 1, 1), (1, 2, 2), (2, 3, 1), (4, 5, 1), (0, 6, 3), (7, 8, 1)]
    rows = [(i, int(i in (1, 2, 6)), 1.0 - 0.07 * ((i * 5) % 10)) for i in range(10)]
    got = two_stage(spark.createDataFrame(links, "src long, dst long, weight long"), spark.createDataFrame(rows, "app_id long, y int, score double"), shares=(0.2,), alphas=(0.5, 0.85), weights=(0.0, 1.0), iterations=12)
    got = {(r["alpha"], r["weight"]): (r["ap"], r["recall_at_5pct"]) for r in got.collect()}
    a, s, y = np.zeros((10, 10)), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for i, j, w in links:
        a[i, j] = a[j, i] = w
    seed = np.zeros(10)
    top = np.argsort(-s, kind="stable")[:2]
    seed[top] = s[top] / s[top].sum()
    out = np.maximum(a.sum(1), 1e-12)
    for alpha in (0.5, 0.85):
        r = seed.copy()
        for _ in range(12):
            r = alpha * (a.T @ (r / out)) + (1 - alpha) * seed
        for w in (0.0, 1.0):
            total = np.round(s / s.max() + w * r / r.max(), 12)
            ap = sum((total >= t).dot(y) / (total >= t).sum() * y[total == t].sum() for t in set(total)) / y.sum()
            first = sorted(range(10), key=lambda i: (-total[i], i))[0]
            assert got[(alpha, w)] == (pytest.approx(ap, abs=1e-9), pytest.approx(y[first] / 3))
