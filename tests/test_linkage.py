"""Linkage by units against one pair at a time."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import linkage

# Copies, an id with two different rows and one with two equal rows, missing parts, a null id.
ROWS = [
    (1, "anna", "rao", "x", "k1", "p"), (2, "anna", "rao", "x", "k1", "p"), (3, "anna", "rao", "x", "k1", "p"), (4, "ana", "rao", "y", "k1", "q"),
    (5, "ana", "roy", "y", "k2", "p"), (5, "hanna", "rao", None, "k3", "q"), (6, "", "rao", "x", "k3", None), (7, None, "rao", "x", "k3", "q"), (7, None, "rao", "x", "k3", "q"),
    (8, "cefebcafa", "rao", "x", "k4", "z"), (9, "cfbcfeeaa", "rao", "x", "k4", "z"), (10, "cefebcafa", "rao", "x", "k4", "z"), (11, "cfbcfeeaa", "rao", "x", "k4", "z"),
    (12, "solo", "solo", "x", None, None), (None, "anna", "rao", "x", "k1", "p"), (13, "anna", "rao", "x", None, "p"),
]
KEYS = ["one", "two"]


def rec_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, first string, last string, size string, one string, two string")


def keys():
    return [F.concat(F.lit("1|"), "one"), F.concat(F.lit("2|"), "two")]


def slow_pairs():
    of = {}
    for r in ROWS:
        of.setdefault(r[0], set()).update((i, v) for i, v in enumerate(r[4:]) if v is not None)
    return {(a, b) for a in of for b in of if a is not None and b is not None and a < b and of[a] & of[b]}


def steps_over_join(df):
    """Names of the plan's steps above the join that makes the pairs."""
    node, names = df._jdf.queryExecution().optimizedPlan(), []
    while node.nodeName() != "Join":
        names.append(node.nodeName())
        node = node.children().head()
    return names


def test_block_pairs_come_once_without_a_shuffle_of_pairs(spark):
    for block in (2000, 2):
        got = linkage.block_pairs(rec_of(spark), keys(), block=block)
        assert Counter(map(tuple, got.collect())) == Counter(slow_pairs())
        assert "Aggregate" not in steps_over_join(got)


def test_units_of_many_copies_are_dealt_in_shares(spark):
    unit = linkage.units(rec_of(spark), keys(), share=1)
    assert Counter(map(tuple, linkage.expanded(linkage.unit_pairs(unit)).collect())) == Counter(slow_pairs())


def test_part_without_a_blocking_part_has_no_key(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    rows = [(1, "red bolt", None, "LARGE", 1), (2, "blue gear", None, "LARGE", 2), (3, "red bolt", "B", "LARGE", 3), (4, "old gear", "B", "LARGE", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["er_block_pairs"](spark, str(tmp_path)).collect()] == [(3, 4)]


def slow_levels(names=("first", "last"), exact=("size",)):
    rows = [dict(zip(("id", "first", "last", "size"), r, strict=False)) for r in ROWS]

    def level(x, y):
        if x is None or y is None:
            return 3
        jw = linkage.jaro_winkler(x, y)
        return 0 if x == y else 1 if jw >= 0.90 else 2 if jw >= 0.78 else 3

    return [(a, b, *[level(x[c], y[c]) for c in names], *[int(x[c] is None or x[c] != y[c]) for c in exact]) for a, b in slow_pairs() for x in rows for y in rows if x["id"] == a and y["id"] == b]


def test_levels_match_pair_by_pair(spark, monkeypatch):
    words = [x for r in ROWS for x in r[1:3] if x]
    assert all(linkage.jaro_winkler(x, y) == linkage.jaro_winkler(y, x) for x in words for y in words)
    unit = linkage.units(rec_of(spark), keys(), ["first", "last", "size"])
    for most in (linkage.WORD_PAIRS, 0):
        monkeypatch.setattr(linkage, "WORD_PAIRS", most)
        got = linkage.expanded(linkage.levels(unit, ["first", "last"], ["size"]))
        assert Counter(map(tuple, got.collect())) == Counter(slow_levels())
        assert "Aggregate" not in steps_over_join(got)


def test_pattern_counts_need_no_pairs_of_ids(spark):
    for share in (500, 1):
        unit = linkage.units(rec_of(spark), keys(), ["first", "last", "size"], share=share)
        got = linkage.pattern_counts(linkage.levels(unit, ["first", "last"], ["size"]))
        assert {tuple(r[:-1]): r["n"] for r in got.collect()} == Counter(r[2:] for r in slow_levels())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(ids" not in plan and "sequence(1" not in plan


def test_link_edges_join_what_the_links_join(spark):
    from tessera.operators.components import connected_components

    fields, sizes = ["first", "last", "size"], [4, 4, 2]
    for share in (500, 1):
        unit = linkage.units(rec_of(spark), keys(), fields, share=share)
        links = linkage.link(linkage.levels(unit, fields[:2], fields[2:]), fields, sizes, min_posterior=0.5)
        pairs = linkage.expanded(links)
        assert pairs.count() > 0 and pairs.where("llr is null").count() == 0
        slow, fast = (connected_components(e, "a", "b").collect() for e in (pairs, linkage.link_edges(links, unit)))
        assert sorted(map(tuple, slow)) == sorted(map(tuple, fast))


def test_copies_are_not_linked_pair_by_pair(spark):
    rec = spark.range(300).select("id", *[F.lit("x").alias(c) for c in ("first", "last", "size", "one", "two")])
    unit = linkage.units(rec, keys(), ["first", "last", "size"])
    links = linkage.link(linkage.levels(unit, ["first", "last"], ["size"]), ["first", "last", "size"], [4, 4, 2], min_posterior=0.01)
    assert linkage.expanded(links).count() == 300 * 299 // 2 and linkage.link_edges(links, unit).count() == 300


def test_similarity_of_missing_names_is_null(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    rows = [(1, "red bolt", "B", "LARGE", 1), (2, None, "B", "LARGE", 2), (3, "old bolt", "B", "LARGE", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["er_jaro_winkler"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 2, None), (2, 3, None), (1, 3, 1.0)} and "Aggregate" not in steps_over_join(got)
