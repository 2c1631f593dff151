"""Ranges, references, labels and verification against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from burin.operators import closure, labels, ranges
from burin.operators import inventory as I


def islands(regions):
    out = {}
    for a, s, e in sorted((r for r in regions if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        own = out.setdefault(a, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return sorted((str(a), s, e) for a, own in out.items() for s, e in own)


def regions_of(rng, n):
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), s := rng.randint(-300, 300), s + rng.choice([0, 0, 1, 2, 5, 90])) for _ in range(n)]
    return rows + [("x", None, 3), ("x", 3, None), ("hot", 7, 4)] + rows[:5]


@pytest.mark.parametrize("most", [3, 40, 1 << 20])
def test_islands_and_gaps_of_hot_artifacts(spark, most):
    rows = regions_of(random.Random(most), 260)
    df = spark.createDataFrame(rows, "piece string, a int, to int")
    got = sorted((str(r["piece"]), r["a"], r["to"]) for r in ranges.merged_regions(df, "piece", "a", "to", most).collect())
    assert got == islands(rows)
    between = sorted((x[0], x[2], y[1]) for x, y in zip(got, got[1:], strict=False) if x[0] == y[0])
    assert sorted((str(r["piece"]), r["a"], r["to"]) for r in ranges.gaps(df, "piece", "a", "to", most).collect()) == between


def test_one_artifact_is_many_tasks(spark):
    df = spark.range(0, 20_000).select(F.lit("all").alias("a"), F.col("id").alias("start"), (F.col("id") + F.col("id") % 2).alias("end"))
    slim, cuts = ranges._slim(df, "a", "start", "end", 1000)
    sizes = [r["count"] for r in ranges._pieced(slim, cuts).groupBy("piece").count().collect()]
    assert len(sizes) == ranges.PIECES and max(sizes) < 3 * 20_000 / ranges.PIECES
    assert ranges.merged_regions(df, "a", most=1000).count() == 10_001


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_offsets_move_by_the_changes_before_them(spark, most):
    rng = random.Random(3)
    changes = [(rng.choice(["hot", "hot", "x", None]), rng.randint(0, 60), rng.randint(-9, 9)) for _ in range(150)] + [("hot", None, 4)]
    offsets = [(i, rng.choice(["hot", "hot", "x", "none", None]), rng.choice([7, rng.randint(0, 70)])) for i in range(300)] + [(1000, "hot", None)]
    got = ranges.translated(spark.createDataFrame(offsets, "shift int, a string, at int"), spark.createDataFrame(changes, "a string, e int, d int"), "a", "at", "e", "d", most=most).collect()
    assert len(got) == len(offsets)
    want = {i: None if x is None else x + sum(d for b, e, d in changes if b == a and e is not None and e <= x) for i, a, x in offsets}
    assert {r["shift"]: r["moved"] for r in got} == want


def test_ranges_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, start int, end int")
    assert ranges.merged_regions(none, "a").collect() == ranges.gaps(none, "a").collect() == []
    offsets = spark.createDataFrame([("x", 4)], "a string, at int")
    assert ranges.translated(offsets, none, "a", "at", "start", "end").collect() == [("x", 4, 4)]


def test_closure_of_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(rng.randint(0, 60), rng.choice([0, rng.randint(0, 60)])) for _ in range(rng.choice([20, 70]))] + [(100 + i, 101 + i) for i in range(6)] + [(None, 3), (3, None), (5, 5)]
        roots = [rng.randint(0, 60), 100, 100, None, 999]
        depth = dict.fromkeys([r for r in roots if r is not None], 0)
        queue = list(depth)
        for n in queue:
            for s, t in edges:
                if s == n and t is not None and t not in depth:
                    depth[t] = depth[n] + 1
                    queue.append(t)
        got = closure.reached(spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame([(r,) for r in roots], "node int")).collect()
        assert {r["node"]: r["depth"] for r in got} == depth and len(got) == len(depth)


def test_removal_in_chain_stays_in_its_package(spark):
    items = spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("p", "c", "b"), ("p", "d", "x"), ("q", "b", "a"), ("q", "e", "e"), (None, "b", "a"), ("p", None, "a")], "package string, key string, refers_to string")
    gone = spark.createDataFrame([("p", "a")], "package string, key string")
    assert {tuple(r) for r in closure.removed_in_chain(items, gone, "package", "key", "refers_to").collect()} == {("p", "a", 0), ("p", "b", 1), ("p", "c", 2)}
    assert closure.removed_in_chain(items, gone.where("false"), "package", "key", "refers_to").collect() == []


def test_manifest_rows_without_a_file_go(spark):
    manifest = spark.createDataFrame([("p", "/"), ("p", "a"), ("p", "a"), ("p", "b"), ("q", "a"), ("q", None)], "pkg string, path string")
    files = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), (None, "b", 3)], "pkg string, path string, size int")
    assert sorted(map(tuple, closure.present(manifest, files, "pkg", "path").collect())) == [("p", "/"), ("p", "a"), ("p", "a")]


def test_verification_has_a_row_for_every_artifact(spark):
    schema = "id int, ord int, where string, key string, label string, value string, removal string, hex string"
    entry = lambda i, n, value="v", removal="individual", hexed=None, where="w": (i, n, where, f"k{n}", f"L{n}", value, removal, hexed)
    before = [entry(1, n) for n in range(9, 0, -1)] + [entry(2, 1), entry(3, 1, removal="never"), entry(4, 1, "", hexed="ff"), entry(5, 1, "", hexed="ff"), entry(6, 1, ""), entry(7, 1, where=None), entry(None, 1)]
    after = [entry(1, n) for n in range(2, 9)] + [entry(2, 1, "changed"), entry(3, 1, removal="never"), entry(4, 1, "", hexed="ff"), entry(5, 1, "", hexed="00"), entry(6, 1, ""), entry(7, 1, where=None), entry(8, 1)]
    spine = spark.createDataFrame([(i,) for i in (1, 2, 9, None)], "id int")
    got = {r["id"]: tuple(r)[1:] for r in I.verify(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "id", spine).collect()}
    assert got == {1: ("remaining", 7, "L2; L3; L4; L5; L6"), 2: ("clean", 0, ""), 3: ("clean", 0, ""), 4: ("remaining", 1, "L1"), 5: ("clean", 0, ""), 6: ("clean", 0, ""), 7: ("remaining", 1, "L1"), 8: ("clean", 0, ""), 9: ("unverifiable", 0, "")}


def test_labels_by_the_longest_rule(spark):
    table = labels.rules(spark, (("t", "a", True, "A", "low"), ("t", "ab", True, "AB", "high"), ("t", "abc", False, "ABC", "medium"), ("u", "a", False, "UA", "high"), ("t", "ab", True, "AB", "high")))
    keys = [("t", "abc"), ("t", "abcd"), ("t", "ab"), ("t", "ax"), ("t", "zz"), ("u", "a"), ("u", "ab"), ("id3", "zz"), (None, "a"), ("t", None), ("t", ""), ("t", "abc")]
    got = labels.labelled(spark.createDataFrame([(i, *k, "old") for i, k in enumerate(keys)], "n int, tags string, key string, label string"), table).orderBy("n").collect()
    assert [(r["label"], r["sensitivity"]) for r in got] == [("ABC", "medium"), ("AB", "high"), ("AB", "high"), ("A", "low"), ("zz", "low"), ("UA", "high"), ("ab", "low"), ("zz", "medium"), ("a", "low"), (None, "low"), ("", "low"), ("ABC", "medium")]
