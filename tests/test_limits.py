"""Inputs beyond limits that loops and formulas once had, and tables whose datasets become empty."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import probability, text
from tessera.operators import graph, pixels, summary, tables, tracking
from tessera.plans.pipeline import KEYS, Store
from tessera.streaming import incremental


def test_lineage_of_any_length(spark):
    n = 40
    chain = spark.createDataFrame([("s", i, i - 1 if i else None) for i in range(n)], "scene string, track_id int, parent_track_id int")
    got = {(r.track_id, r.ancestor): r.generations for r in tracking.ancestors(chain, ["scene"]).collect()}
    assert got == {(i, j): i - j for i in range(n) for j in range(i)}
    assert tracking.ancestors(chain.limit(0), ["scene"]).count() == 0


def test_merging_along_a_chain_ends_complete(spark):
    n = 4
    edges = spark.createDataFrame([("s", i, i + 1, float(i)) for i in range(n)], "scene string, a int, b int, weight double")
    nodes = spark.createDataFrame([("s", i, 1) for i in range(n + 1)], "scene string, node int, load int")
    roots, taken = graph.merge_weakest_first(edges, nodes, ["scene"], F.lit(100))
    assert {r.root for r in roots.collect()} == {0} and taken.count() == n


@pytest.mark.parametrize("block_edges", [1 << 18, 1000])
def test_a_long_ascending_chain_takes_few_rounds(spark, monkeypatch, block_edges):
    n, cap = 100_000, 7
    ids = spark.range(n + 1)
    nodes = ids.select(F.lit("s").alias("scene"), F.col("id").alias("node"), F.lit(1).alias("load"))
    edges = ids.where(F.col("id") < n).select(F.lit("s").alias("scene"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").cast("double").alias("weight"))
    rounds = []
    step = graph._merge_blocks
    monkeypatch.setattr(graph, "_merge_blocks", lambda *args: rounds.append(1) or step(*args))
    roots, taken = graph.merge_weakest_first(edges, nodes, ["scene"], F.lit(cap), block_edges, 1 << 15)
    assert roots.where("root <> node - node % 7").isEmpty() and taken.count() == n + 1 - -(-(n + 1) // cap)
    assert len(rounds) == 1 if block_edges > n else len(rounds) < 20


def test_nearest_neighbour_of_far_and_unplaced_points(spark):
    rows = [("s", 1, 0.0, 0.0), ("s", 2, 0.0, 20.0), ("s", 3, None, 5.0), ("s", 4, float("nan"), 5.0), ("t", 5, None, None), ("t", 6, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "scene string, id int, centroid_y double, centroid_x double")
    got = {r.id: r.distance for r in pixels.nearest_neighbour(points, ["scene"], "id").collect()}
    assert got == {1: 20.0, 2: 20.0, 3: None, 4: None, 5: None, 6: None}


def test_long_numbers_sort_as_numbers(spark):
    names = ["x9", "x10", "x1234567890123456789", "x1234567890123456788", "x0001234567890123456789", "x99999999999999999999", "x" + "9" * 40, "x7y2", "x07y10"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in frame.orderBy(text.natural_key(F.col("n")), "n").collect()]
    assert got == sorted(names, key=lambda n: ([int(p) if p.isdigit() else p for p in __import__("re").findall(r"\d+|\D+", n)], n))


def count_arrangements(u, n, m):
    """Ordered pairs by recursion: how many arrangements of n and m have U = u."""
    if u < 0:
        return 0
    if n == 0 or m == 0:
        return int(u == 0)
    return count_arrangements(u - m, n - 1, m) + count_arrangements(u, n, m - 1)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (5, 3), (8, 4), (2, 30)])
def test_exact_rank_sum(n, m):
    counts = [count_arrangements(u, n, m) for u in range(n * m + 1)]
    assert sum(counts) == math.comb(n + m, n)
    for u in range(n * m + 1):
        tail = sum(counts[max(u, n * m - u):]) / sum(counts)
        assert probability.exact_rank_sum_two_sided(u, n, m) == pytest.approx(min(1, 2 * tail), rel=1e-12)


def test_exact_rank_sum_of_large_samples():
    p = probability.exact_rank_sum_two_sided
    assert p(0, 8, 1000) == pytest.approx(2 / math.comb(1008, 8), rel=1e-12)
    assert p(1, 20000, 8) == pytest.approx(4 / math.comb(20008, 8), rel=1e-12)
    assert p(0, 8, 10**9) > 0 and p(4 * 10**9, 8, 10**9) == pytest.approx(1, abs=1e-3)
    assert all(0 <= p(u, 8, 50) <= 1 for u in range(0, 401, 7))


def scenes(spark, rows):
    return spark.createDataFrame(rows, "dataset string, scene string, timepoint int, value int")


def test_a_dataset_without_rows_loses_its_old_ones(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.write("t", scenes(spark, [("007", "a", 0, 1), ("b=%/x", "a", 0, 2), ("c", "a", 0, 3), ("c", "b", 0, 4)]))
    done = scenes(spark, [("007", "a", 0, 0), ("b=%/x", "a", 0, 0), ("c", "a", 0, 0)]).select(*KEYS)
    store.upsert("t", scenes(spark, [("c", "a", 0, 9)]), done)
    assert sorted(tuple(r) for r in store.read("t").select("dataset", "scene", "value").collect()) == [("c", "a", 9), ("c", "b", 4)]
    store.upsert("t", scenes(spark, []), store.read("t").select(*KEYS))
    assert not store.has("t") and store.read("t") is None


def test_the_stream_replaces_scenes(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    store.write("t", scenes(spark, [("a", "x", 0, 1), ("a", "y", 0, 2)]))
    scenes(spark, [("a", "x", 0, 7)]).write.parquet(str(tmp_path / "in" / "one"))
    stream = incremental.arriving_tables(spark, str(tmp_path / "in"), store.read("t").select("dataset", "scene", "timepoint", "value").schema)
    incremental.keep_current(stream, store, "t", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.scene, r.value) for r in store.read("t").collect()) == [("x", 7), ("y", 2)]


def test_group_facts_do_not_move_the_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 5).cast("string").alias("plate"), (F.col("id") * 0.5).alias("value"), (F.col("id") % 2 == 0).alias("is_control"))
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in limits:
            spark.conf.set(name, "1")
        for made in (tables.zscores(rows, ["value"], ["plate"]), summary.keep_large_groups(rows, "plate", 10), summary.subsample(rows, "plate", ["id"], 10)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
            assert made.count() > 0
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_first_known_label_does_not_depend_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 1, None), ("g", 2, "0")], "g string, r int, label string")
    assert tables.first_known(rows, ["g"], "label", ["r"]).first().label == "a"
