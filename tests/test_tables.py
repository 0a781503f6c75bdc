"""Parsers, lookups, upserts, and the streaming upsert."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import pixels as px
from tessera.operators import tables


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_worked_parsers(spark):
    got = values(spark, [("plate/B/05_Merged", "x.czi"), ("Image:0", "exp_C07_x.czi"), ("Image:0", "x.czi"), ("AB/7", "a")], "s string, f string",
                 text.parse_well(F.col("s"), F.col("f")).alias("w"))
    assert [(w.row, w.col) if w else None for (w,) in got] == [("B", "5"), ("C", "7"), None, ("AB", "7")]
    names = values(spark, [("run_Plate2_Sample3_1",), ("run_Plate2_Sample3",), ("abc",)], "n string", *text.parse_dataset(F.col("n")).values())
    assert names == [(2, 3, 1), (2, 3, 0), (None, None, None)]
    assert values(spark, [("a.ome.TIF",), ("a.tif",), ("a.txt",)], "n string", text.format_of(F.col("n")), text.file_stem(F.col("n"))) == [
        ("ome.tif", "a"), ("tif", "a"), (None, "a")]
    assert values(spark, [(240.0,), (0.5,), (float("nan"),), (None,)], "v double", text.normal_value(F.col("v"), True)) == [("240",), ("0.5",), (None,), (None,)]
    assert values(spark, [("False",), ("True",), (None,)], "v string", text.not_nonconfluent(F.col("v"))) == [(False,), (True,), (True,)]
    assert values(spark, [("A",), ("Z",), ("AA",), ("ab",)], "v string", text.row_index(F.col("v"))) == [(0,), (25,), (26,), (27,)]
    keys = values(spark, [("b10",), ("b9",), ("B2x",)], "v string", text.natural_key(F.col("v")))
    assert sorted(range(3), key=lambda i: keys[i]) == [2, 1, 0]
    assert values(spark, [("X_Merged",)], "v string", text.name_filter(F.col("v"), ["_merged"])) == [(True,)]


def test_upserts(spark):
    old = spark.createDataFrame([("s1", 0, "o"), ("s1", 1, "o"), ("s2", 0, "o")], "scene string, timepoint int, src string")
    new = spark.createDataFrame([("s1", 1, "n")], old.schema)
    got = sorted(tuple(r) for r in tables.upsert_scenes(old, new).collect())
    assert got == [("s1", 0, "o"), ("s1", 1, "n"), ("s2", 0, "o")]
    single = old.where("timepoint = 0")
    got = sorted(tuple(r) for r in tables.upsert_scenes(single, spark.createDataFrame([("s1", 0, "n")], old.schema)).collect())
    assert got == [("s1", 0, "n"), ("s2", 0, "o")]
    twice = tables.upsert(tables.upsert(old, new, ["scene", "timepoint"]), new, ["scene", "timepoint"])
    assert twice.count() == 3


def test_zscores_and_missing_plate(spark):
    rows = [(None, float(v), c) for v, c in zip([10, 12, 14, 20, 8], [True, True, True, False, False])] + [(1, 5.0, True), (1, 7.0, False)]
    df = spark.createDataFrame(rows, "plate_num int, v double, is_control boolean")
    z = tables.zscores(df, ["v", "nope"], ["plate_num"]).orderBy("v").collect()
    assert {(r.plate_num, r.v): r.Zscore_v for r in z} == {
        (None, 10.0): -1.0, (None, 12.0): 0.0, (None, 14.0): 1.0, (None, 20.0): 4.0, (None, 8.0): -2.0, (1, 5.0): None, (1, 7.0): None}
    assert all(r.Zscore_nope is None for r in z)


def test_duplicate_wells_are_an_error(spark):
    cells = spark.createDataFrame([(1, "A1", 0.5)], "plate_num long, well_id string, v double")
    pm = spark.createDataFrame([(1, "A1", "x"), (1, "A1", "y")], "Plate long, well_id string, Treatment string")
    with pytest.raises(ValueError):
        tables.add_plate_metadata(cells, pm, ["Treatment"])


@pytest.mark.parametrize("n,k", [(10, 4), (7, 7), (5, 9), (100, 1), (101, 10)])
def test_evenly_spaced(spark, n, k):
    got = sorted(r.id for r in tables.evenly_spaced(spark.range(n), ["id"], k).collect())
    want = list(range(n)) if n <= k else sorted({int(np.round(i * (n - 1) / (k - 1))) for i in range(k)}) if k > 1 else [0]
    assert got == want


def test_nearest_neighbour(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(y), float(x)) for s in range(3) for i, (y, x) in enumerate(rng.random((60, 2)) * [300, 20])]
    rows += [(9, 0, 1.0, 1.0), (8, 0, 0.0, 0.0), (8, 1, 5000.0, 0.0), (8, 2, 5000.0, 0.0)]
    df = spark.createDataFrame(rows, "scene int, label int, centroid_y double, centroid_x double")
    got = {(r.scene, r.label): r.distance for r in px.nearest_neighbour(df, ["scene"], "label", 2.0).collect()}
    assert len(got) == len(rows) and got[9, 0] is None and got[8, 1] == 0.0 and got[8, 0] == 5000.0
    for s, i, y, x in rows[:180]:
        want = min(np.hypot(y - b, x - c) for t, j, b, c in rows if t == s and j != i)
        assert np.isclose(got[s, i], want)


def test_streaming_upsert(spark, tmp_path):
    from tessera.plans.pipeline import Store
    from tessera.streaming.incremental import arriving_tables, keep_current

    schema = "dataset string, scene string, timepoint int, cell_id long, v double"
    src, store = str(tmp_path / "in"), Store(spark, tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def fold():
        stream = arriving_tables(spark, src, spark.createDataFrame([], schema).schema, 1)
        keep_current(stream, store, "m", str(tmp_path / "cp")).awaitTermination()

    arrive([("007", "s1", 0, 1, 1.0), ("007", "s1", 0, 2, float("nan")), ("b", "s1", 0, 1, 3.0)])
    fold()
    arrive([("007", "s1", 0, 1, 9.0), ("007", "s2", 0, 1, 4.0)])
    fold()
    got = sorted((r.dataset, r.scene, r.cell_id, r.v) for r in store.read("m").collect())
    assert got == [("007", "s1", 1, 9.0), ("007", "s2", 1, 4.0), ("b", "s1", 1, 3.0)]


def test_z_projection_and_common_crop(spark):
    rows = [(1, z, y, x, float(10 * z + y + x)) for z in range(3) for y in range(2) for x in range(2)]
    p = spark.createDataFrame(rows, "k int, z int, y int, x int, v double")
    for how, want in (("max", 20.0), ("mean", 10.0), ("middle", 10.0)):
        assert px.project_z(p, ["k"], how).where("y = 0 and x = 0").first().v == want
    a = spark.createDataFrame([(1, t, y, x) for t, n in ((0, 3), (1, 2)) for y in range(n) for x in range(3)], "k int, t int, y int, x int")
    assert px.crop_common(a, ["k"], ["t"]).groupBy("t").count().toPandas()["count"].tolist() == [6, 6]
