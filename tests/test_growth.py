"""What a worker holds and how often it is called must not grow with the input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import graph, tiles
from tessera.operators import segment as sg


def images(spark, n):
    return spark.range(n).select(
        F.col("id").alias("vec_id"), F.lit(4).alias("height"), F.lit(4).alias("width"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((i * 7 + F.col("id")) % 5).cast("float")).alias("v"),
    )


def test_a_worker_hands_on_rows_before_a_batch_is_done(spark):
    schema = StructType.fromDDL("id bigint, y int")
    run = tiles.chained(None, (), lambda row: {"id": [row["id"]] * 64, "y": list(range(64))}, schema)
    sizes = [len(f) for f in run([pd.DataFrame({"id": range(3000)})])]
    assert sum(sizes) == 64 * 3000 and max(sizes) < tiles.HELD_ROWS + 64


def test_functions_of_single_tiles_share_one_worker(spark):
    t = tiles.tile_images(images(spark, 20), ["vec_id"], {"v": "<f4"}, 4, single=True)
    t = sg.pointwise(t, ["v"], "d", "f8", lambda b: 2.0 * b["v"])
    t = t.with_scalar(spark.range(20).select(F.col("id").alias("vec_id"), (F.col("id") * 1.0).alias("limit")))
    t = sg.pointwise(t, ["d"], "d", "f8", lambda b: b["d"] + b.limit, per_image=["limit"])
    t = t.with_scalar(spark.range(20).select(F.col("id").alias("vec_id"), F.lit(100.0).alias("limit")))
    out = sg.pointwise(t, ["d"], "d", "f8", lambda b: b["d"] + b.limit, per_image=["limit"]).pixels_table("d", "d double")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    got = {(r.vec_id, r.y, r.x): r.d for r in out.collect()}
    assert len(got) == 320
    assert all(d == 2.0 * ((4 * y + x) * 7 + i) % 10 + i + 100 for (i, y, x), d in got.items())


def test_many_small_images_are_merged_in_one_call(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(a), int(b), float(w)) for i in range(300) for a, b, w in zip([1, 2, 3, 1], [2, 3, 4, 4], rng.integers(0, 3, 4))]
    edges = spark.createDataFrame(rows, "image bigint, a bigint, b bigint, weight double")
    nodes = spark.createDataFrame([(i, n, 1) for i in range(300) for n in range(1, 5)], "image bigint, node bigint, load bigint")
    _, taken = graph.merge_weakest_first(edges, nodes, ["image"], F.lit(3))
    want = set()
    for i in range(300):
        part = {n: {n} for n in range(1, 5)}
        for _, a, b, w in sorted((r for r in rows if r[0] == i), key=lambda r: (r[3], r[1], r[2])):
            if part[a] is not part[b] and len(part[a] | part[b]) <= 3:
                whole = part[a] | part[b]
                part.update(dict.fromkeys(whole, whole))
                want.add((i, a, b))
    assert {(r.image, r.a, r.b) for r in taken.collect()} == want


def test_blocks_are_settled_without_a_frame_each():
    # the rows of a block come as plain tuples, in order
    rows = [(1, 2, 0.5, 1, 2, 1, 1, 3, True), (2, 3, 0.6, 2, 3, 1, 1, 3, True), (3, 4, 0.7, 3, 4, 1, 1, 3, True)]
    assert [r[:3] for r in graph.settled(rows) if r[0] == "taken"] == [("taken", 1, 2), ("taken", 2, 3)]


def test_an_image_of_one_block_takes_no_rounds(spark, monkeypatch):
    t = tiles.tile_images(images(spark, 20), ["vec_id"], {"v": "<f4"}, 2, single=False)
    monkeypatch.setattr(tiles.Tiles, "repeat", (lambda f: lambda self, *a, **b: seen.append(self.single) or f(self, *a, **b))(tiles.Tiles.repeat))
    seen = []
    t = sg.pointwise(t, ["v"], "m", sg.LABEL, lambda b: sg.np.where(b["v"] == 0, b.positions(), 0))
    t = sg.pointwise(t, ["v"], "h", "f8", lambda b: b["v"].astype(float))
    assert sg.watershed(t, "h", "m", "w").df.count() == 80
    assert seen == [True, True]


def test_blocks_of_tiles_give_what_tiles_give(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, h, w, bytearray(rng.random((h, w)).astype("<f4").tobytes())) for i, (h, w) in enumerate([(7, 12), (4, 4)])]
    df = spark.createDataFrame(rows, "scene int, height int, width int, v binary")

    def flooded(block):
        monkeypatch.setattr(tiles, "BLOCK", block)
        t = tiles.tile_images(df, ["scene"], {"v": "<f4"}, 4, single=False)
        t = sg.pointwise(t, ["v"], "k", "u1", lambda b: sg.np.ones(b["v"].shape))
        t = sg.peaks(t, "v", "k", "p", 1)
        t = sg.watershed(sg.pointwise(t, ["v"], "h", "f8", lambda b: -b["v"].astype(float)), "h", "p", "w")
        t = sg.deep_minima(t, "v", "o", spark.range(2).selectExpr("cast(id as int) as scene", "0.3D as depth"))
        assert t.size == 4
        return {(r.scene, r.ty, r.tx, r.height, r.width): (bytes(r.w), bytes(r.o)) for r in t.df.collect()}

    # 4: tiles as they are, 8: blocks of 2 x 2 tiles, 256: every image is one block
    want = flooded(4)
    assert len(want) == 2 * 3 + 1 and flooded(8) == want and flooded(256) == want


def test_batches_of_tiles_are_bounded_in_any_session(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        t = tiles.tile_images(images(spark, 5000).coalesce(1), ["vec_id"], {"v": "<f4"}, 4, single=True)
        sizes = t.df.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) <= 256
        wide = spark.range(64).coalesce(1).selectExpr("id", "cast(repeat('x', 1 << 20) as binary) as v")
        sizes = wide.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 64 and max(r.n for r in sizes) <= 16
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_facts_may_be_joined_after_tiles_met(spark):
    t = tiles.tile_images(images(spark, 3), ["vec_id"], {"v": "<f4"}, 2, single=False)
    t = sg.box_maximum(t, "v", "m", 1).with_scalar(spark.range(3).selectExpr("id as vec_id", "cast(id as double) as more"))
    out = sg.pointwise(t, ["m"], "m", "f8", lambda b: b["m"] * 0 + b.more, per_image=["more"]).pixels_table("m")
    got = out.collect()
    assert len(got) == 48 and all(r.v == r.vec_id for r in got)
