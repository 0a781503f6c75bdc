"""Label files written by tile, and images segmented slice by slice."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import SETTINGS, scene
from test_tiles import make

from tessera.operators import segment as sg
from tessera.plans import config, pipeline
from tessera.sources import tiff
from tessera.sources.labels import write_labels


def read(path):
    with open(path, "rb") as f:
        return [tiff.read_page(f, p) for p in tiff.read_directory(f)]


def label_tiles(spark, arrays, size):
    return sg.pointwise(make(spark, {i: {"v": a} for i, a in arrays.items()}, size, v="f8"), ["v"], "l", sg.LABEL, lambda b: b["v"].astype("i8"))


def test_pages_from_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = {0: rng.integers(0, 300, (37, 50)).astype(float), 2: rng.integers(0, 70_000, (33, 61)).astype(float)}
    t = label_tiles(spark, a, 16)
    write_labels(t, "l", str(tmp_path / "one"), F.concat(F.lit("i"), F.col("scene")), ".tif")
    for i, b in a.items():
        (got,) = read(tmp_path / "one" / f"i{i}.tif")
        assert np.array_equal(got, b) and got.dtype == ("u2" if b.max() < 65535 else "u4")
    write_labels(t, "l", str(tmp_path / "film"), F.lit("s"), ".tif", page="scene")
    pages = read(tmp_path / "film" / "s.tif")
    assert len(pages) == 3 and not pages[1].any()
    assert np.array_equal(pages[0], a[0][:33, :50]) and np.array_equal(pages[2], a[2][:33, :50])
    (tmp_path / "one" / "i0_old.tif").write_bytes(b"x")
    write_labels(t, "l", str(tmp_path / "one"), F.concat(F.lit("i"), F.col("scene")), "_m.tif", mask=True, replaced=["_old.tif"])
    assert np.array_equal(read(tmp_path / "one" / "i0_m.tif")[0], np.where(a[0] > 0, 255, 0)) and not (tmp_path / "one" / "i0_old.tif").exists()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    t = label_tiles(spark, {i: np.full((20, 20), i + 1.0) for i in range(6)}, 16)

    def fail(b):
        if b.key[0] == 3 and b.ty == 1:
            raise ValueError("broken tile")
        return {"l": b["l"]}

    with pytest.raises(Exception, match="broken tile"):
        write_labels(t.transform(["l"], {"l": sg.LABEL}, fail), "l", str(tmp_path), F.col("scene").cast("string"), ".tif")
    assert list(tmp_path.iterdir()) == []


def test_slices_are_segmented_one_by_one(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stack = [scene(0), scene(1), (np.full((72, 72), 10.0), scene(0)[1])]  # no nuclei in the last slice
    stack[2][0][30:40, 30:40] = 200
    ome = '<OME xmlns="x"><Image ID="Image:0" Name="B/01"><Pixels DimensionOrder="XYCZT" SizeC="2" SizeT="1" SizeZ="3" PhysicalSizeX="2" PhysicalSizeY="2"/></Image></OME>'
    (source / "a.ome.tif").write_bytes(tiff.encode([a.astype("u2") for pair in stack for a in pair], ome))
    off = dict.fromkeys(("run_measurement", "run_aggregation", "run_analysis", "run_overview", "save_size_statistics", "track_cells"), False)
    cfg = {**SETTINGS, **off, "input_path": str(source), "output_root": str(tmp_path / "out"), "seg_mode": "per_slice", "time_mode": "single", "merge_multinucleated": False}
    assert pipeline.run(spark, cfg, 48) == "completed"
    store = pipeline.Store(spark, tmp_path / "out" / "per_file")
    (row,) = store.read("segmentation_summary").collect()
    assert (row.n_nuclei, row.n_cells, row.n_slices, row.confluent) == (19, 2 + 1, 3, False)
    pages = read(next((tmp_path / "out" / "per_file" / "segmentation").glob("*_nuclei_labels.tif")))
    assert [set(np.unique(p)) - {0} for p in pages] == [set(range(1, 10)), set(range(10, 19)), {19}]
    cells = read(next((tmp_path / "out" / "per_file" / "segmentation").glob("*_cell_labels.tif")))
    assert [set(np.unique(p)) - {0} for p in cells[:2]] == [{5}, {14}]


def test_slices_and_measurement_exclude_each_other(tmp_path):
    cfg = config.normalise({"input_path": str(tmp_path), "output_root": str(tmp_path), "seg_mode": "per_slice", "run_measurement": True})
    assert any("measurement" in p for p in config.problems(cfg))
    cfg["run_measurement"] = False
    assert not config.problems(cfg)
