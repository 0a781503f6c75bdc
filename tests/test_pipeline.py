"""A whole run on synthetic scenes with known cells."""

import json

import numpy as np
import pytest

from tessera.operators import segment as sg
from tessera.plans import pipeline
from tessera.sources import tiff


def scene(shift=0, size=72, step=24):
    """A grid of bright nuclei inside cells separated by bright junction lines."""
    y, x = np.mgrid[:size, :size]
    nuc, edge = np.full((size, size), 10.0), np.full((size, size), 10.0)
    for cy in range(step // 2, size, step):
        for cx in range(step // 2, size, step):
            nuc += 200 * (((y - cy - shift) ** 2 + (x - cx) ** 2) <= 20)
    edge += 150 * ((y % step == 0) | (x % step == 0))
    return nuc, edge


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for i, name in enumerate(("run_Plate1_Sample1", "run_Plate1_Sample2")):
        planes = [a.astype("u2") for t in range(2) for a in scene(t + i)]
        ome = ('<OME xmlns="x"><Image ID="Image:0" Name="B/0%d_merged"><Pixels DimensionOrder="XYCTZ" SizeC="2" SizeT="2" SizeZ="1" '
               'PhysicalSizeX="2" PhysicalSizeY="2"/></Image></OME>' % (i + 1))
        (root / f"{name}.ome.tif").write_bytes(tiff.encode(planes, ome))
    return root


SETTINGS = {
    "file_format": "ome.tif", "size_units": "px", "nuclei_sigma": 0.8, "min_nucleus_size": 20, "min_distance": 4, "edge_sigma": 0.7,
    "min_label_size": 30, "clear_border_labels": True, "clear_border_buffer": 0, "multinuc_band_px": 1, "multinuc_max_distance": 10, "nuc_dilation_rad": 2,
    "min_hole_size": 4, "boundary_band_px": 1, "seed_sigma": 3, "max_cell_area": 2000, "min_nuclei_confluent": 4, "channel_names": "DNA, Edge",
    "edge_channels": "1", "zscore_columns": "mean_Edge", "control_wells": "B1", "plot_columns": "mean_*", "min_cells_per_group": 1,
    "group_by": "well_id", "time_mode": "series", "run_overview": True, "overview_max_px": 40,
}


@pytest.mark.parametrize("tile", [32])
def test_run(spark, folder, tmp_path, tile):
    cfg = {**SETTINGS, "input_path": str(folder), "output_root": str(tmp_path)}
    assert pipeline.run(spark, cfg, tile) == "completed"
    store = pipeline.Store(spark, tmp_path / "per_file")
    s = {(r.dataset, r.timepoint): r for r in store.read("segmentation_summary").collect()}
    assert len(s) == 4 and all(r.n_nuclei == 9 and r.confluent and r.status == "ok" for r in s.values())
    m = store.read("cell_measurements")
    rows = m.collect()
    assert {r.well_id for r in rows} == {"B1", "B2"} and all(r.n_nuclei == 1 for r in rows)
    # only the middle cell does not touch the border
    assert all(r.cell_id == 5 and abs(r.centroid_x - 36) < 1.5 for r in rows) and len(rows) == 4
    assert all(r.track_id == 1 and r.track_n_frames == 2 for r in rows)
    assert all(r.mean_Edge < 60 and r.edge_mean_Edge > 15 and r.nuc_area_px > 40 for r in rows)
    log = json.loads(next((tmp_path / "logs").glob("*.json")).read_text())
    assert log["status"] == "completed" and [x["stage"] for x in log["stages"]][-1] == "analysis"
    assert (tmp_path / "results" / "plots" / "index.html").exists()
    assert list((tmp_path / "per_file" / "tracking").glob("*_tracked_labels.tif"))
    with open(next((tmp_path / "per_file" / "tracking").glob("*.tif")), "rb") as f:
        pages = tiff.read_directory(f)
        assert len(pages) == 2 and tiff.read_page(f, pages[0]).max() == 1
    for kind in ("cell_labels", "nuclei_labels", "nuclei_mask"):
        assert len(list((tmp_path / "per_file" / "segmentation").glob(f"*_t000?_{kind}.tif"))) == 4
    with open(next((tmp_path / "per_file" / "segmentation").glob("*_cell_labels.tif")), "rb") as f:
        assert set(np.unique(tiff.read_page(f, tiff.read_directory(f)[0]))) == {0, 5}
    assert len(list((tmp_path / "per_file" / "segmentation_qc").glob("*_qc.png"))) == 4
    assert len(list((tmp_path / "per_file" / "overview").glob("*_overview.png"))) == 2
    # a second run without overwriting finds nothing to do and keeps everything
    cfg.update(overwrite_segmentation=False, overwrite_measurement=False, run_analysis=False, run_aggregation=False)
    assert pipeline.run(spark, cfg, tile) == "completed"
    assert store.read("segmentation_summary").count() == 4


def two_cells(spark, gap):
    """Two nuclei in one image; ``gap`` is the junction intensity between them."""
    from test_tiles import make

    nuc, edge = np.zeros((24, 40)), np.zeros((24, 40))
    cells, nuclei = np.zeros((24, 40), int), np.zeros((24, 40), int)
    for i, x in enumerate((5, 15, 25, 35), 1):
        cells[:, 10 * (i - 1): 10 * i] = i
        nuclei[10:14, x - 2: x + 2] = i
    for x, v in ((10, 100.0), (20, gap), (30, 100.0)):
        edge[:, x - 1: x + 1] = v
    return make(spark, {1: {"c": cells, "n": nuclei, "e": edge, "m": nuclei > 0}}, 16, c="i8", n="i8", e="f8", m="u1")


def test_multinucleated_merge(spark):
    for gap, merged in ((5.0, {2: 2}), (90.0, {})):
        t = two_cells(spark, gap)
        out, taken, n = sg.merge_multinucleated(t, "c", "n", "e", "m", 12.0, 0.5, 2, 0)
        assert {r.label: r.n_nuclei for r in n.collect()} == merged and taken.count() == len(merged)
        labels = {r.label for r in sg.label_sizes(out, "c").collect()}
        assert labels == ({1, 2, 4} if merged else {1, 2, 3, 4})


def test_merge_is_the_sequential_greedy(spark):
    from tessera.operators import graph

    rng = np.random.default_rng(4)
    edges, nodes, want = [], [], {}
    for image in range(4):
        n = 12
        load = rng.integers(1, 6, n).tolist()
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        w = rng.permutation(len(pairs)).tolist()
        edges += [(image, a, b, float(x)) for (a, b), x in zip(pairs, w)]
        nodes += [(image, i, v) for i, v in enumerate(load)]
        root, size = list(range(n)), list(load)

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for _, (a, b) in sorted(zip(w, pairs)):
            a, b = sorted((find(a), find(b)))
            if a != b and size[a] + size[b] <= 10:
                root[b] = a
                size[a] += size[b]
        want.update({(image, i): find(i) for i in range(n)})
    from pyspark.sql import functions as F

    e = spark.createDataFrame(edges, "scene int, a long, b long, weight double")
    v = spark.createDataFrame(nodes, "scene int, node long, load long")
    roots, _ = graph.merge_weakest_first(e, v, ["scene"], F.lit(10))
    assert {(r.scene, r.node): r.root for r in roots.collect()} == want
    # in blocks of a few node numbers: edges within and across blocks, more than one round
    roots, taken = graph.merge_weakest_first(e, v, ["scene"], F.lit(10), block_edges=2, block_nodes=4)
    assert {(r.scene, r.node): r.root for r in roots.collect()} == want
    assert taken.count() == sum(k[1] != r for k, r in want.items())


def test_junction_seeds_and_merge(spark):
    from test_tiles import back, make

    _, edge = scene(size=48, step=24)
    t = make(spark, {1: {"e": edge}}, 24, e="f8")
    p = {"segment_objects": "cells", "seed_source": "junctions", "seed_sigma": 3.0, "seed_min_depth": 0.02, "edge_sigma": 0.7, "edge_mode": "intensity",
         "junction_merge_ratio": 0.4, "max_cell_area": 2000, "multinuc_band_px": 1, "min_nuclei_confluent": 1, "nonconfluent_enabled": False,
         "sparse_policy": "confluent", "clear_border_labels": False, "clear_border_buffer": 0, "min_label_size": 10, "edge_threshold": None,
         "edge_threshold_percentile": 20.0, "nuc_dilation_rad": 2}
    got = sg.segment_cells(t, None, "e", p)
    s = got["summary"].first()
    assert s.n_cells == 4 and s.status == "ok"
    lab = back(got["tiles"], "cells")[1]
    assert len({lab[12, 12], lab[12, 36], lab[36, 12], lab[36, 36]}) == 4
