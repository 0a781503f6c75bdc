"""Results that exist: discovery, merged columns, size reports, counters and errors of a run, command lines."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_pipeline import SETTINGS, scene

from tessera.functions import sizes
from tessera.operators import diagnostics
from tessera.plans import commands, config, pipeline
from tessera.sources import tiff, workbook

CSV = {
    "per_file/run_Plate2_Sample3": "cell_id,mean_A,scene\n1,nan,s\n2,3.5,s\n",
    "per_file/run_Plate2_Sample3_1": "cell_id,mean_A,scene,mean_B\n1,4,s,7\n3,5,t,8\n",
    "per_file/a b+c": "mean_B,cell_id,scene\n1.5,9,s\n",
    "run_Plate2_Sample3_1": "cell_id,mean_A,scene\n77,0,s\n",
    "run_Plate1_Sample1": "cell_id,mean_A,scene\n5,6,s\n",
}


@pytest.fixture
def folders(tmp_path):
    for d, body in CSV.items():
        m = tmp_path / d / "measurements"
        m.mkdir(parents=True)
        (m / "x_cell_measurements.csv").write_text(body)
        (m / "._x_cell_measurements.csv").write_text("junk")
        (m / "other.csv").write_text("junk")
    (tmp_path / "per_file" / "empty" / "measurements").mkdir(parents=True)
    return tmp_path


def test_tables_of_result_folders_are_merged(spark, folders):
    scans = workbook.find_scans(spark, str(folders), workbook.text.DATASET_PATTERN)
    assert {r.dataset for r in scans.collect()} == {"run_Plate2_Sample3_1", "a b+c", "run_Plate1_Sample1"}
    rows = {(r.dataset, r.cell_id): (r.mean_A, r.mean_B) for r in workbook.read_scans(spark, scans).collect()}
    assert rows == {("run_Plate2_Sample3_1", 1): (4.0, 7.0), ("run_Plate2_Sample3_1", 3): (5.0, 8.0), ("a b+c", 9): (None, 1.5), ("run_Plate1_Sample1", 5): (6.0, None)}
    every = workbook.find_scans(spark, str(folders), workbook.text.DATASET_PATTERN, keep_latest=False)
    assert every.count() == 4
    assert workbook.find_scans(spark, str(folders / "nowhere"), workbook.text.DATASET_PATTERN).count() == 0
    with pytest.raises(FileNotFoundError):
        workbook.read_scans(spark, every.limit(0))


def test_commands_on_result_folders(spark, folders, tmp_path):
    cfg = config.normalise({"output_root": str(tmp_path / "new"), "aggregation_input_dir": str(folders), "aggregation_format": "csv", "zscore_columns": "mean_A"})
    made = commands.aggregate(spark, cfg)["output"]
    table = commands.read_cells(spark, made)
    assert {(r.source_dataset, r.plate_num, r.cell_id) for r in table.collect()} == {
        ("run_Plate2_Sample3_1", 2, 1), ("run_Plate2_Sample3_1", 2, 3), ("a b+c", None, 9), ("run_Plate1_Sample1", 1, 5)
    }
    cfg |= {"group_by": "source_dataset", "plot_columns": "mean_*", "min_cells_per_group": 1}
    assert commands.analyse(spark, cfg, made, str(tmp_path / "figures"))["columns"] == 2
    assert (tmp_path / "figures" / "index.html").exists() and (tmp_path / "figures" / "summary_statistics_by_source_dataset.csv").exists()
    assert commands.main(["sizes"]) == 2 and commands.main(["analyse"]) == 2


def objects(spark, rows):
    df = spark.createDataFrame(rows, "dataset string, area_px double, equivalent_diameter_px double, pixel_size_um double, n_nuclei long")
    return sizes.with_metric_columns(df, F.col("pixel_size_um"))


def test_one_unit_for_all_tables(spark):
    cells = objects(spark, [("a", 100.0, 10.0, 0.5, 1), ("a", 400.0, 20.0, 0.25, 2), ("b", 50.0, 5.0, 2.0, None), ("c", 10.0, 1.0, 0.5, 3)])
    nuclei = objects(spark, [("a", 30.0, 6.0, 0.5, None), ("b", 20.0, 4.0, None, None), ("c", 9.0, 3.0, 0.5, None)])
    got = {r.dataset: (r.um, r.pixel_size_um, r.mixed, r.area_unit) for r in diagnostics.units({"cells": cells, "nuclei": nuclei}).collect()}
    assert got == {"a": (True, 0.5, True, "µm²"), "b": (False, 2.0, False, "px"), "c": (True, 0.5, False, "µm²"), "ALL FILES": (False, 0.5, False, "px")}
    chosen = diagnostics.units({"cells": cells, "nuclei": nuclei})
    values = {(r.dataset, r.value) for r in diagnostics.in_unit(cells, ["area_px"], chosen).collect()}
    assert {v for v in values if v[0] == "a"} == {("a", 25.0)} and ("ALL FILES", 400.0) in values and ("b", 50.0) in values
    assert {(r.dataset, r.n, round(r.fraction, 3)) for r in diagnostics.multinucleated(cells).collect()} == {("a", 2, 0.5), ("c", 1, 1.0), ("ALL FILES", 4, 0.5)}
    report = diagnostics.report({"cells": cells, "nuclei": nuclei, "raw": None}, config.normalise({"size_units": "um"})).toPandas()
    at = report.set_index(["dataset", "object", "measure"])
    assert at.loc[("a", "cells", "area_um2"), "median"] == 25 and ("b", "cells", "area_um2") not in at.index
    assert at.loc[("b", "SUGGESTION", "Min. nucleus size (px)"), "median"] == 10 and at.loc[("a", "SUGGESTION", "Min. nucleus size (µm²)"), "median"] == 2.5
    assert at.loc[("c", "SUGGESTION", "Typical cell area (µm²)"), "median"] == 2.5 and at.loc[("c", "cells", "fraction multi-nucleated"), "median"] == 1
    assert at.loc[("a", "SUGGESTION", "Min. cell size (µm²)"), "current_setting"] == 100  # a tenth of the typical cell area
    bins = diagnostics.histograms({"cells": cells, "nuclei": nuclei}, config.normalise({"size_units": "um"})).toPandas()
    assert bins[(bins.dataset == "ALL FILES") & (bins.object == "cells") & (bins.measure == "area")].n.sum() >= 2 and bins.log.any()


def test_a_run_counts_what_it_wrote_and_what_failed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ome = '<OME xmlns="x"><Image ID="Image:0" Name="B/01"><Pixels DimensionOrder="XYCZT" SizeC="2" SizeT="1" SizeZ="1" PhysicalSizeX="2" PhysicalSizeY="2"/></Image></OME>'
    whole = tiff.encode([a.astype("u2") for a in scene()], ome, compress=False)
    (source / "good.ome.tif").write_bytes(whole)
    (source / "bad.ome.tif").write_bytes(b"II*\0 no image")
    off = dict.fromkeys(("run_measurement", "run_aggregation", "run_analysis", "run_overview", "save_qc_plot", "merge_multinucleated"), False)
    cfg = {**SETTINGS, **off, "input_path": str(source), "output_root": str(tmp_path / "out"), "time_mode": "single"}
    assert pipeline.run(spark, cfg, 96) == "completed_with_1_errors"
    log = json.loads(next((tmp_path / "out" / "logs").glob("run_*.json")).read_text())
    counts = {s["stage"]: s["counts"] for s in log["stages"]}
    assert counts["segmentation"] == {"images": 1, "ok": 1, "skipped_sparse": 0, "nuclei": 9, "cells": 1, "multinucleated": 0}
    bad = pd.read_parquet(next((tmp_path / "out" / "logs").glob("*.errors.parquet")))
    assert len(bad) == 1 and bad.path[0].endswith("bad.ome.tif")
    store = pipeline.Store(spark, tmp_path / "out" / "per_file")
    (said,) = store.read("parameters").collect()
    assert said.dataset == "good" and said.scenes == ["B/01"] and json.loads(said.settings)["nuclei_sigma"] == 0.8
    where = config.layout(config.normalise(cfg))["size_statistics"]
    report = pd.concat(pd.read_csv(p) for p in where.glob("*.csv")) if where.is_dir() else pd.read_csv(where)
    assert {"ALL FILES", "good"} <= set(report.dataset) and "SUGGESTION" in set(report.object)
    (source / "bad.ome.tif").write_bytes(whole[: len(whole) - 9000])  # cut short
    cfg["overwrite_segmentation"] = False
    assert pipeline.run(spark, cfg, 96) == "completed_with_1_errors"
