import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.plans import config as cf


def test_keys_and_defaults():
    d = cf.defaults()
    assert len(d) == 168
    assert d["well_regex"] == r"(?P<row>[A-Za-z]{1,2})/(?P<col>\d{1,2})(?:_|$)"
    assert d["dataset_regex"] == r"Plate(?P<plate>\d+)_Sample(?P<sample>\d+)(?:_(?P<rescan>\d+))?$"
    assert d["pixel_size_um"] is None and d["channel_names"] == "DNA, VE-Cadherin, ICAM1, PECAM1" and d["run_background"] is False


@pytest.mark.parametrize("text,want", [
    ("", list(range(12))), ("0-3", [0, 1, 2, 3]), ("0-10:5", [0, 5, 10]), ("-1", [11]), ("10-", [10, 11]), ("5, 0, 5", [0, 5]), ("20", []),
])
def test_timepoints(text, want):
    assert cf.timepoints(text, 12) == want


@pytest.mark.parametrize("text", ["a", "0-3:x", "0-3:0", "1-2-3"])
def test_bad_timepoints(text):
    with pytest.raises(ValueError):
        cf.timepoints(text, 12)


def test_old_pixel_settings_and_aliases():
    c = cf.normalise({"min_distance": 20, "multinuc_max_distance": 0, "edge_mode": "LoG", "nonsense": 1})
    assert c["size_units"] == "px" and c["multinuc_max_distance"] is None and c["edge_mode"] == "gradient" and "nonsense" not in c
    assert cf.normalise({"segment_objects": "nuclei_only", "seed_source": "junctions"})["seed_source"] == "nuclei"


def test_problems(tmp_path):
    ok = cf.normalise({"input_path": str(tmp_path), "output_root": str(tmp_path)})
    assert cf.problems(ok) == []
    for change in (
        {"input_path": ""}, {"input_path": "/nowhere"}, {"output_root": ""}, {"seg_mode": "3d"}, {"run_background": True},
        {"background_mode": "image"}, {"background_mode": "existing"}, {"nuclei_channel": 1}, {"typical_cell_area_um2": 0.0},
        {"min_distance": -1.0}, {"plate_map_path": "/nowhere"}, {"well_regex": "("}, {"filter_use_regex": True, "scene_include": "("},
        {"time_mode": "series", "timepoints": "x"}, {"time_mode": "series", "track_min_overlap": 0.0},
        {"background_mode": "image", "background_image_path": "/nowhere"},
        {"background_mode": "image", "background_image_path": str(tmp_path), "background_image_channel_map": "a"},
    ):
        assert len(cf.problems({**ok, **change})) == 1, change


def test_run_log_reproduces(tmp_path):
    c = cf.normalise({"output_root": str(tmp_path), "max_files": 3})
    p = os.path.join(tmp_path, "log.json")
    with open(p, "w") as f:
        json.dump({"config": c, "status": "completed"}, f)
    assert cf.load(p) == c
    assert "[Analysis]" in cf.as_text(c)


def test_sizes(spark):
    px = sizes.sizes_of(spark, {}, 0.5)
    assert px["min_distance"] == 7 and px["min_label_size"] == 400 and px["nuclei_sigma"] == 0.5 and px["boundary_band_px"] == 1
    count = sizes.confluent_count({}, F.lit(2000), F.lit(1000), F.lit(0.5))
    assert spark.range(1).select(count.alias("n")).first().n == 150
    with pytest.raises(sizes.MissingPixelSize):
        sizes.sizes_of(spark, {}, None)
    assert sizes.sizes_of(spark, {}, None, or_least=True)["min_distance"] == 1
    given = {"size_units": "px"} | {name: 3.4 for name in sizes.SIZES}
    assert sizes.sizes_of(spark, given, None)["min_distance"] == 3 and sizes.sizes_of(spark, given, None)["edge_sigma"] == 3.4


def test_settings_without_effect_are_refused(tmp_path):
    ok = cf.normalise({"input_path": str(tmp_path), "output_root": str(tmp_path)})
    for name in cf.WITHOUT_EFFECT:
        other = {str: "other", int: 7, bool: False}[type(ok[name])]
        assert len(cf.problems({**ok, name: other})) == 1, name


def test_every_other_setting_is_read_somewhere():
    package = Path(cf.__file__).parents[1]
    code = "".join(p.read_text() for p in package.rglob("*.py") if p.name != "config.py" and "llm" not in p.parts) + Path(cf.__file__).read_text().split("ALL = {")[1]
    unread = [name for name in cf.ALL if name not in cf.WITHOUT_EFFECT and f'"{name}"' not in code and f"{{{name}}}" not in code]
    assert unread == []


def test_pixel_settings_include_the_confluent_count():
    assert cf.normalise({"min_nuclei_confluent": 5})["size_units"] == "px"
    assert cf.problems(cf.normalise({"min_nuclei_confluent": -5, "input_path": "/", "output_root": "/"})) == ["min_nuclei_confluent cannot be negative"]
