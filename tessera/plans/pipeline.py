"""A complete run: discover, correct, segment, track, measure, combine, analyse.

Stages exchange parquet tables partitioned by dataset, so a stage can be repeated, and what
is finished is known from the tables themselves.  Image rows never pass the driver.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import platform
import sys
import time
import traceback
from collections.abc import Mapping, Sequence
from datetime import datetime
from pathlib import Path
from typing import Any
from urllib.parse import unquote

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import tessera
from tessera.functions import sizes, text
from tessera.operators import background, diagnostics, measure, summary, tables, tracking
from tessera.operators import segment as sg
from tessera.operators.tiles import Tiles
from tessera.plans import config
from tessera.render import pictures
from tessera.session import build_session, cut
from tessera.sources import images, planes, workbook
from tessera.sources.labels import write_labels

KEYS = ["dataset", "scene", "timepoint"]
#: Settings that switch a stage on, for the number of stages that a run announces.
STAGES = ("run_overview", "run_segmentation", "save_size_statistics", "run_measurement", "run_aggregation", "run_analysis")


class RunLog:
    """JSON record of a run, rewritten after every stage."""

    def __init__(self, folder: Path, cfg: Mapping[str, Any]):
        folder.mkdir(parents=True, exist_ok=True)
        self.planned = sum(bool(cfg.get(k)) for k in STAGES)
        self.path = folder / f"run_{datetime.now():%Y%m%d_%H%M%S}.json"
        self.data: dict[str, Any] = {
            "config": dict(cfg), "inputs": None, "errors": 0, "stages": [], "status": "running", "started": datetime.now().isoformat(),
            "environment": {"python": platform.python_version(), "spark": pyspark.__version__, "version": tessera.__version__},
        }
        self.write()

    def write(self) -> None:
        self.path.write_text(json.dumps(self.data, indent=2, default=str))
        self.path.with_suffix(".txt").write_text(
            f"status: {self.data['status']}\n\n" + config.as_text(self.data["config"])
            + "\n" + "\n".join(f"{s['stage']}: {s['status']} ({s['seconds']} s) {s.get('counts', '')}" for s in self.data["stages"]) + "\n"
        )

    def stage(self, name: str, fn, *args, go_on: bool = False):
        """Run a stage and record it; with ``go_on`` an error is counted and the run goes on."""
        begin = time.time()
        entry: dict[str, Any] = {"stage": name, "status": "ok"}
        try:
            result = fn(*args)
            entry["counts"] = result if isinstance(result, dict) else None
            return result
        except Exception as e:
            entry.update(status="error", message=str(e), trace=traceback.format_exc())
            if not go_on:
                raise
            self.data["errors"] += 1
        finally:
            entry["seconds"] = round(time.time() - begin, 2)
            self.data["stages"].append(entry)
            print(f"[PROGRESS] {name} {len(self.data['stages'])}/{max(self.planned, len(self.data['stages']))}", flush=True)
            self.write()

    def list_inputs(self, files: DataFrame) -> None:
        """All input files, as a table beside the log."""
        path = self.path.with_suffix(".inputs.parquet")
        files.write.mode("overwrite").parquet(str(path))
        self.data["inputs"] = str(path)
        self.write()

    def list_errors(self, files: DataFrame, n: int) -> None:
        """Input files that could not be read, as a table beside the log."""
        self.data["errors"] += n
        if n:
            files.write.mode("overwrite").parquet(str(self.path.with_suffix(".errors.parquet")))

    def finish(self) -> None:
        n = self.data["errors"]
        self.close(f"completed_with_{n}_errors" if n else "completed")

    def close(self, status: str) -> None:
        self.data["status"] = status
        self.data["finished"] = datetime.now().isoformat()
        self.write()


class Store:
    """The parquet tables of one output folder."""

    def __init__(self, spark: SparkSession, root: Path):
        self.spark, self.root = spark, root
        self.observed: dict[str, dict[str, int]] = {}
        # a dataset called 007 stays text
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")

    def path(self, name: str) -> str:
        return str(self.root / name)

    def _partitions(self, name: str) -> dict[str, Any]:
        """Dataset names and folders of a table, listed by the file system that holds the store."""
        jvm = self.spark.sparkContext._jvm
        below = jvm.org.apache.hadoop.fs.Path(self.path(name), "dataset=*")
        found = below.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(below)
        return {unquote(s.getPath().getName().partition("=")[2]): s.getPath() for s in found or ()}

    def has(self, name: str) -> bool:
        return bool(self._partitions(name))

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(name)) if self.has(name) else None

    def write(self, name: str, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Replace the partitions (datasets) that ``df`` contains and keep the others; files follow ``order``."""
        if order:
            df = df.repartitionByRange("dataset", *order).sortWithinPartitions("dataset", *order)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(self.path(name))
        return self.read(name)

    def counted(self, name: str, df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
        """``df`` written as a table of its own, with ``counts`` observed while it is written and added up under ``name``."""
        seen = Observation()
        out = cut(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
        before = self.observed.setdefault(name, dict.fromkeys(counts, 0))
        for n in counts:
            before[n] += seen.get.get(n) or 0
        return out

    def upsert(self, name: str, new: DataFrame, done: DataFrame, order: Sequence[str] = (), counts: Mapping[str, Column] | None = None) -> DataFrame:
        """Rows of finished scenes replace their old rows; done before the old table is touched.  ``counts`` are observed over the new rows."""
        new = self.counted(name, new, counts) if counts else new
        old = self.read(name)
        if old is None:
            return self.write(name, new, order)
        touched = old.join(done.select("dataset").distinct(), "dataset", "left_semi")
        keys = done.select(*KEYS)
        merged = tables.upsert(touched, new, KEYS, keys)
        merged = cut(merged)
        # a dataset without rows is no partition of the result, so nothing would replace its old rows
        emptied = {r.dataset for r in done.select("dataset").distinct().join(merged, "dataset", "left_anti").collect()}
        self.write(name, merged, order)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for dataset, folder in self._partitions(name).items():
            if dataset in emptied:
                folder.getFileSystem(conf).delete(folder, True)
        self.spark.catalog.refreshByPath(self.path(name))
        return self.read(name)


def discover(spark: SparkSession, cfg: Mapping[str, Any], log: RunLog | None = None) -> DataFrame:
    """One row per image: dataset, file, path, scene, timepoint, geometry and metadata; unreadable files go to the log."""
    files = images.find_inputs(spark, cfg)
    stems = tables.disambiguate_stems(files.withColumn("stem", text.file_stem(F.col("name"))))
    seen = Observation()
    heads = cut(planes.headers(files, skip_unreadable=True).observe(seen, F.count("error").alias("unreadable")))
    if log is not None:
        log.list_errors(heads.where("error is not null").select("path", "error"), seen.get.get("unreadable") or 0)
    heads = heads.where("error is null")
    per_scene = heads.groupBy("path", "scene", "n_t").agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.max("n_c").alias("n_c"), F.max("n_z").alias("n_z"),
        F.max("pixel_size_um").alias("pixel_size_um"), F.max("frame_interval_min").alias("frame_interval_min"),
    )
    # the scenes of one file are a short list; their order in the file is kept by name
    ds = per_scene.groupBy("path").agg(F.sort_array(F.collect_list("scene")).alias("scenes"))
    ds = tables.filter_scenes(
        ds, config.str_list(cfg["scene_include"]), config.str_list(cfg["scene_exclude"]), cfg["filter_use_regex"],
        cfg["filter_case_sensitive"], cfg["scene_filter_single_scene_files"], int(cfg["max_scenes_per_file"]),
    )
    jobs = ds.withColumn("scene", F.explode("scenes")).join(per_scene, ["path", "scene"]).join(
        stems.select("path", F.col("stem").alias("dataset"), F.col("name").alias("file")), "path"
    )
    if cfg["time_mode"] == "series":
        most = jobs.agg(F.max("n_t")).first()[0] or 0
        wanted = {n: config.timepoints(cfg["timepoints"], n) for n in range(1, most + 1)} if cfg["timepoints"] else None
        frames = F.sequence(F.lit(0), F.col("n_t") - 1)
        if wanted:
            picks = spark.createDataFrame([(n, t) for n, ts in wanted.items() for t in ts], "n_t int, timepoint int")
            jobs = jobs.join(picks, "n_t")
        else:
            jobs = jobs.withColumn("timepoint", F.explode(frames))
    else:
        jobs = jobs.withColumn("timepoint", F.lit(int(cfg["timepoint"])))
    ps = F.coalesce(F.lit(cfg["pixel_size_um"]).cast("double"), F.col("pixel_size_um"))
    every = F.coalesce(F.lit(cfg["frame_interval_min"]).cast("double"), F.col("frame_interval_min"))
    return jobs.withColumn("pixel_size_um", ps).withColumn("frame_interval_min", every).drop("scenes", "n_scenes_total")


def parameters(jobs: DataFrame, cfg: Mapping[str, Any], run_id: str) -> DataFrame:
    """(dataset, run_id, version, file, path, scenes, settings): what every dataset was made with; settings as JSON."""
    scenes = F.sort_array(F.collect_set("scene")).alias("scenes")  # of one file
    found = jobs.groupBy("dataset", "file", "path").agg(scenes)
    said = json.dumps(dict(cfg), default=str, sort_keys=True)
    return found.select("dataset", F.lit(run_id).alias("run_id"), F.lit(tessera.__version__).alias("version"), "file", "path", "scenes", F.lit(said).alias("settings"))


def load_tiles(spark: SparkSession, jobs: DataFrame, channels: list[int], z: str, size: int, slices: bool = False) -> Tiles:
    """Tiles of the wanted channels of the jobs, with ``pixel_size_um`` per image; with ``slices``, every z slice is an image."""
    keys = [*KEYS, "z"] if slices else KEYS
    heads = planes.headers(jobs.select("path").distinct()).where(F.col("c").isin(channels)).drop("pixel_size_um")
    look = jobs.select("path", "scene", F.col("timepoint").alias("t"), "dataset", "pixel_size_um")
    found = heads.join(look, ["path", "scene", "t"]).withColumnRenamed("t", "timepoint")
    return dataclasses.replace(planes.read_tiles(found, [*keys, "pixel_size_um"], channels, size, z), keys=tuple(keys))


def correction_fields(spark: SparkSession, cfg: Mapping[str, Any], jobs: DataFrame, store: Store, size: int) -> dict[int, tuple[DataFrame, list[str]]]:
    """Per channel: fields and the keys they apply to."""
    import numpy as np

    mode = cfg["background_mode"]
    out: dict[int, tuple[DataFrame, list[str]]] = {}
    schema = "operation string, height int, width int, field binary, dark binary, offset double"

    def from_file(path: str):
        p = Path(path)
        side = p.with_suffix(".json")
        meta = json.loads(side.read_text()) if side.exists() else {}
        a = np.load(p).astype("f8")
        dark = np.load(p.parent / meta["dark"]).astype("f8") if meta.get("dark") else None
        row = (meta.get("operation", "divide"), *a.shape, bytearray(a.tobytes()), None if dark is None else bytearray(dark.tobytes()), meta.get("offset"))
        return spark.createDataFrame([row], schema)

    if mode == "existing":
        return {c: (from_file(p), []) for c, p in config.channel_paths(cfg["existing_background_paths"]).items()}
    if mode in ("per_file", "pooled"):
        channels = config.int_list(cfg["background_channels"])
        group = ["dataset"] if mode == "per_file" else []
        picked = jobs
        if cfg["background_max_scenes"]:
            picked = tables.evenly_spaced(jobs, ["dataset", "scene", "timepoint"], int(cfg["background_max_scenes"]))
        for c in channels:
            name = f"{cfg['background_subdir']}_c{c}"
            if cfg["overwrite_background"] or not store.has(name):
                t = load_tiles(spark, picked, [c], cfg["background_z_projection"], size)
                fields = background.field_images(t, f"c{c}", group, int(cfg["background_downsample"]), float(cfg["background_smooth_sigma"]))
                fields = background.as_fields(fields)
                store.write(name, fields if group else fields.withColumn("dataset", F.lit("pooled")))
            got = store.read(name)
            out[c] = (got if group else got.drop("dataset"), group)
    if mode == "image":
        mapping = config.channel_map(cfg["background_image_channel_map"])
        for c in config.int_list(cfg["background_channels"]):
            means = _reference_mean(spark, cfg["background_image_path"], mapping.get(c, c), cfg, size)
            if cfg["background_dark_path"]:
                dark = _reference_mean(spark, cfg["background_dark_path"], mapping.get(c, c), cfg, size)
                means = means.join(dark.select("channel", F.col("mean").alias("dark")), "channel")
            else:
                means = means.withColumn("dark", F.lit(None).cast("binary"))
            fields = background.reference_fields(means, cfg["background_image_type"], float(cfg["background_smooth_sigma"]), float(cfg["background_offset"]))
            out[c] = (fields.drop("channel"), [])
    return out


def _reference_mean(spark, path, channel, cfg, size) -> DataFrame:
    heads = planes.headers(spark.createDataFrame([(path,)], "path string")).where("t = 0")
    include = config.str_list(cfg["background_image_scenes"])
    if include:
        heads = heads.where(text.name_filter(F.col("scene"), include))
    t = planes.read_tiles(heads, ["path", "scene", "t"], [channel], size, cfg["background_z_projection"])
    mean = background.field_images(t, f"c{channel}", [], int(cfg["background_downsample"]), 0.0)
    return mean.select(F.lit(channel).alias("channel"), "height", "width", F.col("field").alias("mean"))


def check_reference(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """(file, level, message) for every input compared with the reference image."""
    files = images.find_inputs(spark, cfg)

    def facts(df):
        names = F.array_sort(F.collect_set(F.struct("c", "channel_name")))
        return df.groupBy("path").agg(
            F.max("magnification").alias("magnification"), F.max("numerical_aperture").alias("na"), F.max("objective_name").alias("objective"),
            F.max("pixel_size_um").alias("pixel_size"), F.max("height").alias("height"), F.max("width").alias("width"),
            F.transform(names, lambda s: s["channel_name"]).alias("channel_names"),
        )

    got = facts(planes.headers(files, skip_unreadable=True).where("error is null"))
    ref = facts(planes.headers(spark.createDataFrame([(cfg["background_image_path"],)], "path string"))).drop("path")
    both = got.crossJoin(F.broadcast(ref.select(*[F.col(c).alias(f"r_{c}") for c in ref.columns])))  # one row
    ref_side = {c: F.col(f"r_{c}") for c in ref.columns}
    notes = background.acquisition_messages(ref_side, {c: F.col(c) for c in ref.columns})
    ok = F.array(F.struct(F.lit("ok").alias("level"), F.lit("fits").alias("message")))
    return both.select(text.base_name(F.col("path")).alias("file"), F.explode(F.when(F.size(notes) > 0, notes).otherwise(ok)).alias("n")).select(
        "file", "n.level", "n.message"
    )


def segmented_counts(columns: Sequence[str]) -> dict[str, Column]:
    """Counters of the images segmented in a run, observed while their summary is written."""
    out = {"images": F.count(F.lit(1)), **{s: F.count_if(F.col("status") == s) for s in ("ok", "skipped_sparse")}}
    return out | {name: F.sum(f"n_{name}") for name in ("nuclei", "cells", "multinucleated") if f"n_{name}" in columns}


def segment_stage(spark: SparkSession, cfg: Mapping[str, Any], jobs: DataFrame, store: Store, fields, size: int) -> dict[str, int]:
    """Segment all pending images; images of the same pixel size share one plan."""
    done = store.read("segmentation_summary")
    todo = jobs if done is None else tables.pending_jobs(jobs, done.where("status = 'ok'"), KEYS, cfg["overwrite_segmentation"])
    scales = [r[0] for r in todo.select("pixel_size_um").distinct().collect()]
    nuclei_only, junctions = cfg["segment_objects"] == "nuclei_only", cfg["seed_source"] == "junctions"
    per_slice = cfg["seg_mode"] == "per_slice"
    n_ch, e_ch = int(cfg["nuclei_channel"]), int(cfg["edge_channel"])
    channels = [n_ch] if nuclei_only else [e_ch] if junctions else [n_ch, e_ch]
    for ps in scales:
        part = todo.where(F.col("pixel_size_um").eqNullSafe(F.lit(ps).cast("double")))
        p = {**cfg, **sizes.sizes_of(spark, cfg, ps)}
        p["min_nuclei_confluent"] = sizes.confluent_count(cfg, F.col("height"), F.col("width"), F.lit(ps).cast("double"))
        t = load_tiles(spark, part, channels, "max", size, per_slice)
        t = t._with(t.df.drop("pixel_size_um"), t.layers)
        if cfg["correct_in_segmentation"]:
            for c in channels:
                if c in fields:
                    t = background.correct(t, f"c{c}", *fields[c])
        t = t.cut()
        got = sg.segment_cells(t, None if junctions else f"c{n_ch}", f"c{e_ch}", p)
        if per_slice:
            got = sg.stack_slices(got, "z")
        keep = [n for n in ("nuclei_mask", "nuclei", "cells") if n in got["tiles"].layers]
        made = got["tiles"].select(*keep)
        scene = part.select(*KEYS, "file", "pixel_size_um").withColumn("seed_source", F.lit(cfg["seed_source"])).withColumn(
            "scene_stem", text.scene_stem(F.col("dataset"), F.col("scene"), F.col("timepoint"))
        )
        used = {f"used_{k_}" + ("" if k_.endswith("_px") else "_px"): F.lit(float(p[k_])) for k_ in sizes.SIZES}
        summary_ = got["summary"].join(scene, KEYS).withColumns(used)
        ids = part.select(*KEYS)
        stem = text.scene_stem(F.col("dataset"), F.col("scene"), F.col("timepoint") if cfg["time_mode"] == "series" else None)
        folder = store.root / cfg["segmentation_subdir"]
        for layer in keep:
            if layer != "nuclei_mask" or cfg["save_nuclei_mask"]:
                ending = {"nuclei": "_nuclei_labels", "cells": "_cell_labels", "nuclei_mask": "_nuclei_mask"}[layer]
                replaced = {"nuclei": ["_cell_labels.tif"] if nuclei_only else [], "cells": ["_nuclei_labels.tif", "_nuclei_mask.tif"] if junctions else []}
                write_labels(made, layer, str(folder), stem, f"{ending}.tif", "z" if per_slice else None, layer == "nuclei_mask", replaced.get(layer, []))
        if cfg["save_qc_plot"] and not per_slice:
            pictures.quality(
                got["tiles"], None if junctions else f"c{n_ch}", None if nuclei_only else f"c{e_ch}", "nuclei" if nuclei_only else "cells",
                str(store.root / cfg["qc_subdir"]),
            ).write.format("noop").mode("overwrite").save()
        store.upsert("label_slices" if per_slice else "labels", made.df, ids)
        store.upsert("segmentation_summary", summary_, ids, counts=segmented_counts(summary_.columns))
        metric = F.lit(ps).cast("double")
        for name, df in (("nucleus_statistics", got["nuclei"]), ("cell_statistics", got["cells"]), ("raw_object_areas", got["raw_areas"]),
                         ("cell_adjacency", got["adjacency"])):
            if df is not None and (name != "cell_adjacency" or cfg["save_adjacency"]):
                store.upsert(name, sizes.with_metric_columns(df.withColumn("pixel_size_um", metric), metric), ids)
    return store.observed.get("segmentation_summary", {"images": 0})


def stored_tiles(store: Store, size: int) -> Tiles:
    df = store.read("labels")
    dtypes = {"nuclei_mask": "u1", "nuclei": sg.LABEL, "cells": sg.LABEL}
    layers = {n: d for n, d in dtypes.items() if n in df.columns}
    top = df.agg(F.max("height"), F.max("width")).first()
    return Tiles(df.select(*KEYS, "ty", "tx", "height", "width", *layers), tuple(KEYS), size, layers, top[0] is not None and max(top) <= size)


def track_stage(cfg: Mapping[str, Any], store: Store, size: int) -> dict[str, int]:
    t = stored_tiles(store, size)
    layer = "nuclei" if cfg["segment_objects"] == "nuclei_only" else "cells"
    frames = t.df.select(*KEYS).distinct().withColumn("frame_index", F.col("timepoint").cast("bigint"))
    tracks = tracking.track_tiles(
        t.select(layer), layer, "timepoint", float(cfg["track_min_overlap"]), int(cfg["track_max_gap"]), cfg["track_divisions"],
        float(cfg["track_split_fraction"]), frames,
    )
    tracks = store.write("tracks", tracks)
    store.write("track_summary", tracking.track_summary(tracks, ["dataset", "scene"]))
    if cfg["save_tracked_labels"]:
        moved = tracking.tracked_movie(t.select(layer), layer, tracks)
        clean = F.regexp_replace(F.concat_ws("_", "dataset", "scene"), r'[\\/:*?"<>|]', "_")
        write_labels(moved, layer, str(store.root / cfg["tracking_subdir"]), clean, "_tracked_labels.tif", "timepoint")
    return {"tracks": store.read("track_summary").count()}


def measure_stage(spark: SparkSession, cfg: Mapping[str, Any], jobs: DataFrame, store: Store, fields, size: int) -> dict[str, int]:
    labels = stored_tiles(store, size)
    have = jobs.join(labels.df.select(*KEYS).distinct(), KEYS, "left_semi")
    old = store.read("cell_measurements")
    if old is not None:
        have = tables.pending_jobs(have, old, KEYS, cfg["overwrite_measurement"])
    n = have.agg(F.max("n_c")).first()[0]
    if not n:
        return {"measured": 0}
    names = measure.unique_names(config.str_list(cfg["channel_names"]), n)
    channels = list(range(n))
    nuclei_only = cfg["segment_objects"] == "nuclei_only"
    for ps in [r[0] for r in have.select("pixel_size_um").distinct().collect()]:
        part = have.where(F.col("pixel_size_um").eqNullSafe(F.lit(ps).cast("double")))
        band = int(sizes.sizes_of(spark, cfg, ps, or_least=True)["boundary_band_px"])
        t = load_tiles(spark, part, channels, "max", size)
        if cfg["correct_in_measurement"]:
            for c in channels:
                if c in fields:
                    t = background.correct(t, f"c{c}", *fields[c])
        t = t.join(labels).cut()
        layers = [f"c{c}" for c in channels]
        scenes = store.read("segmentation_summary")
        if nuclei_only:
            um = (lambda v: v / ps) if ps else (lambda v: v)
            got = measure.measure_nuclei(t, names, layers, um(float(cfg["nuc_ring_gap_um"])), um(float(cfg["nuc_ring_width_um"])))
        else:
            got = measure.measure_cells(
                t, names, layers, config.int_list(cfg["edge_channels"]), "cells",
                "nuclei" if cfg["measure_nuclei"] and "nuclei" in t.layers else None,
                store.read("cell_adjacency"), store.read("cell_statistics").select(*KEYS, "label", "n_nuclei"),
                cfg["seed_source"] == "junctions", band,
                float(cfg["ruggedness_smooth_frac"]), float(cfg["ruggedness_min_sigma"]),
            )
        out = measure.add_scene_columns(got, part.select(*KEYS, "file", "frame_interval_min"), KEYS, cfg, scenes)
        if cfg["time_mode"] == "series" and store.has("tracks"):
            out = tracking.add_tracks(out, store.read("tracks"), store.read("track_summary"), ["dataset", "scene"])
        store.upsert("cell_measurements", out, part.select(*KEYS), ["scene", "timepoint", "cell_id"], {"measured": F.count(F.lit(1))})
        if cfg["save_pickle"] and not nuclei_only:
            edge = {names[c]: f"c{c}" for c in config.int_list(cfg["edge_channels"]) if c < n}
            if edge:
                store.upsert("boundary_intensities", measure.boundary_arrays(t, "cells", edge, band), part.select(*KEYS))
    return store.observed.get("cell_measurements", {"measured": 0})


def aggregate(spark: SparkSession, cfg: Mapping[str, Any], measurements: DataFrame) -> DataFrame:
    """All measurements with provenance, plate-map metadata, control flag and z-scores.

    ``measurements`` has a ``dataset`` column; the newest rescan of each sample is kept.
    """
    treat = cfg["treatment_column"]
    names = measurements.select("dataset").distinct()
    parsed = text.parse_dataset(F.col("dataset"), cfg["dataset_regex"])
    scans = names.select(*[c.alias(n) for n, c in parsed.items()], "dataset", F.col("dataset").alias("discovery_index"))
    scans = tables.latest_rescans(scans) if cfg["keep_latest_rescan"] else scans
    df = measurements.join(
        scans.select("dataset", F.col("plate").alias("plate_num"), F.col("sample").alias("sample_num"), F.col("rescan").alias("rescan_num")),
        "dataset",
    )
    if "well_id" not in df.columns:
        df = df.withColumn("well_id", F.lit(None).cast("string"))
    if cfg["exclude_nonconfluent"] and "scene_confluent" in df.columns:
        df = df.where(text.not_nonconfluent(F.col("scene_confluent")))
    meta: list[str] = []
    if cfg["plate_map_path"]:
        pm = workbook.load_plate_map(
            spark, cfg["plate_map_path"], cfg["plate_map_sheet"], cfg["compound_sheet"] or None, config.str_list(cfg["compound_columns"]),
            cfg["plate_column"], treat,
        )
        meta = [treat] + [c for c in config.str_list(cfg["compound_columns"]) if c in pm.columns]
        df = tables.add_plate_metadata(df, pm, meta, cfg["plate_column"])
    is_float = treat in df.columns and df.schema[treat].dataType.typeName() in ("double", "float")
    flag = tables.control_flag(
        F.col(f"`{treat}`") if treat in df.columns else None, F.col("well_id"), config.str_list(cfg["control_treatments"]),
        config.str_list(cfg["control_wells"]), is_float,
    )
    df = df.withColumn("is_control", flag)
    ref = {"dataset": ["dataset"], "plate": ["plate_num"], "all": []}[cfg["zscore_reference"]]
    df = tables.zscores(df, config.str_list(cfg["zscore_columns"]), ref)
    front = ["plate_num", "sample_num", "rescan_num"]
    rest = [c for c in df.columns if c not in (*front, "dataset")]
    return df.select(*front, F.col("dataset").alias("source_dataset"), F.concat("dataset", F.lit("_cell_measurements")).alias("source_file"),
                     "dataset", *[F.col(f"`{c}`") for c in rest])


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "parquet" or path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def pick_group(df: DataFrame) -> str | None:
    """The first usable grouping column."""
    names = [c for c in ("Treatment", "well_id", "source_dataset", "dataset", "file") if c in df.columns]
    if not names:
        return None
    known = df.agg(*[F.bool_or(F.lower(F.col(c).cast("string")) != "nan").alias(c) for c in names]).first()
    return next((c for c in names if known[c]), None)


def analyse(spark: SparkSession, cfg: Mapping[str, Any], df: DataFrame, out: Path) -> dict[str, int]:
    """Statistics, plot tables, figures and the index page."""
    from tessera.render import figures

    if "source_dataset" not in df.columns:
        df = df.withColumn("source_dataset", F.col("dataset"))
    if cfg["analysis_exclude_nonconfluent"] and "scene_confluent" in df.columns:
        df = df.where(text.not_nonconfluent(F.col("scene_confluent")))
    if "is_control" in df.columns:
        df = df.withColumn("is_control", text.truthy(F.col("is_control")))
    else:
        df = df.withColumn("is_control", F.lit(False))
    skip = ["plate_num", "sample_num", "rescan_num", "cell_id", "timepoint", "time_min", "track_id", "parent_track_id", "track_n_frames"]
    columns = text.matching_columns(df, config.str_list(cfg["plot_columns"]), skip)
    if not columns:
        return {"columns": 0}
    groups = [pick_group(df) if g.lower() == "auto" else g for g in config.str_list(cfg["group_by"])]
    groups = [g for g in dict.fromkeys(groups) if g in df.columns]
    well = F.col("well_id") if "well_id" in df.columns else None
    df = df.withColumn("__replicate", summary.replicate_key(cfg["replicate_level"], F.col("source_dataset"), F.col("scene"), well))
    keep = [c for c in dict.fromkeys([*groups, cfg["label_column"], "plate_num", "sample_num", "source_dataset", "well_row", "well_column",
                                      "well_id", "timepoint", "time_min", "cell_id", "scene", "is_control", "__replicate", *columns]) if c in df.columns]
    df = cut(df.select(*[F.col(f"`{c}`") for c in keep]))
    book = figures.Book(out, cfg)
    for g in groups:
        is_float = df.schema[g].dataType.typeName() in ("double", "float")
        d = df.withColumn("__g", text.group_value(F.col(f"`{g}`"), is_float)).where("__g is not null")
        large = summary.keep_large_groups(d, "__g", int(cfg["min_cells_per_group"]))
        order = summary.order_groups(large, "__g", cfg["sort_groups"], cfg["controls_first"], columns[0], "__replicate")
        label = cfg["label_column"]
        if label in df.columns and label != g:
            first = tables.first_known(large.withColumnRenamed(label, "__lab"), ["__g"], "__lab", ["__replicate"])
            order = order.join(first, "__g", "left").withColumn("label", text.display_label(F.col("__g"), F.col("__lab"))).drop("__lab")
        else:
            order = order.withColumn("label", F.col("__g"))
        order = cut(order)
        if cfg["compute_stats"]:
            stats = summary.summarise(d, "__g", columns, "__replicate", min_cells=int(cfg["min_cells_per_group"]))
            stats = stats.withColumn("group_by", F.lit(g)).join(order.select(F.col("__g").alias("group"), "label"), "group", "left")
            named = ["group_by", "group", "label", *[c for c in stats.columns if c not in ("group_by", "group", "label")]]
            write_table(stats.select(*named), str(out / f"summary_statistics_by_{g}.csv"), "csv")
        book.by_group(g, large, order, columns)
        if cfg["plot_overview"]:
            book.shift_matrix(g, summary.robust_shift(large, "__g", columns), order)
        if "timepoint" in df.columns and cfg["time_mode"] == "series":
            use_min = "time_min" in df.columns and not df.where("time_min is null").limit(1).count()
            book.time_courses(g, summary.time_course(large, "__g", columns, "time_min" if use_min else "timepoint"), order)
    if cfg["plot_plate_heatmap"] and {"well_row", "well_column"} <= set(df.columns):
        book.plates(summary.plate_medians(df.where("well_row is not null and well_column is not null"), columns))
    if cfg["make_html_index"]:
        book.index()
    return {"columns": len(columns), "figures": len(book.made)}


def overview_stage(spark: SparkSession, cfg: Mapping[str, Any], jobs: DataFrame, store: Store, size: int) -> dict[str, int]:
    first = jobs.where(F.col("timepoint") == int(cfg["timepoint"]))
    if cfg["overview_max_scenes"]:
        first = tables.evenly_spaced(first, ["dataset", "scene"], int(cfg["overview_max_scenes"]))
    n = first.agg(F.max("n_c")).first()[0] or 0
    channels = config.int_list(cfg["overview_channels"]) or list(range(n))
    t = load_tiles(spark, first, channels, "max", size)
    made = pictures.overviews(t, [f"c{c}" for c in channels], cfg, str(store.root / cfg["overview_subdir"]))
    return {"pictures": made.count()}


def size_stage(cfg: Mapping[str, Any], store: Store, out: Path) -> dict[str, int]:
    """Sizes of all objects per dataset and for all files: one CSV report with suggestions, and histograms as a table beside it."""
    found = {n: df for n, t in (("nuclei", "nucleus_statistics"), ("cells", "cell_statistics"), ("raw", "raw_object_areas")) if (df := store.read(t)) is not None}
    if not found:
        return {}
    write_table(diagnostics.report(found, cfg), str(out), "csv")
    write_table(diagnostics.histograms(found, cfg), str(out) + "_histograms.parquet", "parquet")
    return {"tables": len(found)}


def found_measurements(spark: SparkSession, cfg: Mapping[str, Any], root: Path) -> DataFrame:
    """Measurements of a run's tables, or of result folders with one table per dataset."""
    if Store(spark, root).has("cell_measurements"):
        return tables.nan_to_null(spark.read.parquet(str(root / "cell_measurements")))
    scans = workbook.find_scans(spark, str(root), cfg["dataset_regex"], cfg["measurements_subdir"], cfg["datasets_subdir"], cfg["keep_latest_rescan"])
    return workbook.read_scans(spark, scans)


def run(spark: SparkSession, settings: Mapping[str, Any], tile: int = 1024) -> str:
    """A complete run; returns its status."""
    cfg = config.normalise(settings)
    bad = config.problems(cfg)
    if bad:
        raise ValueError("nothing was run: " + "; ".join(bad))
    where = config.layout(cfg)
    log = RunLog(where["logs"], cfg)
    store = Store(spark, where["datasets"])
    fields: dict = {}
    try:
        jobs = None
        if cfg["run_background"] or cfg["run_segmentation"] or cfg["run_measurement"] or cfg["run_overview"]:
            jobs = cut(discover(spark, cfg, log))
            log.list_inputs(jobs.groupBy("dataset", "file").agg(F.count(F.lit(1)).alias("images")))
            if cfg["write_dataset_params"]:
                store.write("parameters", parameters(jobs, cfg, log.path.stem))
        if cfg["run_overview"]:
            log.stage("overview", overview_stage, spark, cfg, jobs, store, tile)
        if cfg["background_mode"] == "image" and cfg["background_metadata_check"] != "off":
            notes = log.stage("reference check", lambda: {"errors": check_reference(spark, cfg).where("level = 'error'").count()})
            if notes["errors"] and cfg["background_metadata_check"] == "stop":
                raise RuntimeError("the reference image does not fit the input images")
        if cfg["background_mode"] != "none" and jobs is not None:
            fields = correction_fields(spark, cfg, jobs, store, tile)
        if cfg["run_segmentation"]:
            log.stage("segmentation", segment_stage, spark, cfg, jobs, store, fields, tile)
            if cfg["save_size_statistics"]:
                log.stage("size statistics", size_stage, cfg, store, where["size_statistics"])
        if cfg["time_mode"] == "series" and cfg["track_cells"] and cfg["seg_mode"] == "mip" and store.has("labels"):
            log.stage("tracking", track_stage, cfg, store, tile)
        if cfg["run_measurement"]:
            log.stage("measurement", measure_stage, spark, cfg, jobs, store, fields, tile)
        if cfg["run_aggregation"]:
            root = Path(cfg["aggregation_input_dir"]) if cfg["aggregation_input_dir"] else where["datasets"]
            table = aggregate(spark, cfg, found_measurements(spark, cfg, root))
            log.stage("aggregation", lambda: write_table(table, str(where["aggregated"]), cfg["aggregation_format"]))
        if cfg["run_analysis"]:
            path = cfg["analysis_input_path"] or str(where["aggregated"])
            fmt_parquet = path.endswith(".parquet")
            df = tables.nan_to_null(spark.read.parquet(path)) if fmt_parquet else workbook.typed(spark.read.csv(path, header=True))
            where["plots"].mkdir(parents=True, exist_ok=True)
            log.stage("analysis", analyse, spark, cfg, df, where["plots"], go_on=True)
        log.finish()
    except KeyboardInterrupt:
        log.close("stopped")
        raise
    except Exception:
        log.close("failed")
        raise
    return log.data["status"]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    ap.add_argument("--config", help="settings JSON or the log of an earlier run")
    ap.add_argument("--input")
    ap.add_argument("--output")
    ap.add_argument("--format")
    ap.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    ap.add_argument("--tile", type=int, default=1024, help="tile side in pixels")
    args = ap.parse_args(argv)
    cfg = config.load(args.config) if args.config else config.defaults()
    for key, value in (("input_path", args.input), ("output_root", args.output), ("file_format", args.format)):
        if value:
            cfg[key] = value
    for part in args.set:
        key, _, value = part.partition("=")
        cfg[key] = config.coerce(key, value)
    bad = config.problems(cfg)
    if bad:
        print("\n".join(bad), file=sys.stderr)
        return 2
    print(run(build_session(), cfg, args.tile))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
