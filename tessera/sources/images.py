"""Image files as tables: a Spark data source with one partition per file.

``spark.read.format("tessera_image").option("paths", ...)`` yields one row per plane.
Filters on scene, t, c and z remove planes before they are read; ``pixels=false`` reads
headers only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.functions import text
from tessera.operators.tiles import Tiles
from tessera.sources import planes

SCHEMA = planes.SCHEMA.replace(", scene_index int, error string", ", pixels binary")
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class ImageReader(DataSourceReader):
    """One partition per file: executors read the header, and then only the planes that the filters leave."""

    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.with_pixels = str(options.get("pixels", "true")).lower() == "true"
        self.skip_bad = str(options.get("skip_unreadable", "false")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("scene", "t", "c", "z"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                have = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if have is None else have & values
            else:
                yield f

    def partitions(self):
        return [File(p) for p in self.paths] or [File("")]

    def read(self, partition):
        if not partition.path:
            return
        try:
            rows = list(planes.plane_rows(partition.path))
        except Exception:
            if not self.skip_bad:
                raise
            return
        for row in rows:
            if all(row[k] in v for k, v in self.wanted.items()):
                pixels = None
                if self.with_pixels:
                    with planes.open_file(partition.path) as f:
                        plane = planes.read_region(f, row["store"], row["width"], 0, row["height"], 0, row["width"])
                    pixels = np.ascontiguousarray(plane, dtype="<f4").tobytes()
                yield tuple({**row, "pixels": pixels}.get(c) for c in COLUMNS)


class ImageSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_image"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ImageReader(self.options)


def read_planes(spark: SparkSession, paths: Sequence[str], pixels: bool = True, skip_unreadable: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
    return (
        spark.read.format("tessera_image").option("paths", json.dumps(list(paths)))
        .option("pixels", str(pixels).lower()).option("skip_unreadable", str(skip_unreadable).lower()).load()
    )


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name, length) of the visible files of a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    clean = F.regexp_replace("path", "^file:/*", "/")
    out = files.select(clean.alias("path"), "length").withColumn("name", text.base_name(F.col("path")))
    out = out.where(~F.col("name").startswith("."))
    if not recursive:
        depth = len(folder.rstrip("/").split("/"))
        out = out.where(F.size(F.split("path", "/")) == depth + 1)
    return out


def find_inputs(spark: SparkSession, cfg: dict) -> DataFrame:
    """(path, name, format): the input files of a run, filtered, sorted, sliced."""
    from pathlib import Path

    path = Path(cfg["input_path"])
    mode = cfg["input_mode"] if cfg["input_mode"] != "auto" else ("folder" if path.is_dir() else "file")
    if mode == "file":
        if not path.is_file():
            raise FileNotFoundError(f"input file not found: {path}")
        one = spark.createDataFrame([(str(path), path.name)], "path string, name string")
        return one.withColumn("format", text.format_of(F.col("name")))
    if not path.is_dir():
        raise NotADirectoryError(f"input folder not found: {path}")
    from tessera.plans.config import str_list

    keep = text.name_filter(
        F.col("name"), str_list(cfg["filename_include"]), str_list(cfg["filename_exclude"]),
        cfg["filter_use_regex"], cfg["filter_case_sensitive"],
    )
    files = list_files(spark, str(path), cfg["recursive"]).withColumn("format", text.format_of(F.col("name")))
    files = files.where((F.col("format") == cfg["file_format"]) & keep).select("path", "name", "format").orderBy("path")
    files = files.offset(int(cfg["skip_files"])) if cfg["skip_files"] else files
    return files.limit(int(cfg["max_files"])) if cfg["max_files"] else files


def untile(t: Tiles, layer: str) -> DataFrame:
    """(keys, height, width, layer): whole planes again, one image per group."""
    import pandas as pd
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    keys, size, dtype = list(t.keys), t.size, t.layers[layer]
    schema = StructType([t.df.schema[k] for k in keys] + [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField(layer, BinaryType())])

    def join(pdf):
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        a = np.zeros((h, w), dtype)
        for ty, tx, blob in zip(pdf["ty"], pdf["tx"], pdf[layer]):
            y, x = ty * size, tx * size
            part = np.frombuffer(blob, dtype).reshape(min(size, h - y), min(size, w - x))
            a[y: y + part.shape[0], x: x + part.shape[1]] = part
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "height": h, "width": w, layer: a.tobytes()}], columns=schema.fieldNames())

    return t.df.select(*keys, "ty", "tx", "height", "width", layer).groupBy(*keys).applyInPandas(join, schema)
