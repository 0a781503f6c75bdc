"""Excel sheets (plate maps) and result folders as DataFrames."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import tables

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
    return [s.get("name") for s in book.iter(f"{_MAIN}sheet")]


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet; the first row names the columns.  Numeric columns are doubles, others text.

    A plate map has one row per well, so the sheet is read on the driver.
    """
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in rels}
        ref = next((s.get(f"{_REL}id") for s in book.iter(f"{_MAIN}sheet") if s.get("name") == sheet), None)
        if ref is None:
            raise KeyError(f"{path} has no sheet '{sheet}'")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        name = target[ref].lstrip("/")
        body = ET.fromstring(z.read(name if name.startswith("xl/") else f"xl/{name}"))
    grid = []
    for row in body.iter(f"{_MAIN}row"):
        cells: dict[int, object] = {}
        for i, c in enumerate(row.iter(f"{_MAIN}c")):
            ref = c.get("r")
            at = i
            if ref:
                at = 0
                for ch in re.match(r"[A-Z]+", ref).group():
                    at = at * 26 + ord(ch) - 64
                at -= 1
            v, kind = c.find(f"{_MAIN}v"), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "b", "e") else float(v.text)
        grid.append(cells)
    grid = [g for g in grid if g]
    columns = {i: str(n) for i, n in grid[0].items()}
    numeric = {i for i in columns if all(isinstance(g.get(i, 0.0), float) for g in grid[1:])}
    rows = []
    for g in grid[1:]:
        row = []
        for i in columns:
            v = g.get(i)
            if v is not None and i not in numeric:
                v = str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
            row.append(v)
        rows.append(tuple(row))
    schema = ", ".join(f"`{n}` {'double' if i in numeric else 'string'}" for i, n in columns.items())
    return spark.createDataFrame(rows, schema)


def load_plate_map(
    spark: SparkSession, path: str, sheet: str = "Treatment_Map", compound_sheet: str | None = "Compound_IDs",
    compound_columns: Sequence[str] = ("Source Name", "Class/Target"), plate: str = "Plate", treatment: str = "Treatment",
) -> DataFrame:
    """Plate map from an Excel file, or from a CSV file without compounds."""
    if path.lower().endswith(".csv"):
        return tables.build_plate_map(spark.read.csv(path, header=True), None, plate, treatment)
    plates = read_sheet(spark, path, sheet)
    comp = None
    if compound_sheet and compound_sheet in sheet_names(path):
        comp = read_sheet(spark, path, compound_sheet)
    elif compound_sheet:
        print(f"plate map has no sheet '{compound_sheet}'; compound information not added")
    return tables.build_plate_map(plates, comp, plate, treatment, compound_columns)


def find_scans(
    spark: SparkSession, root: str, pattern: str, measurements: str = "measurements", datasets: str = "per_file",
    keep_latest: bool = True,
) -> DataFrame:
    """(plate, sample, rescan, dataset, path, discovery_index): measurement tables below a folder.

    ``<root>/<datasets>/*`` comes before ``<root>/*``; the first folder of a name counts.
    """
    form = r"^(.*/([^/]+)/" + re.escape(measurements) + r"/([^/]+_cell_measurements(?:\.csv|\.parquet)?))(?:/.*)?$"
    listed = None
    for layout, glob in enumerate((f"{root}/{datasets}/*/{measurements}", f"{root}/*/{measurements}")):
        try:  # names and sizes only, listed by the file system that holds the results
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path")
        except AnalysisException:
            continue  # no folder of this layout
        table = F.regexp_extract("path", form, 1)
        one = files.select(F.lit(layout).alias("layout"), F.regexp_extract("path", form, 2).alias("dataset"), F.regexp_replace(table, "^file:/*", "/").alias("path"))
        one = one.where((F.col("path") != "") & ~text.base_name(F.col("path")).startswith("._"))
        listed = one if listed is None else listed.unionByName(one)
    if listed is None:
        listed = spark.createDataFrame([], "layout int, dataset string, path string")
    scans = tables.discovered(listed)
    parsed = text.parse_dataset(F.col("dataset"), pattern)
    scans = scans.select(*[c.alias(n) for n, c in parsed.items()], "dataset", "path", "discovery_index")
    return tables.latest_rescans(scans) if keep_latest else scans


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV or parquet result table with NaN as NULL; only the wanted columns are read.

    CSV columns are text; numeric ones are recognised by name in ``typed``.
    """
    if path.endswith(".parquet") or Path(path).is_dir():
        df = spark.read.parquet(path)
    else:
        df = typed(spark.read.csv(path, header=True, nullValue="", nanValue="nan"))
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(columns)])
    return tables.nan_to_null(df)


def read_scans(spark: SparkSession, scans: DataFrame) -> DataFrame:
    """Measurements of the found tables (dataset, path) side by side, with the ``dataset`` of each; a column that a table lacks is NULL.

    Tables with the same columns are read together: first lines are read where executors are, and only names reach the driver.
    """

    def first_lines(batches):
        import pandas as pd

        from tessera.sources.planes import open_file

        for pdf in batches:
            heads = []
            for path in pdf["path"]:
                if path.endswith(".csv"):
                    with open_file(path) as f:
                        heads.append(f.readline().decode("utf-8-sig").strip())
                else:
                    heads.append("")
            yield pd.DataFrame({"dataset": pdf["dataset"], "path": pdf["path"], "head": heads})

    alike: dict[str, list[tuple[str, str]]] = {}
    for r in scans.select("dataset", "path").mapInPandas(first_lines, "dataset string, path string, head string").orderBy("path").toLocalIterator():
        alike.setdefault(r.head or r.path, []).append((r.dataset, r.path))
    parts = []
    for found in alike.values():
        paths = [p for _, p in found]
        if paths[0].endswith(".csv"):
            df = typed(spark.read.csv(paths, header=True, nullValue="", nanValue="nan").withColumn("__file", F.col("_metadata.file_path")), ["__file"])
        else:
            df = spark.read.parquet(*paths).withColumn("__file", F.col("_metadata.file_path"))
        # the folder above the measurements names the dataset
        parts.append(tables.nan_to_null(df.drop("dataset")).withColumn("dataset", F.regexp_extract(F.url_decode(F.regexp_replace("__file", r"\+", "%2B")), r"/([^/]+)/[^/]+/[^/]+_cell_measurements[^/]*(?:/[^/]*)?$", 1)).drop("__file"))
    if not parts:
        raise FileNotFoundError("no cell measurements found")
    return tables.union_tables(parts)


# Text and whole-number columns of the measurement table.
TEXT = {"dataset", "source_dataset", "source_file", "file", "scene", "well_row", "well_column", "well_id", "object",
        "Treatment", "Source Name", "Class/Target", "label"}
WHOLE = {"timepoint", "cell_id", "track_id", "parent_track_id", "track_n_frames", "n_nuclei", "n_neighbours",
         "scene_n_nuclei", "plate_num", "sample_num", "rescan_num", "ring_area_px"}
FLAGS = {"scene_confluent", "is_control", "confluent"}


def typed(df: DataFrame, text_columns: Sequence[str] = ()) -> DataFrame:
    """Declared types for a table read as text; no inference pass over the data."""
    out = []
    for c in df.columns:
        q = f"`{c}`"
        if c in TEXT or c in text_columns:
            out.append(F.col(q))
        elif c in FLAGS:
            out.append(F.expr(f"try_cast(lower({q}) as boolean)").alias(c))
        elif c in WHOLE:
            out.append(F.expr(f"cast(try_cast({q} as double) as bigint)").alias(c))
        else:
            out.append(F.expr(f"try_cast({q} as double)").alias(c))
    return df.select(*out)
