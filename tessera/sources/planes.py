"""Planes of image files as a header table, and tiles read from ranges of files.

``headers`` reads the headers of files where executors are and yields one row per plane with everything a later read needs: shape,
sample type, and where its strips lie.  Plans filter and join that table as any other.  ``read_tiles`` then turns the planes that are left into
tiles: a task takes one row of tiles of one image, reads only the bytes of that row from each z plane, and reduces z as it goes.
No plane is whole in memory and no list of files is on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tessera.operators.tiles import POSITION, Tiles
from tessera.sources import tiff

#: Formats whose readers are packages of their own.
OPTIONAL_READERS = (".lif", ".czi", ".nd2")
#: Where the samples of one plane lie: strips (or stored tiles) of ``tall`` rows and ``wide`` columns.
STORE = "struct<dtype:string,packing:int,predictor:int,tall:int,wide:int,offsets:array<bigint>,counts:array<bigint>>"
SCHEMA = (
    "path string, scene string, t int, c int, z int, height int, width int, dtype string, n_t int, n_c int, n_z int, "
    "channel_name string, pixel_size_um double, frame_interval_min double, objective_name string, magnification double, "
    "numerical_aperture double, immersion string, scene_index int, error string"
)
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]
#: A task reads so many pixels of one row of tiles at once, at least one tile.
PIECE = 1 << 24
CHUNK = 1 << 20


def open_file(path: str):
    """A seekable file: a path, or an address of a file system that pyarrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _number(v: Any) -> float | None:
    try:
        return float(str(v).lower().replace("x", "").strip())
    except (TypeError, ValueError):
        return None


def plane_rows(path: str) -> Iterator[dict]:
    """Planes of one file from its header."""
    low = path.lower()
    if low.endswith(OPTIONAL_READERS):
        raise tiff.UnsupportedImage(f"no reader installed for {path}")
    with open_file(path) as f:
        size = f.seek(0, 2)
        f.seek(0)
        for row in _npy(f, path) if low.endswith(".npy") else _tiff(f, path):
            s = row["store"]
            if any(at + n > size for at, n in zip(s["offsets"], s["counts"])):
                raise tiff.UnsupportedImage(f"{path} is cut short")
            yield row


def _npy(f, path: str) -> Iterator[dict]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if by_column or not 2 <= len(shape) <= 5 or dtype.hasobject:
        raise tiff.UnsupportedImage(f"{path} is no array of planes")
    begin = f.tell()
    # t, c, z, y, x; fewer axes are the last ones, but three axes are channels
    full = (1, shape[0], 1, *shape[1:]) if len(shape) == 3 else (1,) * (5 - len(shape)) + tuple(shape)
    n_t, n_c, n_z, h, w = full
    bytes_ = h * w * dtype.itemsize
    for page in range(n_t * n_c * n_z):
        c = page // n_z % n_c
        yield {
            "path": path, "scene": "Image:0", "scene_index": 0, "t": page // (n_z * n_c), "c": c, "z": page % n_z, "height": h, "width": w, "dtype": str(dtype),
            "n_t": n_t, "n_c": n_c, "n_z": n_z, "channel_name": f"Channel:0:{c}",
            "store": {"dtype": dtype.str, "packing": 1, "predictor": 1, "tall": h, "wide": w, "offsets": [begin + page * bytes_], "counts": [bytes_]},
        }


def _tiff(f, path: str) -> Iterator[dict]:
    pages = tiff.read_directory(f)
    for index, s in enumerate(tiff.layout(pages)):
        for page, (t, c, z) in s["pages"].items():
            if page >= len(pages):
                continue
            h, w, dtype = tiff.page_shape(pages[page])
            ob = s["objective"]
            yield {
                "path": path, "scene": s["scene"], "scene_index": index, "t": t, "c": c, "z": z, "height": h, "width": w, "dtype": dtype,
                "n_t": s["sizes"][0], "n_c": s["sizes"][1], "n_z": s["sizes"][2],
                "channel_name": s["channels"][c] if c < len(s["channels"]) else f"ch{c}",
                "pixel_size_um": s["pixel_size_um"], "frame_interval_min": s["frame_interval_min"],
                "objective_name": ob.get("name"), "magnification": _number(ob.get("magnification")),
                "numerical_aperture": _number(ob.get("na")), "immersion": ob.get("immersion"), "store": tiff.page_store(pages[page]),
            }


def headers(paths: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """One row per plane of the files in ``paths`` (path); a file that cannot be read fails, or is one row with its ``error``."""
    schema = StructType.fromDDL(f"{SCHEMA}, store {STORE}")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    out += list(plane_rows(path))
                except Exception as e:
                    if not skip_unreadable:
                        raise
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([{c: r.get(c) for c in schema.fieldNames()} for r in out], columns=schema.fieldNames(), dtype=object)

    n = 2 * paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(n).mapInPandas(scan, schema)


def _rows(f, at: int, n: int, skip: int, want: int, packed: bool) -> bytes:
    """``want`` bytes of a strip after its first ``skip``; a packed strip is unpacked piece by piece and forgotten up to there."""
    f.seek(at if packed else at + skip)
    if not packed:
        return f.read(want)
    d, out, left, waiting = zlib.decompressobj(), bytearray(), n, b""
    while len(out) < want:
        if not waiting:
            waiting = f.read(min(left, CHUNK))
            left -= len(waiting)
        data = d.decompress(waiting, CHUNK)
        stuck, waiting = not data and not waiting, d.unconsumed_tail
        if stuck:
            raise tiff.UnsupportedImage("a strip ends early")
        drop = min(skip, len(data))
        skip -= drop
        out += data[drop : drop + want - len(out)]
    return bytes(out)


def read_region(f, store: dict, width: int, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """Rows y0 to y1 and columns x0 to x1 of one plane."""
    dtype, tall, wide = np.dtype(store["dtype"]), int(store["tall"]), int(store["wide"])
    out = np.empty((y1 - y0, x1 - x0), dtype)
    across = -(-width // wide)
    for r in range(y0 // tall, -(-y1 // tall)):
        for c in range(x0 // wide, -(-x1 // wide)):
            i, top, left = r * across + c, r * tall, c * wide
            a, b = max(y0, top), min(y1, top + tall)
            line = wide * dtype.itemsize
            raw = _rows(f, int(store["offsets"][i]), int(store["counts"][i]), (a - top) * line, (b - a) * line, store["packing"] != 1)
            part = np.frombuffer(raw, dtype).reshape(b - a, wide)
            if store["predictor"] == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype)
            l, m = max(x0, left), min(x1, left + wide)
            out[a - y0 : b - y0, l - x0 : m - x0] = part[:, l - left : m - left]
    return out


def reduced(f, stack: list[dict], z: str, width: int, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """The region with its z planes reduced one by one: ``max``, ``mean``, or the only one that is left."""
    best = None
    for s in stack:
        a = read_region(f, s["store"], width, y0, y1, x0, x1).astype("<f4")
        best = a if best is None else (np.maximum(best, a) if z == "max" else best + a.astype("f8"))
    return (best / len(stack) if z == "mean" else best).astype("<f4")


def read_tiles(planes: DataFrame, keys: Sequence[str], channels: Sequence[int], size: int, z: str = "max") -> Tiles:
    """Tiles of the header rows ``planes``, which carry ``keys``; one layer ``c<i>`` per channel.

    ``z`` says how the planes of one image and channel become one: max, mean, middle; it is not used where ``z`` is a key.
    """
    keys, channels = list(keys), [int(c) for c in channels]
    image = list(dict.fromkeys([*keys, "path", "height", "width"]))
    kept = planes.where(F.col("c").isin(channels)).select(*dict.fromkeys([*image, "c", "z"]), "store")
    if z == "middle" and "z" not in keys:
        stack = Window.partitionBy(*image, "c")
        place = F.row_number().over(stack.orderBy("z")) - 1
        kept = kept.withColumn("__i", place).withColumn("__n", F.count(F.lit(1)).over(stack)).where("__i = __n div 2")
    # a list holds the headers of one image: its channels and slices
    stacks = kept.groupBy(*image).agg(F.sort_array(F.collect_list(F.struct("c", F.col("z").alias("__z"), "store"))).alias("stack"))
    top = stacks.agg(F.max("height"), F.max("width"), F.sum(F.ceil(F.col("height") / size)).alias("n")).first()
    span = max(1, PIECE // (size * size))
    upto = lambda c: F.ceil(F.col(c) / size).cast("int") - 1
    pieces = stacks.withColumn("ty", F.explode(F.sequence(F.lit(0), upto("height")))).withColumn("tx", F.explode(F.sequence(F.lit(0), upto("width"), F.lit(span))))
    layers = [f"c{c}" for c in channels]
    schema = StructType([stacks.schema[k] for k in keys] + [StructField(p, IntegerType()) for p in POSITION] + [StructField(n, BinaryType()) for n in layers])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                h, w, ty = row["height"], row["width"], row["ty"]
                y0, x0 = ty * size, row["tx"] * size
                y1, x1 = min(h, y0 + size), min(w, x0 + span * size)
                out = [{**{k: row[k] for k in keys}, "ty": ty, "tx": tx, "height": h, "width": w} for tx in range(row["tx"], -(-x1 // size))]
                with open_file(row["path"]) as f:
                    for c, layer in zip(channels, layers):
                        mine = [s for s in row["stack"] if s["c"] == c]
                        if not mine:
                            raise IndexError(f"{row['path']}: channel {c} does not exist")
                        a = reduced(f, mine, z, w, y0, y1, x0, x1)
                        for tile in out:
                            at = tile["tx"] * size - x0
                            tile[layer] = np.ascontiguousarray(a[:, at : at + size]).tobytes()
                yield pd.DataFrame(out, columns=schema.fieldNames())

    wanted = top.n or 1
    tasks = max(1, min(wanted, max(4 * planes.sparkSession.sparkContext.defaultParallelism, wanted // 16)))
    return Tiles(pieces.repartition(tasks).mapInPandas(load, schema), tuple(keys), size, dict.fromkeys(layers, "<f4"), top[0] is not None and max(top[0], top[1]) <= size)
