"""Illumination fields: estimating them from many scenes or a reference, checking, applying."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, DoubleType, StructField, StructType

from tessera.operators import kernels as k
from tessera.operators import segment as sg
from tessera.operators.tiles import Tiles, tile_images


def field_images(t: Tiles, layer: str, group: Sequence[str], factor: int, sigma: float) -> DataFrame:
    """(group, height, width, field, mean): mean of the coarsened scenes, blurred.

    ``group`` are image keys (none: pooled).  Scenes are cropped to the smallest one; block
    means are summed per pixel position with partial aggregation, so the number of scenes
    does not matter.
    """
    group = list(group)
    src = t if group else t._with(t.df.withColumn("__all", F.lit(0)), t.layers)
    by = group or ["__all"]
    keys = list(dict.fromkeys([*t.keys, *by]))
    small = block_sums(Tiles(src.df, tuple(keys), t.size, t.layers, t.single), layer, factor)
    least = small.groupBy(*by).agg(F.min("height").alias("__h"), F.min("width").alias("__w"))
    mean = (
        small.join(least, by).where("y < __h and x < __w").groupBy(*by, "y", "x", "__h", "__w")
        .agg(F.avg("v").alias("v")).withColumnsRenamed({"__h": "height", "__w": "width"})
    )
    packed = sg.tiles_from_pixels(mean, by, "v", "field", "f8", t.size, False)
    from tessera.sources.images import untile

    out = untile(sg.smooth(packed, "field", "field", sigma), "field")
    return out if group else out.drop("__all")


def block_sums(t: Tiles, layer: str, factor: int) -> DataFrame:
    """(keys, y, x, v, height, width): block means of images cropped to a multiple of ``factor``."""

    def run(b):
        a = b[layer]
        h, w = b.height // factor, b.width // factor
        y, x = np.mgrid[b.y0: b.y0 + a.shape[0], b.x0: b.x0 + a.shape[1]]
        ok = (y < h * factor) & (x < w * factor)
        block = np.stack([(y // factor)[ok], (x // factor)[ok]])
        u, inv = np.unique(block, axis=1, return_inverse=True)
        s = np.bincount(inv.ravel(), weights=a[ok].astype(float), minlength=u.shape[1])
        m = u.shape[1]
        return {"y": u[0].tolist(), "x": u[1].tolist(), "v": s.tolist(), "height": [h] * m, "width": [w] * m}

    parts = t.rows([layer], "y int, x int, v double, height int, width int", run)
    return parts.groupBy(*t.keys, "y", "x", "height", "width").agg((F.sum("v") / (factor * factor)).alias("v"))


def reference_sigma(sigma: float, height: int, width: int) -> float:
    """A reference needs its noise removed only: at most three percent of its larger side."""
    return float(min(sigma, max(1.0, 0.03 * max(height, width))))


def reference_fields(means: DataFrame, kind: str, sigma: float, offset: float = 0.0, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """(keys, operation, height, width, field, dark, offset) from mean reference images.

    ``means`` is (keys, height, width, mean, dark) with float64 planes; ``dark`` may be NULL.
    One small, coarsened plane per row.
    """
    keys = list(keys)
    schema = StructType(
        [means.schema[c] for c in keys]
        + [StructField("operation", StringType()), StructField("height", IntegerType()), StructField("width", IntegerType()),
           StructField("field", BinaryType()), StructField("dark", BinaryType()), StructField("offset", DoubleType())]
    )

    def blur(a, s):
        w = k.gaussian_weights(s)
        p = np.pad(a, len(w) // 2, mode="symmetric")
        return k.convolve_valid(k.convolve_valid(p, w, 0), w, 1)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                mean = np.frombuffer(row["mean"]).reshape(row["height"], row["width"])
                s = reference_sigma(sigma, *mean.shape)
                dark = None
                if kind == "flatfield":
                    if row["dark"] is not None:
                        dark = blur(np.frombuffer(row["dark"]).reshape(mean.shape), 2)
                    field = blur(mean - (dark if dark is not None else offset), s)
                    if field.min() <= 0:
                        raise ValueError("the reference minus offset or dark image is not positive everywhere")
                else:
                    field = blur(mean, s)
                out.append({**{c: row[c] for c in keys}, "operation": "divide" if kind == "flatfield" else "subtract",
                            "height": row["height"], "width": row["width"], "field": field.tobytes(),
                            "dark": None if dark is None else dark.tobytes(),
                            "offset": None if dark is not None or not offset else float(offset)})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return means.mapInPandas(run, schema)


def resized_part(field: np.ndarray, height: int, width: int, y0: int, x0: int, h: int, w: int) -> np.ndarray:
    """A window of ``field`` stretched to height x width; corners stay corners (bilinear)."""

    def axis(n_in, n_out, start, n):
        at = np.arange(start, start + n) * ((n_in - 1) / (n_out - 1) if n_out > 1 else 0.0)
        lo = np.clip(np.floor(at).astype(int), 0, max(n_in - 2, 0))
        return lo, np.minimum(lo + 1, n_in - 1), at - lo

    ya, yb, fy = axis(field.shape[0], height, y0, h)
    xa, xb, fx = axis(field.shape[1], width, x0, w)
    top = field[ya][:, xa] * (1 - fx) + field[ya][:, xb] * fx
    low = field[yb][:, xa] * (1 - fx) + field[yb][:, xb] * fx
    return top * (1 - fy[:, None]) + low * fy[:, None]


def field_tiles(fields: DataFrame, t: Tiles, group: Sequence[str]) -> DataFrame:
    """(group, ty, tx, height, width, __gain, __sub): the field at tile resolution, made once per
    image shape and tile position."""
    group, size = list(group), t.size
    spots = t.df.select(*group, "ty", "tx", "height", "width").distinct()
    named = fields.withColumnsRenamed({"height": "__fh", "width": "__fw"})
    joined = spots.join(named, group) if group else spots.crossJoin(named)
    schema = StructType([spots.schema[c] for c in [*group, "ty", "tx", "height", "width"]]
                        + [StructField("__gain", BinaryType()), StructField("__sub", BinaryType())])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y0, x0 = row["ty"] * size, row["tx"] * size
                h, w = min(size, row["height"] - y0), min(size, row["width"] - x0)

                def part(a, row=row, y0=y0, x0=x0, h=h, w=w):
                    return resized_part(a, row["height"], row["width"], y0, x0, h, w)

                field = np.frombuffer(row["field"]).reshape(row["__fh"], row["__fw"])
                gain = sub = None
                if row["operation"] == "subtract":
                    sub = part(field)
                else:
                    if field.mean() <= 0:
                        raise ValueError("a flatfield needs a positive mean")
                    gain = np.maximum(part(field / field.mean()), 1e-3)
                    if row["dark"] is not None:
                        sub = part(np.frombuffer(row["dark"]).reshape(field.shape))
                    elif row["offset"] == row["offset"] and row["offset"]:
                        sub = np.full((h, w), float(row["offset"]))
                out.append({**{c: row[c] for c in schema.fieldNames()[:-2]}, "__gain": None if gain is None else gain.tobytes(),
                            "__sub": None if sub is None else sub.tobytes()})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return joined.mapInPandas(run, schema)


def correct(t: Tiles, layer: str, fields: DataFrame, group: Sequence[str] = ()) -> Tiles:
    """Subtract a blank, or subtract dark or offset and divide by the field over its mean.

    ``fields`` is (group, operation, offset, height, width, field, dark).
    """
    parts = field_tiles(fields, t, group)
    joined = t.df.join(parts, [*group, "ty", "tx", "height", "width"], "left")
    dtype, columns = t.layers[layer], t.df.columns

    def run(batches):
        for pdf in batches:
            out = []
            for blob, gain, sub in zip(pdf[layer], pdf["__gain"], pdf["__sub"]):
                a = np.frombuffer(blob, dtype).astype(float)
                a = a - np.frombuffer(sub) if sub is not None else a
                a = a / np.frombuffer(gain) if gain is not None else a
                out.append(a.astype("<f4").tobytes())
            pdf = pdf.drop(columns=["__gain", "__sub"])
            pdf[layer] = out
            yield pdf[columns]

    return t._with(joined.mapInPandas(run, t.df.schema), {**t.layers, layer: "<f4"})


def as_fields(images: DataFrame, operation: str = "divide") -> DataFrame:
    """Estimated field images as corrections without offset."""
    return images.withColumn("operation", F.lit(operation)).withColumn("offset", F.lit(None).cast("double")).withColumn(
        "dark", F.lit(None).cast("binary")
    )


def acquisition_messages(ref: dict[str, Column], img: dict[str, Column], tolerance: float = 0.02) -> Column:
    """ARRAY<STRUCT<level, message>> comparing how a reference and an image were recorded.

    Both sides give magnification, na, objective, pixel_size, height, width, channel_names.
    """

    def note(level: str, text: str | Column, when: Column) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.when(when, F.struct(F.lit(level).alias("level"), text.alias("message")))

    def pair(what: str, a: Column, b: Column) -> Column:
        return F.concat(F.lit(what + " "), a.cast("string"), F.lit(" (reference) vs "), b.cast("string"))

    def known(side):
        return side["magnification"].isNotNull() | side["na"].isNotNull() | side["objective"].isNotNull()

    both, one = known(ref) & known(img), known(ref) != known(img)
    rp, ip = ref["pixel_size"], img["pixel_size"]
    have = F.coalesce(rp > 0, F.lit(False)) & F.coalesce(ip > 0, F.lit(False))

    def off(a, b):
        return F.abs(a - b) / b > tolerance

    fov = off(ref["height"] * rp, img["height"] * ip) | off(ref["width"] * rp, img["width"] * ip)
    shape = (ref["height"] != img["height"]) | (ref["width"] != img["width"])
    fov_error = have & fov
    notes = [
        note("error", pair("objective magnification", ref["magnification"], img["magnification"]),
             both & (F.abs(ref["magnification"] - img["magnification"]) > 0.01)),
        note("error", pair("objective NA", ref["na"], img["na"]), both & (F.abs(ref["na"] - img["na"]) > 0.005)),
        note("warning", pair("objective", ref["objective"], img["objective"]),
             both & (F.trim(ref["objective"]) != F.trim(img["objective"]))),
        note("warning", "objective information is stored in one of the two files only", one),
        note("info", "no objective information in either file", ~known(ref) & ~known(img)),
        note("error", pair("pixel size", rp, ip), have & off(rp, ip)),
        note("warning", "pixel size missing", ~have),
        note("error", "field of view differs", fov_error),
        note("error", "image size differs", ~have & shape),
        note("info", "image size differs, the field is rescaled", shape & ~fov_error),
        note("warning", "channel names differ",
             (F.size(ref["channel_names"]) > 0) & (F.size(img["channel_names"]) > 0) & (ref["channel_names"] != img["channel_names"])),
    ]
    return F.array_compact(F.array(*notes))


def field_tile_images(fields: DataFrame, keys: Sequence[str], size: int = 1024) -> Tiles:
    return tile_images(fields, keys, {"field": "f8"}, size)
