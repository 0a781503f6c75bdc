"""Overview pictures: shrunken channels, normalised and merged, as PNG files."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.prefix import quantiles
from tessera.operators.tiles import Tiles

# Display colours and round scale-bar lengths in micrometres.
COLOURS = {
    "gray": (1, 1, 1), "grey": (1, 1, 1), "white": (1, 1, 1), "red": (1, 0, 0), "green": (0, 1, 0), "blue": (0, 0, 1),
    "cyan": (0, 1, 1), "magenta": (1, 0, 1), "yellow": (1, 1, 0), "orange": (1, 0.5, 0),
}
BAR_LENGTHS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 5000, 10000)


def bar_length(width_um: float) -> float:
    """A round length of about a fifth of the image width."""
    fits = [n for n in BAR_LENGTHS if n <= width_um / 5]
    return float(max(fits) if fits else BAR_LENGTHS[0])


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), "u1"), rgb.astype("u1").reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b""))


def screen(channels: Sequence[np.ndarray], colours: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """Screen blend of normalised channels: one minus the product of what is left dark."""
    dark = np.ones((*channels[0].shape, 3))
    for a, colour in zip(channels, colours):
        dark *= 1.0 - a[..., None] * np.asarray(colour, float)
    return np.clip(1.0 - dark, 0, 1)


def shrunken(t: Tiles, layers: Sequence[str], most: int) -> DataFrame:
    """(keys, channel, y, x, v, height, width, step): block means so that no side exceeds ``most``."""
    step = F.greatest(F.lit(1), F.ceil(F.greatest("height", "width") / most) if most > 0 else F.lit(1)).cast("int")
    src = t._with(t.df.withColumn("__step", step), t.layers)

    def run(b):
        f = b.__dict__["__step"]
        h, w = b.height // f, b.width // f
        out = {"channel": [], "y": [], "x": [], "s": [], "height": [], "width": [], "step": []}
        for i, layer in enumerate(layers):
            a = b[layer]
            y, x = np.mgrid[b.y0: b.y0 + a.shape[0], b.x0: b.x0 + a.shape[1]]
            ok = (y < h * f) & (x < w * f)
            u, inv = np.unique(np.stack([(y // f)[ok], (x // f)[ok]]), axis=1, return_inverse=True)
            s = np.bincount(inv.ravel(), weights=a[ok].astype(float), minlength=u.shape[1])
            m = u.shape[1]
            for name, values in (("channel", [i] * m), ("y", u[0].tolist()), ("x", u[1].tolist()), ("s", s.tolist()),
                                 ("height", [h] * m), ("width", [w] * m), ("step", [f] * m)):
                out[name] += values
        return out

    parts = src.rows(list(layers), "channel int, y int, x int, s double, height int, width int, step int", run, per_image=["__step"])
    return parts.groupBy(*t.keys, "channel", "y", "x", "height", "width", "step").agg(
        (F.sum("s") / (F.first("step") * F.first("step"))).alias("v")
    )


def outlines(t: Tiles, labels: str, out: str) -> Tiles:
    """A layer that is one where a label meets another label or the background below or to the right."""

    def run(b):
        lab, (cy, cx) = b[labels], b.core
        line = np.zeros(lab.shape)
        line[:-1] = np.maximum(line[:-1], lab[:-1] != lab[1:])
        line[:, :-1] = np.maximum(line[:, :-1], lab[:, :-1] != lab[:, 1:])
        return {out: line[cy, cx]}

    return t.transform([labels], {out: "f8"}, run, halo=1)


def quality(t: Tiles, nuclei: str | None, edge: str | None, labels: str, folder: str, most: int = 2000) -> DataFrame:
    """One picture per image: nuclei blue, junctions green, object outlines yellow."""
    t = outlines(t, labels, "__line")
    layers = [n for n in (nuclei, edge) if n] + ["__line"]
    cfg = {"overview_max_px": most, "overview_low_percentile": 0.5, "overview_percentile": 99.5, "overview_colored": True,
           "overview_merge": True, "overview_scalebar": False, "overview_scalebar_um": None,
           "overview_colors": ", ".join((["blue"] if nuclei else []) + (["green"] if edge else []) + ["yellow"])}
    name = text.scene_stem(F.col("dataset"), F.col("scene"), F.col("timepoint"))
    return overviews(t.select(*layers), layers, cfg, folder, name, "_qc", only_merge=True)


def overviews(t: Tiles, layers: Sequence[str], cfg: Mapping[str, Any], folder: str, name: Column | None = None,
              suffix: str = "_overview", only_merge: bool = False) -> DataFrame:
    """Write one picture per scene; returns (keys, file).  A picture has at most ``overview_max_px``
    pixels a side, so drawing it is a small group."""
    keys = list(t.keys)
    name = text.scene_stem(F.col("dataset"), F.col("scene")) if name is None else name
    small = shrunken(t, layers, int(cfg["overview_max_px"] or 0))
    low = float(cfg["overview_low_percentile"] or 0)
    q = quantiles(small, [*keys, "channel"], "v", {"lo": low / 100, "hi": float(cfg["overview_percentile"]) / 100})
    top = small.groupBy(*keys, "channel").agg(F.max("v").alias("mx"))
    lo = F.col("lo") if low > 0 else F.lit(0.0)
    q = q.join(top, [*keys, "channel"]).withColumn("lo", lo).withColumn(
        "hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).when(F.col("mx") > F.col("lo"), F.col("mx")).otherwise(F.col("lo") + 1)
    )
    scaled = small.join(q, [*keys, "channel"]).withColumn(
        "v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    )
    if "pixel_size_um" in t.df.columns:
        scaled = scaled.join(t.df.groupBy(*keys).agg(F.max("pixel_size_um").alias("ps")), keys)
    else:
        scaled = scaled.withColumn("ps", F.lit(None).cast("double"))
    scaled = scaled.withColumn("__name", name)
    names = [c.strip() for c in str(cfg["overview_colors"]).split(",") if c.strip()] or ["gray"]
    colours = [COLOURS.get(names[i % len(names)].lower(), (1.0, 1.0, 1.0)) for i in range(len(layers))]
    coloured, merge, bar, bar_um = cfg["overview_colored"], cfg["overview_merge"], cfg["overview_scalebar"], cfg["overview_scalebar_um"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.df.select(*keys).schema)

    def draw(pdf):
        os.makedirs(folder, exist_ok=True)
        first = pdf.iloc[0]
        h, w = int(first["height"]), int(first["width"])
        planes = []
        for i in range(len(layers)):
            a = np.zeros((h, w))
            part = pdf[pdf["channel"] == i]
            a[part["y"], part["x"]] = part["v"]
            planes.append(a)
        panels = [screen([a], [c if coloured else (1, 1, 1)]) for a, c in zip(planes, colours)]
        if merge and len(planes) > 1:
            panels.append(screen(planes, colours))
        panels = panels[-1:] if only_merge else panels
        ps = first["ps"]
        if bar and ps == ps and ps:
            step_um = ps * first["step"]
            n = int(round((bar_um or bar_length(w * step_um)) / step_um))
            for p in panels:
                thick = max(1, int(0.012 * h))
                p[h - 2 * thick: h - thick, max(0, w - n - thick): w - thick] = 1.0
        picture = (np.concatenate(panels, axis=1) * 255).round()
        target = os.path.join(folder, first["__name"] + suffix + ".png")
        part_file = f"{target}.{os.getpid()}.part"
        with open(part_file, "wb") as f:
            f.write(png(picture))
        os.replace(part_file, target)
        return pd.DataFrame([{**{k: first[k] for k in keys}, "file": target}])

    return scaled.groupBy(*keys).applyInPandas(draw, f"{fields}, file string")
