"""Pixel and metric sizes as column expressions over the pixel size of an image.

``SIZES`` says for each size setting what it measures, its smallest pixel value, and its automatic metric value; ``size_columns`` is the only place that
converts.  A single image's values on the driver are the same expressions over one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Size(NamedTuple):
    power: int  # of the pixel size: 1 for lengths, 2 for areas
    least: int | None  # pixels, rounded; None: a smoothing width, not rounded
    automatic: Callable[[float, float], float]  # from nucleus diameter (µm) and cell area (µm²)


# Powers, minima and automatic sizes.
SIZES = {
    "nuclei_sigma": Size(1, None, lambda diameter, area: diameter / 40),
    "min_nucleus_size": Size(2, 1, lambda diameter, area: math.pi * diameter**2 / 12),
    "min_distance": Size(1, 1, lambda diameter, area: 0.35 * diameter),
    "edge_sigma": Size(1, None, lambda diameter, area: diameter / 20),
    "min_label_size": Size(2, 1, lambda diameter, area: area / 10),
    "max_cell_area": Size(2, 0, lambda diameter, area: 4 * area),
    "seed_sigma": Size(1, None, lambda diameter, area: math.sqrt(area / 2.5) / 8),
    "multinuc_max_distance": Size(1, 0, lambda diameter, area: 2 * diameter),
    "multinuc_band_px": Size(1, 0, lambda diameter, area: diameter / 30),
    "clear_border_buffer": Size(1, 0, lambda diameter, area: diameter / 6),
    "nuc_dilation_rad": Size(1, 1, lambda diameter, area: diameter / 9),
    "min_hole_size": Size(2, 0, lambda diameter, area: area / 20),
    "boundary_band_px": Size(1, 1, lambda diameter, area: diameter / 60),
}
TYPICAL = {"typical_nucleus_diameter_um": 10.0, "typical_cell_area_um2": 1000.0}
CONFLUENT_SHARE = 0.3
#: Zero means automatic for these, as in settings of former versions.
ZERO_IS_AUTOMATIC = ("multinuc_max_distance",)


class MissingPixelSize(ValueError):
    pass


def _number(settings: Mapping[str, Any], name: str) -> float | None:
    """A given number; None if the setting is absent, blank or NaN."""
    try:
        value = float(settings.get(name))
    except (TypeError, ValueError):
        return None
    return None if math.isnan(value) or value == 0 and name in ZERO_IS_AUTOMATIC else value


def size_columns(settings: Mapping[str, Any], pixel_size: Column) -> dict[str, Column]:
    """Pixel value of every size setting; NULL where a missing pixel size would be needed."""
    typical = [_number(settings, name) or value for name, value in TYPICAL.items()]
    metric = settings.get("size_units", "um") == "um"
    out = {}
    for name, (power, least, automatic) in SIZES.items():
        given = _number(settings, name)
        value = F.lit(automatic(*typical) if given is None else given)
        px = value / (pixel_size * pixel_size if power == 2 else pixel_size) if metric or given is None else value
        out[name] = F.greatest(px, F.lit(0.0)) if least is None else F.when(px.isNotNull(), F.greatest(F.bround(px).cast("bigint"), F.lit(least).cast("bigint")))
    return out


def confluent_count(settings: Mapping[str, Any], height: Column, width: Column, pixel_size: Column) -> Column:
    """How many objects make an image confluent."""
    given = _number(settings, "min_nuclei_confluent")
    if given is not None:
        return F.lit(int(given)).cast("bigint")
    cell = _number(settings, "typical_cell_area_um2") or TYPICAL["typical_cell_area_um2"]
    area = height.cast("double") * width * pixel_size * pixel_size
    return F.coalesce(F.bround(CONFLUENT_SHARE * area / cell).cast("bigint"), F.lit(0).cast("bigint"))


def sizes_of(spark: SparkSession, settings: Mapping[str, Any], pixel_size: float | None, or_least: bool = False) -> dict[str, Any]:
    """``size_columns`` of one pixel size, on the driver; without a pixel size the smallest values, or an error."""
    columns = size_columns(settings, F.lit(pixel_size or None).cast("double"))
    found = spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first().asDict()
    missing = [name for name, value in found.items() if value is None]
    if missing and not or_least:
        raise MissingPixelSize("the image has no pixel size; give pixel_size_um or all sizes in pixels")
    return found | {name: SIZES[name].least or 0 for name in missing}


def with_metric_columns(df: DataFrame, pixel_size: Column) -> DataFrame:
    """µm and µm² columns next to the pixel columns, rounded to 3 digits."""
    out = {}
    for c in df.columns:
        if c == "area_px":
            out["area_um2"] = F.round(F.col(c) * pixel_size * pixel_size, 3)
        elif c in ("equivalent_diameter_px", "major_axis_px", "minor_axis_px", "nearest_neighbour_px", "contact_px"):
            out[c[:-3] + "_um"] = F.round(F.col(c) * pixel_size, 3)
    return df.withColumns(out) if out else df
