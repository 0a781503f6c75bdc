"""Names, wells, labels: column expressions over strings."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image formats and their file endings.
FORMATS = {
    "lif": [".lif"],
    "czi": [".czi"],
    "ome.tif": [".ome.tif", ".ome.tiff"],
    "tif": [".tif", ".tiff"],
    "nd2": [".nd2"],
}
# A stand-alone well token, rows A-P and columns 1-32.
GENERIC_WELL = r"(?:^|[^A-Za-z0-9])(?<row>[A-Pa-p])(?<col>0?[1-9]|[12][0-9]|3[0-2])(?=$|[^0-9])"
WELL_PATTERN = r"(?P<row>[A-Za-z]{1,2})/(?P<col>\d{1,2})(?:_|$)"
DATASET_PATTERN = r"Plate(?P<plate>\d+)_Sample(?P<sample>\d+)(?:_(?P<rescan>\d+))?$"
# Minutes per unit of a frame interval.
MINUTES = {"ms": 1 / 60000.0, "s": 1 / 60.0, "min": 1.0, "h": 60.0}

# the non-format entry lets any npy array be used as an image
_ENDINGS = sorted(
    [(e, fmt) for fmt, ends in {**FORMATS, "npy": [".npy"]}.items() for e in ends],
    key=lambda pair: -len(pair[0]),
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def format_of(name: Column) -> Column:
    """Image format of a file name, NULL when unsupported; the longest ending wins."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for ending, fmt in reversed(_ENDINGS):
        out = F.when(low.endswith(ending), F.lit(fmt)).otherwise(out)
    return out


def file_stem(name: Column) -> Column:
    """Name without its (multi-part) image ending, else without the last extension."""
    known = "|".join(re.escape(e) for e, _ in _ENDINGS)
    stripped = F.regexp_replace(name, f"(?i)(?:{known})$", "")
    return F.when(format_of(name).isNotNull(), stripped).otherwise(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    )


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r'[\\/:*?"<>|]', "_")


def scene_stem(stem: Column, scene: Column, timepoint: Column | None = None) -> Column:
    base = F.concat(stem, F.lit("_"), safe_name(scene))
    return base if timepoint is None else F.format_string("%s_t%04d", base, timepoint.cast("int"))


def name_filter(
    name: Column,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    regex: bool = False,
    case_sensitive: bool = False,
) -> Column:
    """Any include pattern must hit (none given: all pass), no exclude pattern may hit."""

    def hit(pattern: str) -> Column:
        if regex:
            return name.rlike(java_pattern(pattern) if case_sensitive else "(?i)" + java_pattern(pattern))
        if case_sensitive:
            return F.contains(name, F.lit(pattern))
        return F.contains(F.lower(name), F.lit(pattern.lower()))

    keep = F.lit(True)
    if include:
        any_in = F.lit(False)
        for p in include:
            any_in = any_in | hit(p)
        keep = any_in
    for p in exclude:
        keep = keep & ~hit(p)
    return keep


def java_pattern(pattern: str) -> str:
    """Named groups in the form the JVM accepts."""
    return pattern.replace("(?P<", "(?<").replace("(?P=", "\\k<")


def _group(text: Column, pattern: str, name: str) -> Column:
    """A named group as text, NULL when the pattern or the group does not match."""
    names = _group_numbers(pattern)
    if name not in names:
        return F.lit(None).cast("string")
    got = F.regexp_extract(text, java_pattern(pattern), names[name])
    return F.nullif(got, F.lit(""))


def _group_numbers(pattern: str) -> dict[str, int]:
    return dict(re.compile(pattern.replace("(?<row>", "(?P<row>").replace("(?<col>", "(?P<col>")).groupindex)


def parse_well(scene: Column, file: Column, pattern: str = WELL_PATTERN, fallback: bool = True) -> Column:
    """STRUCT<row, col>; the pattern is tried on the scene, then on the file name."""
    texts = [F.coalesce(scene.cast("string"), F.lit("")), F.coalesce(file.cast("string"), F.lit(""))]
    found = []
    for pat in ([pattern] if pattern else []) + ([GENERIC_WELL] if fallback else []):
        for text in texts:
            row, col = _group(text, pat, "row"), _group(text, pat, "col")
            well = F.struct(
                F.upper(row).alias("row"), F.expr("cast(null as string)").alias("col")
            ).withField("col", col.cast("int").cast("string"))
            found.append(F.when(row.isNotNull() & col.isNotNull(), well))
    if not found:
        return F.struct(
            F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("col")
        )
    return F.coalesce(*found)


def well_id(row: Column, column: Column) -> Column:
    return F.concat(F.upper(row.cast("string")), column.cast("int").cast("string"))


def parse_dataset(name: Column, pattern: str = DATASET_PATTERN) -> dict[str, Column]:
    """plate, sample and rescan numbers; rescan is 0 when the pattern matches without one."""
    plate, sample, rescan = (
        _group(name, pattern, g).cast("bigint") for g in ("plate", "sample", "rescan")
    )
    hit = name.rlike(java_pattern(pattern))
    return {
        "plate": plate,
        "sample": sample,
        "rescan": F.when(hit, F.coalesce(rescan, F.lit(0).cast("bigint"))),
    }


def normal_value(value: Column, is_float: bool) -> Column:
    """240.0, 240 and ' 240 ' become the same text; NaN becomes NULL."""
    if is_float:
        whole = value.cast("decimal(38,0)").cast("string")
        text = F.when((value == F.floor(value)) & (F.abs(value) < 1e18), whole).otherwise(
            value.cast("string")
        )
        return F.when(~F.isnan(value), text)
    return F.trim(value.cast("string"))


def group_value(value: Column, is_float: bool) -> Column:
    """Group text with NULL and the words for missing values removed."""
    text = normal_value(value, is_float)
    return F.when(F.lower(text) != "nan", text)


def not_nonconfluent(flag: Column) -> Column:
    """Keep everything that is not explicitly false; a missing flag is kept."""
    return F.coalesce(F.lower(flag.cast("string")), F.lit("")) != "false"


def truthy(flag: Column) -> Column:
    return F.coalesce(F.lower(flag.cast("string")).isin("true", "1"), F.lit(False))


def normal_well(well: Column) -> Column:
    """a01 -> A1"""
    return F.regexp_replace(F.upper(well), r"^([A-Z]+)0*(\d+)$", "$1$2")


def row_index(row: Column) -> Column:
    """Row letters to a zero-based index: A=0, Z=25, AA=26."""
    letters = F.split(F.upper(row.cast("string")), "")
    return F.aggregate(
        letters, F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64)
    ) - 1


def natural_key(text: Column) -> Column:
    """Sort key where digit runs of any length compare as numbers."""
    runs = F.split(F.lower(text.cast("string")), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    def number(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        n = F.length(digits)
        # a longer number sorts after all padded ones, by its number of digits first
        return F.when(n <= 18, F.lpad(digits, 18, "0")).otherwise(F.concat(F.lit("~"), F.lpad(n.cast("string"), 10, "0"), digits))

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), number(r)).otherwise(r)), "")


def safe_token(text: Column) -> Column:
    """A short file-name token: word characters, dot and dash only."""
    token = F.left(
        F.btrim(F.regexp_replace(text.cast("string"), r"[^\p{L}\p{N}_.\-]+", "_"), F.lit("_")), F.lit(80)
    )
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("x"))


def display_label(group: Column, label: Column) -> Column:
    lab = label.cast("string")
    shown = F.concat(group, F.lit(" · "), lab)
    usable = lab.isNotNull() & (lab != "") & (F.lower(lab) != "nan") & (lab != group)
    return F.when(usable, shown).otherwise(group)


def minutes(amount: Column, unit: Column) -> Column:
    """A frame interval in minutes; an unknown unit counts as seconds."""
    low = F.lower(F.trim(unit))
    out = F.lit(MINUTES["s"])
    for name, factor in MINUTES.items():
        out = F.when(low == name, F.lit(factor)).otherwise(out)
    return amount * out


def matching_columns(df: DataFrame, patterns: Sequence[str], skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns that match wildcard patterns, in pattern then column order."""
    numeric = [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
        or f.dataType.typeName().startswith("decimal")
    ]
    numeric = [c for c in numeric if c not in skip]
    out: list[str] = []
    for pat in patterns:
        out += [c for c in numeric if fnmatch.fnmatchcase(c, pat) and c not in out]
    return out
