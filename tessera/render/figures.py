"""Figures as SVG from small result tables, and the index page.

Spark reduces every figure to its data table first (quartiles, bins, curve points); only
those tables, a page of groups at a time, come to the driver.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import summary
from tessera.operators.prefix import quantiles

# Line colours of time courses.
SERIES = ["#2a78d6", "#e3a008", "#c2378f", "#1baf7a", "#7a5cd6", "#e36a2a", "#3fb3c9", "#8a6d3b", "#d64f70", "#5a8f29"]
GREY, INK = "#9a9a9a", "#222222"
POINTS = 200  # steps drawn per cumulative curve
BINS = 64  # density bins per violin


def token(s: Any) -> str:
    return re.sub(r"[^\w.\-]+", "_", str(s)).strip("_")[:80] or "x"


class Canvas:
    """A plot area with a vertical value axis."""

    def __init__(self, title: str, low: float, high: float, width: int = 760, height: int = 420, log: bool = False):
        self.w, self.h, self.left, self.top, self.bottom = width, height, 70, 34, 110
        self.log = log and low > 0
        self.low, self.high = low, high if high > low else low + 1
        self.parts = [f'<text x="{self.left}" y="20" font-size="14" fill="{INK}">{html.escape(title)}</text>']
        for i in range(6):
            v = self.low + (self.high - self.low) * i / 5
            y = self.y(v)
            self.parts.append(f'<line x1="{self.left}" x2="{self.w - 10}" y1="{y:.1f}" y2="{y:.1f}" stroke="#e4e4e4"/>')
            self.text(self.left - 6, y + 4, f"{v:.3g}", "end")

    def y(self, v: float) -> float:
        a, b, v = (math.log10(x) if self.log else x for x in (self.low, self.high, max(v, self.low) if self.log else v))
        return self.top + (self.h - self.top - self.bottom) * (1 - min(1, max(0, (v - a) / (b - a))))

    def x(self, share: float) -> float:
        return self.left + (self.w - self.left - 10) * share

    def text(self, x, y, s, anchor="middle", turn=None, bold=False):
        spin = f' transform="rotate({turn} {x:.1f} {y:.1f})"' if turn else ""
        weight = ' font-weight="bold"' if bold else ""
        self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="10" text-anchor="{anchor}" fill="{INK}"{weight}{spin}>{html.escape(str(s))}</text>')

    def rect(self, x, y, w, h, fill, opacity=1.0):
        self.parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{fill}" fill-opacity="{opacity}" stroke="{INK}" stroke-width="0.6"/>')

    def line(self, pts: Sequence[tuple[float, float]], colour=INK, width=1.2, fill="none", opacity=1.0):
        d = " ".join(f"{x:.1f},{y:.1f}" for x, y in pts)
        kind = "polygon" if fill != "none" else "polyline"
        self.parts.append(f'<{kind} points="{d}" fill="{fill}" fill-opacity="{opacity}" stroke="{colour}" stroke-width="{width}"/>')

    def dot(self, x, y, colour=INK, r=2.2):
        self.parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{r}" fill="{colour}"/>')

    def save(self, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        body = "".join(self.parts)
        path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {self.w} {self.h}" font-family="sans-serif">'
                        f'<rect width="{self.w}" height="{self.h}" fill="white"/>{body}</svg>')


class Book:
    """All figures of one analysis."""

    def __init__(self, out: Path, cfg: Mapping[str, Any]):
        self.out, self.cfg = out, cfg
        self.made: list[tuple[str, str, str, Path]] = []
        self.errors: list[str] = []

    def _keep(self, section: str, kind: str, name: str, canvas: Canvas, path: Path) -> None:
        canvas.save(path)
        self.made.append((section, kind, name, path))

    def by_group(self, group: str, df: DataFrame, order: DataFrame, columns: Sequence[str]) -> None:
        per = int(self.cfg["max_groups_per_figure"])
        pages: dict[int, list] = {}
        for r in order.orderBy("position").toLocalIterator():
            pages.setdefault((r.position - 1) // per, []).append(r)
        for page, groups in pages.items():
            for col in columns:
                # one figure that cannot be drawn must not stop the others
                try:
                    self._page(group, df, col, groups, page, len(pages))
                except Exception as e:  # noqa: BLE001
                    self.errors.append(f"{group}/{col}: {e}")
                    print(f"figure {group}/{col} failed: {e}")

    def _page(self, group, df, col, groups, page, n_pages) -> None:
        names = [g["__g"] for g in groups]
        part = df.where(F.col("__g").isin(names))
        long = summary.long_values(part, ["__g", "__replicate"], [col])
        keys = ["__g"]
        box = {r["__g"]: r for r in summary.box_stats(long, keys).collect()}
        if not box:
            return
        counts = {r["__g"]: r["count"] for r in long.groupBy("__g").count().collect()}
        lim = summary.axis_limits(long, float(self.cfg["y_percentile_clip"])).first()
        section, suffix = f"by {group}", f"_p{page + 1}" if n_pages > 1 else ""
        folder = self.out / f"by_{token(group)}"

        def canvas(what):
            c = Canvas(f"{col} by {group} ({what})", lim.low, lim.high, log=self.cfg["log_scale"])
            for i, g in enumerate(groups):
                x = c.x((i + 0.5) / len(groups))
                c.text(x, c.h - c.bottom + 14, g["label"], "end", -40, bold=g["is_control"])
                c.text(x, c.top - 2, f"n={counts.get(g['__g'], 0)}")
            return c

        step = (Canvas("", 0, 1).w - 80) / len(groups)
        if self.cfg["plot_box"]:
            c = canvas("box")
            for i, g in enumerate(groups):
                b, x = box.get(g["__g"]), c.x((i + 0.5) / len(groups))
                if b is None:
                    continue
                half = min(22, step * 0.35)
                c.line([(x, c.y(b.whisker_low)), (x, c.y(b.whisker_high))])
                c.rect(x - half, c.y(b.q3), 2 * half, max(0.5, c.y(b.q1) - c.y(b.q3)), GREY if g["is_control"] else SERIES[0], 0.6)
                c.line([(x - half, c.y(b.median)), (x + half, c.y(b.median))], width=2)
                c.dot(x, c.y(b["mean"]))
            self._keep(section, "box", col, c, folder / "box" / f"{token(col)}{suffix}.svg")
        density = None
        if self.cfg["plot_violin"] or self.cfg["plot_superplot"]:
            ends = long.groupBy("__g").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
            bins = summary.count_bins(long, ends.where("hi > lo"), keys, BINS).collect()
            limits = {r["__g"]: (r.lo, r.hi) for r in ends.collect()}
            density = {}
            for r in bins:
                density.setdefault(r["__g"], [0] * BINS)[r.bin] = r.n

        def violins(c):
            for i, g in enumerate(groups):
                d, x = density.get(g["__g"]), c.x((i + 0.5) / len(groups))
                if not d:
                    continue
                soft = [sum(d[k] * math.exp(-0.5 * ((k - j) / 2.0) ** 2) for k in range(BINS)) for j in range(BINS)]
                lo, hi = limits[g["__g"]]
                half = min(24, step * 0.42)
                ys = [c.y(lo + (hi - lo) * (j + 0.5) / BINS) for j in range(BINS)]
                ws = [half * s / max(soft) for s in soft]
                c.line([(x - w, y) for w, y in zip(ws, ys)] + [(x + w, y) for w, y in zip(ws[::-1], ys[::-1])],
                       fill=GREY if g["is_control"] else SERIES[0], opacity=0.5, width=0.6)

        if self.cfg["plot_violin"]:
            c = canvas("violin")
            violins(c)
            for i, g in enumerate(groups):
                b, x = box.get(g["__g"]), c.x((i + 0.5) / len(groups))
                if b is not None:
                    c.line([(x, c.y(b.q1)), (x, c.y(b.q3))], width=3)
                    c.dot(x, c.y(b.median), "white")
            self._keep(section, "violin", col, c, folder / "violin" / f"{token(col)}{suffix}.svg")
        if self.cfg["plot_superplot"]:
            c = canvas("replicates")
            violins(c)
            reps = quantiles(long, ["__g", "__replicate"], "value", {"median": 0.5})
            # the setting bounds the dots of a group; the mean is over all replicates
            means = {r["__g"]: r.m for r in reps.groupBy("__g").agg(F.avg("median").alias("m")).collect()}
            dots = summary.subsample(reps, "__g", ["__replicate"], int(self.cfg["max_points_per_group"]))
            at = {g["__g"]: i for i, g in enumerate(groups)}
            for r in dots.toLocalIterator():
                spread = ((zlib.crc32(r["__replicate"].encode()) % 1000) / 1000 - 0.5) * min(24, step * 0.4)
                c.dot(c.x((at[r["__g"]] + 0.5) / len(groups)) + spread, c.y(r["median"]), SERIES[1])
            for g, m in means.items():
                x = c.x((at[g] + 0.5) / len(groups))
                c.line([(x - 16, c.y(m)), (x + 16, c.y(m))], width=2.4)
            self._keep(section, "replicates", col, c, folder / "superplot" / f"{token(col)}{suffix}.svg")
        if self.cfg["plot_ecdf"]:
            probs = {f"p{i}": i / POINTS for i in range(POINTS + 1)}
            curves = {r["__g"]: r for r in quantiles(long, keys, "value", probs).collect()}
            c = Canvas(f"{col} by {group} (cumulative)", 0.0, 1.0)
            span = lim.high - lim.low
            for i, g in enumerate(groups):
                r = curves.get(g["__g"])
                if r is not None:
                    pts = [(c.x(min(1, max(0, (r[f"p{j}"] - lim.low) / span))), c.y(j / POINTS)) for j in range(POINTS + 1)]
                    c.line(pts, GREY if g["is_control"] else SERIES[i % len(SERIES)])
            self._keep(section, "ecdf", col, c, folder / "ecdf" / f"{token(col)}{suffix}.svg")

    def shift_matrix(self, group: str, shifts: DataFrame, order: DataFrame) -> None:
        limit = summary.colour_limit(shifts).first()
        lim = limit["limit"] if limit and limit["limit"] else 1.0
        rows = order.orderBy("position").collect()  # one row per group, as many as the figure has lines
        values = {(r["__g"], r["column"]): r["shift"] for r in shifts.collect()}
        cols = sorted({c for _, c in values})
        size = 18
        c = Canvas(f"Overview by {group}: median shift", 0, 1, 220 + size * len(cols), 160 + size * len(rows))
        c.parts = c.parts[:1]
        for i, g in enumerate(rows):
            c.text(190, 44 + size * i + 12, g["label"], "end", bold=g["is_control"])
            for j, col in enumerate(cols):
                v = values.get((g["__g"], col))
                if v is not None:
                    s = min(1.0, abs(v) / lim)
                    other = int(255 * (1 - s))
                    c.rect(200 + size * j, 44 + size * i, size, size, f"rgb(255,{other},{other})" if v > 0 else f"rgb({other},{other},255)")
        for j, col in enumerate(cols):
            c.text(200 + size * j + 9, 58 + size * len(rows), col, "end", -50)
        self._keep(f"by {group}", "overview", "all", c, self.out / f"by_{token(group)}" / "overview_heatmap.svg")

    def time_courses(self, group: str, course: DataFrame, order: DataFrame) -> None:
        shown = order.orderBy("position").limit(12).collect()
        names = [g["__g"] for g in shown]
        time = [c for c in course.columns if c in ("time_min", "timepoint")][0]
        table: dict[str, dict[str, list]] = {}
        for r in course.where(F.col("__g").isin(names)).orderBy("column", "__g", time).toLocalIterator():
            table.setdefault(r["column"], {}).setdefault(r["__g"], []).append((r[time], r.q25, r.q50, r.q75))
        for col, lines in table.items():
            every = [p for pts in lines.values() for p in pts]
            c = Canvas(f"{col} over time by {group}", min(p[1] for p in every), max(p[3] for p in every))
            t0, t1 = min(p[0] for p in every), max(p[0] for p in every)
            for i, g in enumerate(shown):
                pts = lines.get(g["__g"], [])
                colour = GREY if g["is_control"] else SERIES[i % len(SERIES)]
                xs = [c.x((p[0] - t0) / ((t1 - t0) or 1)) for p in pts]
                c.line([(x, c.y(p[1])) for x, p in zip(xs, pts)] + [(x, c.y(p[3])) for x, p in zip(xs[::-1], pts[::-1])], colour, 0.2, colour, 0.15)
                c.line([(x, c.y(p[2])) for x, p in zip(xs, pts)], colour, 1.8)
                c.text(c.w - 14, c.h - c.bottom + 16 + 11 * i, g["label"], "end")
            self._keep("time courses", "time", col, c, self.out / "time_courses" / f"by_{token(group)}" / f"{token(col)}.svg")

    def plates(self, medians: DataFrame) -> None:
        limits = {r["column"]: (r.low, r.high) for r in summary.heatmap_limits(medians).collect()}
        per_page: dict[str, dict[str, list]] = {}
        # a plate has a few hundred wells; plates are drawn one at a time
        for r in medians.orderBy("column", "plate_name").toLocalIterator():
            per_page.setdefault(r["column"], {}).setdefault(r.plate_name, []).append(r)
        for col, plates in per_page.items():
            low, high = limits[col]
            for name, wells in plates.items():
                rows = max(8, max(w.plate_row for w in wells) + 1)
                cols = max(12, max(w.plate_col for w in wells) + 1)
                c = Canvas(f"{col}: {name}", 0, 1, 60 + 26 * cols, 70 + 26 * rows)
                c.parts = c.parts[:1]
                for w in wells:
                    s = min(1.0, max(0.0, (w["median"] - low) / ((high - low) or 1)))
                    c.rect(40 + 26 * w.plate_col, 40 + 26 * w.plate_row, 26, 26, f"rgb({int(250 * (1 - s))},{int(250 - 90 * s)},{int(250 - 40 * s)})")
                self._keep("plate heatmaps", "plate", col, c, self.out / "plate_heatmaps" / f"{token(col)}_{token(name)}.svg")

    def index(self) -> Path:
        sections: dict[str, dict[str, list]] = {}
        for section, kind, name, path in self.made:
            sections.setdefault(section, {}).setdefault(kind, []).append((name, path.relative_to(self.out)))
        body = []
        for section, kinds in sections.items():
            body.append(f"<h2>{html.escape(section)}</h2>")
            for kind, items in kinds.items():
                body.append(f"<h3>{html.escape(kind)}</h3>")
                body += [f'<a href="{p}"><img loading="lazy" width="380" src="{p}" alt="{html.escape(n)}"></a>' for n, p in items]
        body += [f"<p>{html.escape(e)}</p>" for e in self.errors]
        path = self.out / "index.html"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<!doctype html><meta charset='utf-8'><title>Results</title><body>{''.join(body)}</body>")
        return path
