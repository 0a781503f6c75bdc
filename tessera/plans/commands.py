"""Command lines for results that exist: statistics of a table, combining result folders, sizes of segmented objects.

    python -m tessera analyse TABLE OUT --group-by Treatment --columns "mean_*"
    python -m tessera aggregate --config settings.json --output out/
    python -m tessera sizes --config settings.json --output out/
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import tables
from tessera.plans import config, pipeline
from tessera.session import build_session
from tessera.sources import workbook


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """An aggregated table, as CSV or Parquet."""
    if path.endswith(".csv"):
        return tables.nan_to_null(workbook.typed(spark.read.csv(path, header=True, nullValue="", nanValue="nan")))
    return tables.nan_to_null(spark.read.parquet(path))


def analyse(spark: SparkSession, cfg: dict[str, Any], table: str | None = None, out: str | None = None) -> dict[str, int]:
    """Statistics and figures of an aggregated table."""
    where = config.layout(cfg)
    source = table or cfg["analysis_input_path"] or str(where["aggregated"])
    folder = Path(out) if out else where["plots"]
    folder.mkdir(parents=True, exist_ok=True)
    return pipeline.analyse(spark, cfg, read_cells(spark, source), folder)


def aggregate(spark: SparkSession, cfg: dict[str, Any]) -> dict[str, str]:
    """One table of all cells below the folder of results."""
    where = config.layout(cfg)
    root = Path(cfg["aggregation_input_dir"]) if cfg["aggregation_input_dir"] else where["datasets"]
    out = pipeline.aggregate(spark, cfg, pipeline.found_measurements(spark, cfg, root))
    where["aggregated"].parent.mkdir(parents=True, exist_ok=True)
    pipeline.write_table(out, str(where["aggregated"]), cfg["aggregation_format"])
    return {"output": str(where["aggregated"])}


def sizes(spark: SparkSession, cfg: dict[str, Any]) -> dict[str, int]:
    """The size report and histograms of the segmented objects of a run."""
    where = config.layout(cfg)
    return pipeline.size_stage(cfg, pipeline.Store(spark, where["datasets"]), where["size_statistics"])


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("analyse", "aggregate", "sizes"):
        one = sub.add_parser(name)
        if name == "analyse":
            one.add_argument("table", nargs="?", help="aggregated table, .csv or .parquet")
            one.add_argument("out", nargs="?", help="folder for statistics and figures")
            one.add_argument("--group-by")
            one.add_argument("--columns")
        one.add_argument("--config", help="settings JSON or the log of an earlier run")
        one.add_argument("--output", help="output folder of the run")
        one.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    args = ap.parse_args(argv)
    cfg = config.load(args.config) if args.config else config.defaults()
    if args.output:
        cfg["output_root"] = args.output
    for part in args.set:
        key, _, value = part.partition("=")
        cfg[key] = config.coerce(key, value)
    if args.command == "analyse":
        cfg |= {k: v for k, v in (("group_by", args.group_by), ("plot_columns", args.columns)) if v}
        if not args.table and not cfg["output_root"] and not cfg["analysis_input_path"]:
            print("give a table, or the output folder of a run", file=sys.stderr)
            return 2
    elif not cfg["output_root"]:
        print("give the output folder of a run", file=sys.stderr)
        return 2
    spark = build_session()
    print(analyse(spark, cfg, args.table, args.out) if args.command == "analyse" else {"aggregate": aggregate, "sizes": sizes}[args.command](spark, cfg))
    return 0
