"""Run registered queries against their SQL: python tests/compare.py [sf] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def frames_differ(a: pd.DataFrame, b: pd.DataFrame):
    """None when equal as bags of rows, else a short reason."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    cols = sorted(a.columns)
    kinds = [(c, a[c].dtype, b[c].dtype) for c in cols if str(a[c].dtype) != str(b[c].dtype)]

    def rows(f):
        def norm(v):
            if v is None or v is pd.NA or v is pd.NaT:
                return "None"
            if isinstance(v, float):
                return "None" if v != v else repr(float(v))
            if hasattr(v, "item"):
                v = v.item()
                return "None" if v != v else repr(float(v)) if isinstance(v, float) else repr(v)
            return repr(v)

        return sorted(tuple(norm(v) for v in r) for r in f[cols].itertuples(index=False))

    ra, rb = rows(a), rows(b)
    if ra != rb:
        bad = [(x, y) for x, y in zip(ra, rb) if x != y]
        return f"{len(bad)} rows differ, first {bad[0]} kinds {kinds}"
    return None if not kinds else f"equal, but kinds {kinds}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    import __spark_entry__ as e
    from tessera.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = database(sf_dir)
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in only or qs:
        t = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
            took = time.time() - t
            why = frames_differ(got, con.execute(sql[name]).df()) if name in sql else "(no sql)"
        except Exception as ex:  # noqa: BLE001
            why, took, got = "ERROR " + str(ex)[:600], time.time() - t, []
        bad += why is not None and not why.startswith("(")
        print(f"{name:34s} {took:6.2f}s {len(got):7d} rows  {why or 'ok'}", flush=True)
    print("bad:", bad)
