"""Statistics against numpy and worked examples, with a group that holds a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import ordering
from tessera.functions.ordering import order_key
from tessera.functions.probability import exact_rank_sum_two_sided, student_two_sided
from tessera.functions.register import register_functions
from tessera.functions import ordering
from tessera.operators import prefix, summary

RNG = np.random.default_rng(9)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, a missing group, repeats, NaN, negative and huge values."""
    n = 3000
    g = np.where(np.arange(n) % 3 == 0, "hot", np.array([f"g{i % 40}" for i in range(n)]))
    v = np.round(RNG.normal(0, 50, n), 1) * np.where(RNG.random(n) < 0.01, 1e12, 1)
    pdf = pd.DataFrame({"g": g, "v": v})
    pdf.loc[::97, "v"] = np.nan
    pdf.loc[pdf.index % 50 == 7, "g"] = None
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf["g"].notna() | True), "g string, v double").cache()


def test_order_key(spark):
    x = np.concatenate([RNG.normal(0, 1, 500) * 10.0 ** RNG.integers(-300, 300, 500), [0.0, -0.0, 1.0, 5e-324, -5e-324, np.inf, -np.inf, 1024.0, np.nextafter(1024, 0)],
                        2.0 ** np.arange(-1074, 1024)])
    d = spark.createDataFrame([(float(a),) for a in x], "x double").select("x", order_key(F.col("x")).alias("k")).toPandas()
    bits = np.abs(d["x"].to_numpy()).view(np.int64)
    assert (np.where(d["x"] < 0, -bits, bits) == d["k"]).all()


@pytest.mark.parametrize("spread", [True, False])
def test_quantiles(skewed, spread):
    pdf, df = skewed
    got = {r.g: (r.a, r.b, r.c) for r in prefix.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.98}, spread).collect()}
    want = {None if pd.isna(k) else k: np.percentile(x.dropna(), [25, 50, 98]) for k, x in pdf.groupby("g", dropna=False)["v"]}
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-9)
    one = prefix.quantiles(df, [], "v", {"m": 0.5}, spread).first()
    assert np.isclose(one.m, pdf["v"].median())


@pytest.mark.parametrize("spread", [True, False])
def test_running_totals_and_minima(skewed, spread):
    pdf, df = skewed
    c = prefix.running_below(prefix.value_counts(df, ["g"], "v"), ["g"], "v", spread=spread)
    for k, part in c.toPandas().groupby("g", dropna=False):
        x = pdf.loc[pdf["g"].isna() if pd.isna(k) else pdf["g"] == k, "v"].dropna().to_numpy()
        assert all((x < v).sum() == b and len(x) == t for v, b, t in zip(part["v"], part["cnt_below"], part["cnt_total"]))
    m = prefix.running_min_from_above(c.withColumn("w", F.abs(F.col("v") - 10)), ["g"], "v", "w", spread).toPandas()
    hot = m[m["g"] == "hot"].sort_values("v")
    want = np.minimum.accumulate(np.abs(hot["v"].to_numpy() - 10)[::-1])[::-1]
    assert np.allclose(hot["w_min_above"], want)


def bh(p):
    p = np.asarray(p, float)
    ok = np.nonzero(~np.isnan(p))[0]
    order = ok[np.argsort(p[ok])]
    q = np.minimum.accumulate((p[order] * len(order) / np.arange(1, len(order) + 1))[::-1])[::-1]
    out = np.full(len(p), np.nan)
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("spread", [True, False])
def test_adjusted_p(spark, spread):
    rows = [("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("f", 0.5), ("f", 0.2)]
    rows += [("h", float(x)) for x in np.round(RNG.random(400), 2)] + [(None, 0.3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, p double")
    got = summary.adjust_p(df, ["f"], "p", "q", spread).orderBy("i").toPandas()
    assert len(got) == len(rows)
    assert np.allclose(got["q"][:6], [0.05, 0.2 / 3, 0.2 / 3, np.nan, 0.5, 0.25], equal_nan=True)
    assert np.allclose(got["q"][6:406], bh([r[1] for r in rows[6:406]])) and got["q"].iloc[406] == 0.3


@pytest.mark.parametrize("spread", [True, False])
def test_rank_sum_and_welch_worked(spark, spread):
    x, y = [1, 2, 2, 3, 5], [2, 4, 4, 6, 7, 8]
    df = spark.createDataFrame([("c", "x", float(v)) for v in x] + [("c", "y", float(v)) for v in y], "column string, g string, value double")
    r = summary.rank_sums(df, "g", F.col("g") == "y", spread)
    r = r.withColumn("z", summary.rank_sum_z(*[F.col(c) for c in ("u", "n1", "n2", "tie_term")])).withColumn(
        "p", summary.rank_sum_p("u", "n1", "n2", "tie_term")
    ).first()
    assert (r.n1, r.n2, r.tie_term) == (5, 6, 30) and min(r.u, 30 - r.u) == 5
    assert round(r.z, 6) == 1.754507 and round(r.p, 6) == 0.079344
    assert round(student_two_sided(-2.261773, 8.730881), 6) == 0.050901
    assert round(student_two_sided(2.228139, 10), 6) == 0.05
    assert np.isclose(exact_rank_sum_two_sided(0, 3, 3), 0.1)
    register_functions(spark)
    assert round(spark.sql("select mannwhitney_p(5D, 5L, 6L, 30D) p").first().p, 6) == 0.079344


@pytest.mark.parametrize("spread", [True, False])
def test_summary_table(spark, spread):
    n = 600
    pdf = pd.DataFrame({
        "t": np.array(["ctl", "a", "b", "tiny"])[np.where(np.arange(n) < 5, 3, np.arange(n) % 3)],
        "rep": [f"r{i % 7}" for i in range(n)], "v": np.round(RNG.normal(5, 2, n), 1), "w": RNG.random(n),
    })
    pdf["is_control"] = pdf["t"].isin(["ctl", "tiny"])
    pdf.loc[::31, "v"] = np.nan
    out = summary.summarise(spark.createDataFrame(pdf), "t", ["v", "w"], "rep", min_cells=20, spread=spread).toPandas()
    assert sorted(out["group"].unique()) == ["a", "b", "ctl"] and len(out) == 6
    ctl = pdf[pdf["is_control"]]
    for _, r in out.iterrows():
        x = pdf.loc[pdf["t"] == r["group"], [r["column"], "rep"]].dropna()
        v, reps = x[r["column"]], x.groupby("rep")[r["column"]].median()
        assert r["n_cells"] == len(v) and r["n_replicates"] == len(reps)
        assert np.allclose([r["mean"], r["median"], r["std"], r["q25"], r["q75"]], [v.mean(), v.median(), v.std(), v.quantile(0.25), v.quantile(0.75)])
        assert np.allclose([r["replicate_median_mean"], r["replicate_median_sd"]], [reps.mean(), reps.std()])
        c = ctl[r["column"]].dropna()
        assert np.isclose(r["median_ratio_vs_ctrl"], v.median() / c.median()) and np.isclose(r["median_diff_vs_ctrl"], v.median() - c.median())
        if r["is_control"]:
            assert pd.isna(r["p_cells_mannwhitney"]) and pd.isna(r["q_cells_BH"])
        else:
            u = sum((v.to_numpy()[:, None] > c.to_numpy()).sum(1) + 0.5 * (v.to_numpy()[:, None] == c.to_numpy()).sum(1))
            both = np.concatenate([v, c])
            _, k = np.unique(both, return_counts=True)
            N = len(both)
            sd = np.sqrt(len(v) * len(c) / 12 * ((N + 1) - (k**3.0 - k).sum() / (N * (N - 1))))
            from math import erfc, sqrt

            z = (max(u, len(v) * len(c) - u) - len(v) * len(c) / 2 - 0.5) / sd
            assert np.isclose(r["p_cells_mannwhitney"], min(1, erfc(z / sqrt(2))))
    for col in ("v", "w"):
        p = out[out["column"] == col]
        assert np.allclose(p["q_cells_BH"], bh(p["p_cells_mannwhitney"]), equal_nan=True)
        assert np.allclose(p["q_replicates_BH"], bh(p["p_replicates_welch"]), equal_nan=True)


def test_robust_shift_scale_falls_back(spark):
    df = spark.createDataFrame([("c", True, 1.0, 1.0)] * 3 + [("c", True, 1.0, 5.0), ("a", False, 4.0, 9.0)], "g string, is_control boolean, v double, w double")
    got = {(r.g, r["column"]): r["shift"] for r in summary.robust_shift(df, "g", ["v", "w"]).collect()}
    assert got["a", "v"] == 3.0  # no spread at all: scale one
    assert np.isclose(got["a", "w"], 8 / np.std([1, 1, 1, 5], ddof=1))  # zero MAD: sample sd


def test_quantiles_of_groups_of_all_sizes(spark, monkeypatch):
    # small groups as lists, large ones by buckets, a row moved once for all columns
    monkeypatch.setattr(prefix, "GROUP_ROWS", 20)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"column": rng.choice(["a", "b", "c", None], 3000, p=[0.9, 0.09, 0.005, 0.005]), "l": rng.integers(0, 2, 3000)})
    pdf["v"] = np.where(rng.random(3000) < 0.1, np.nan, np.round(rng.normal(0, 3, 3000), 1))
    pdf["w"] = np.where(pdf["column"] == "b", 1.0 + rng.random(3000) * 2**-20, 0.0)
    pdf["x"] = np.where(pdf["column"] == "a", np.nan, rng.choice([-1e300, -5e-324, 0.0, 5e-324, 1e300], 3000))
    probs = {"a": 0.0, "b": 0.5, "c": 0.98}
    for c in "vwx":
        one = prefix.quantiles(spark.createDataFrame(pdf), ["column", "l"], c, probs, True).toPandas()
        want = {(k, j): np.nanquantile(g[c], list(probs.values())) for (k, j), g in pdf.groupby(["column", "l"], dropna=False) if g[c].notna().any()}
        got = {(r.column, r.l): (r.a, r.b, r.c) for r in one.itertuples()}
        assert len(got) == len(want)
        for (k, j), q in want.items():
            assert got[None if k is None or k != k else k, j] == pytest.approx(q)
    every = prefix.column_quantiles(spark.createDataFrame(pdf).withColumnRenamed("column", "g"), ["g"], ["v", "w", "x"], probs, True)
    short = prefix.column_quantiles(spark.createDataFrame(pdf).withColumnRenamed("column", "g"), ["g"], ["v", "w", "x"], probs, False)
    got, want = ({(r.g, r.column): (r.a, r.b, r.c) for r in f.collect()} for f in (every, short))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(q) for k, q in want.items())


def test_buckets_never_fall(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-320, 308, 500), 2.0 ** np.arange(-1074, 1024, 7), [0.0, np.inf, 1.7976931348623157e308]])
    x = np.sort(np.concatenate([x, -x, np.nextafter(x, np.inf), np.nextafter(x, -np.inf)]))
    x = x[~np.isnan(x)]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "v": x}))
    got = df.select("i", ordering.log_bucket(F.col("v")).alias("b")).orderBy("i").toPandas()["b"].to_numpy()
    assert (np.diff(got) >= 0).all() and len(np.unique(got)) > 700


def test_medians_move_a_row_once_for_all_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": [1, 1, 2], "v": [1.0, 2.0, 3.0], "w": [4.0, None, 6.0]}))
    out = prefix.column_quantiles(df, ["g"], ["v", "w"], {"m": 0.5}, True)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    # before, every row was copied for each column first
    assert sorted(map(tuple, out.collect())) == [(1, "v", 1.5), (1, "w", 4.0), (2, "v", 3.0), (2, "w", 6.0)]
