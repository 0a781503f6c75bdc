import numpy as np
from pyspark.sql import functions as F
from test_tiles import RNG, back, make

from tessera.operators import background as bg
from tessera.operators import segment as sg


def test_pooled_field_and_correction(spark):
    imgs = {1: {"v": RNG.random((17, 22)) + 1}, 2: {"v": RNG.random((19, 21)) + 1}}
    t = make(spark, imgs, 6, v="f8")
    row = bg.field_images(t, "v", [], 4, 0.0).collect()[0]
    got = np.frombuffer(row.field).reshape(row.height, row.width)
    small = [a["v"][: h // 4 * 4, : w // 4 * 4].reshape(h // 4, 4, w // 4, 4).mean((1, 3)) for a in imgs.values() for h, w in [a["v"].shape]]
    assert np.allclose(got, np.mean([s[:4, :5] for s in small], axis=0))

    fields = bg.as_fields(bg.field_images(t, "v", [], 4, 0.0))
    fixed = back(bg.correct(t, "v", fields), "v")
    f = got / got.mean()
    for i, a in imgs.items():
        h, w = a["v"].shape
        y, x = np.arange(h) * 3 / (h - 1), np.arange(w) * 4 / (w - 1)
        rows = np.stack([np.interp(x, np.arange(5), r) for r in f])
        full = np.stack([np.interp(y, np.arange(4), c) for c in rows.T], 1)
        assert np.allclose(fixed[i], a["v"] / full, rtol=1e-5)


def test_reference_field_rejects_offset_above_signal(spark):
    a = np.full((5, 6), 10.0)
    df = spark.createDataFrame([(0, 5, 6, bytearray(a.tobytes()), None)], "channel int, height int, width int, mean binary, dark binary")
    good = bg.reference_fields(df, "flatfield", 50.0, 2.0).collect()[0]
    assert np.allclose(np.frombuffer(good.field), 8.0) and good.operation == "divide" and good.offset == 2.0
    try:
        bg.reference_fields(df, "flatfield", 50.0, 20.0).collect()
    except Exception as e:
        assert "not positive" in str(e)
    else:
        raise AssertionError


def test_acquisition_messages(spark):
    df = spark.range(1)

    def side(mag, ps, h):
        return dict(magnification=F.lit(mag), na=F.lit(0.8), objective=F.lit("P"), pixel_size=F.lit(ps), height=F.lit(h),
                    width=F.lit(h), channel_names=F.array(F.lit("a")))

    got = df.select(bg.acquisition_messages(side(20.0, 0.5, 100), side(40.0, 0.25, 100)).alias("m")).first().m
    assert [m.level for m in got] == ["error", "error", "error"]
    got = df.select(bg.acquisition_messages(side(20.0, 0.5, 100), side(20.0, 0.25, 200)).alias("m")).first().m
    assert [(m.level, m.message[:10]) for m in got] == [("error", "pixel size"), ("info", "image size")]
    assert sg.LABEL
