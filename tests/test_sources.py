import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import images as im
from tessera.sources import planes as pl
from tessera.sources import tiff, workbook


def test_tiff_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for dtype in ("u1", "u2", "u4", "f4"):
        planes = [(rng.random((13, 17)) * 200).astype(dtype) for _ in range(3)]
        for compress in (True, False):
            p = tmp_path / "a.tif"
            p.write_bytes(tiff.encode(planes, "hello", compress))
            with open(p, "rb") as f:
                pages = tiff.read_directory(f)
                assert len(pages) == 3 and pages[0][270] == "hello"
                assert all(np.array_equal(tiff.read_page(f, q), a) for q, a in zip(pages, planes))


OME = """<?xml version="1.0"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Instrument ID="I:0">
<Objective ID="O:0" Model="Plan 20x" NominalMagnification="20" LensNA="0.8" Immersion="Air"/></Instrument>
<Image ID="Image:0" Name="B/03_Merged"><Pixels DimensionOrder="XYCZT" SizeX="9" SizeY="7" SizeC="2" SizeZ="2" SizeT="2" Type="uint16"
PhysicalSizeX="0.5" PhysicalSizeY="0.5" TimeIncrement="300" TimeIncrementUnit="s"><Channel ID="C:0" Name="DNA"/><Channel ID="C:1" Name="Edge"/><TiffData/></Pixels></Image></OME>"""


def test_image_source_prunes_and_projects(spark, tmp_path):
    rng = np.random.default_rng(2)
    planes = [(rng.random((7, 9)) * 1000).astype("u2") for _ in range(8)]
    p = tmp_path / "x.ome.tif"
    p.write_bytes(tiff.encode(planes, OME))
    meta = im.read_planes(spark, [str(p)], pixels=False)
    rows = meta.orderBy("t", "z", "c").collect()
    assert len(rows) == 8 and rows[0].scene == "B/03_Merged" and rows[0].pixels is None
    assert rows[1].channel_name == "Edge" and rows[0].frame_interval_min == 5.0 and rows[0].magnification == 20.0
    got = im.read_planes(spark, [str(p)]).where((F.col("t") == 1) & (F.col("c") == 1))
    assert sorted(np.frombuffer(r.pixels, "<f4").tolist() for r in got.collect()) == sorted(planes[i].astype("f4").ravel().tolist() for i in (5, 7))
    with pytest.raises(tiff.UnsupportedImage):
        list(pl.plane_rows("/x/a.czi"))


def strips(planes, tall, packed, predictor=1, wide=None):
    """A TIFF with strips of ``tall`` rows, or stored tiles of ``tall`` x ``wide`` pixels."""
    out, dirs = bytearray(b"II*\0\0\0\0\0"), []
    for a in planes:
        h, w = a.shape
        across, cols = (-(-w // wide), wide) if wide else (1, w)
        parts = []
        for i in range(-(-h // tall) * across):
            y, x = i // across * tall, i % across * cols
            p = a[y : y + tall, x : x + cols]
            if wide:
                p = np.pad(p, ((0, tall - p.shape[0]), (0, cols - p.shape[1])))
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=p.dtype.type(0))
            raw = np.ascontiguousarray(p).tobytes()
            raw = zlib.compress(raw) if packed else raw
            parts.append((len(out), len(raw)))
            out += raw
        lists = []
        for k in range(2):
            lists.append(len(out))
            out += b"".join(struct.pack("<I", p[k]) for p in parts)
        n = len(parts)
        place = lambda k: lists[k] if n > 1 else parts[0][k]
        where = [(322, cols, 1), (323, tall, 1), (324, place(0), n), (325, place(1), n)] if wide else [(273, place(0), n), (278, tall, 1), (279, place(1), n)]
        tags = sorted([(256, w, 1), (257, h, 1), (258, 8 * a.itemsize, 1), (259, 8 if packed else 1, 1), (277, 1, 1), (317, predictor, 1), *where])
        dirs.append(len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, c, v) for t, v, c in tags) + b"\0\0\0\0"
    for k, at in enumerate(dirs):
        n = struct.unpack_from("<H", out, at)[0]
        struct.pack_into("<I", out, at + 2 + 12 * n, dirs[k + 1] if k + 1 < len(dirs) else 0)
    struct.pack_into("<I", out, 4, dirs[0])
    return bytes(out)


@pytest.mark.parametrize("tall, packed, predictor, wide", [(5, False, 1, None), (5, True, 2, None), (37, True, 1, None), (16, True, 2, 16), (16, False, 1, 16), (1, False, 1, None)])
def test_regions_are_read_from_ranges(tmp_path, tall, packed, predictor, wide):
    a = np.random.default_rng(3).integers(0, 60000, (37, 41)).astype("u2")
    p = tmp_path / "a.tif"
    p.write_bytes(strips([a], tall, packed, predictor, wide))
    (row,) = pl.plane_rows(str(p))
    small, pl.CHUNK = pl.CHUNK, 64
    try:
        with open(p, "rb") as f:
            for y0, y1, x0, x1 in ((0, 37, 0, 41), (3, 4, 0, 41), (30, 37, 33, 41), (7, 25, 5, 29), (0, 0, 0, 3)):
                assert np.array_equal(pl.read_region(f, row["store"], 41, y0, y1, x0, x1), a[y0:y1, x0:x1])
            assert np.array_equal(tiff.read_page(f, tiff.read_directory(f)[0]), a)
    finally:
        pl.CHUNK = small


def untiled(t, layer, key):
    out = {}
    for r in t.df.collect():
        a = out.setdefault(tuple(r[k] for k in key), np.full((r.height, r.width), np.nan, "f4"))
        y, x = r.ty * t.size, r.tx * t.size
        h, w = min(t.size, r.height - y), min(t.size, r.width - x)
        a[y : y + h, x : x + w] = np.frombuffer(r[layer], "<f4").reshape(h, w)
    return out


def test_planes_of_several_tiles_are_never_whole(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    stack = rng.integers(0, 5000, (2, 2, 3, 45, 53)).astype("u2")  # t, c, z, y, x
    flat = [stack[t, c, z] for t in range(2) for z in range(3) for c in range(2)]
    ome = OME.replace('SizeZ="2"', 'SizeZ="3"').replace('SizeX="9" SizeY="7"', 'SizeX="53" SizeY="45"')
    (tmp_path / "a.ome.tif").write_bytes(tiff.encode(flat, ome))
    np.save(tmp_path / "b.npy", stack)
    (tmp_path / "c.tif").write_bytes(b"no image")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.ome.tif", "b.npy", "c.tif")], "path string")
    heads = pl.headers(paths, skip_unreadable=True)
    bad = heads.where("error is not null").collect()
    assert heads.count() == 25 and [r.path[-5:] for r in bad] == ["c.tif"] and "not a TIFF" in bad[0].error
    with pytest.raises(Exception, match="not a TIFF"):
        pl.headers(paths).count()
    good = heads.where("error is null")
    monkeypatch.setattr(pl, "PIECE", 512)  # two tiles of 16 x 16 at once
    for z, want in (("max", stack.max(2)), ("mean", stack.mean(2)), ("middle", stack[:, :, 1])):
        t = pl.read_tiles(good, ["path", "t"], [1, 0], 16, z)
        assert not t.single and t.df.count() == 2 * 2 * 3 * 4
        for c in (0, 1):
            for (path, i), a in untiled(t, f"c{c}", ["path", "t"]).items():
                assert np.allclose(a, want[i, c].astype("f4"), atol=1e-3), (path, z)
    slices = untiled(pl.read_tiles(good.where("t = 1"), ["path", "z"], [0], 64), "c0", ["path", "z"])
    assert all(np.array_equal(a, stack[1, 0, z].astype("f4")) for (_, z), a in slices.items()) and len(slices) == 6
    with pytest.raises(Exception, match="channel 7"):
        pl.read_tiles(good, ["path", "t"], [0, 7], 16).df.count()
    assert pl.read_tiles(good.where("c > 9"), ["path", "t"], [0], 16).df.count() == 0


def test_npy_and_listing(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.arange(2 * 5 * 6.0).reshape(2, 5, 6))
    (tmp_path / ".hidden.npy").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "a.npy", np.zeros((4, 4)))
    assert [r.name for r in im.list_files(spark, str(tmp_path)).collect()] == ["b.npy"]
    assert sorted(r.name for r in im.list_files(spark, str(tmp_path), True).collect()) == ["a.npy", "b.npy"]
    rows = im.read_planes(spark, [str(tmp_path / "b.npy")]).orderBy("c").collect()
    assert [r.c for r in rows] == [0, 1] and np.frombuffer(rows[1].pixels, "<f4")[0] == 30


def make_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        tabs = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{tabs}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for y, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{chr(65 + x)}{y}"><v>{v}</v></c>' if isinstance(v, (int, float))
                    else f'<c r="{chr(65 + x)}{y}" t="inlineStr"><is><t>{v}</t></is></c>' for x, v in enumerate(row) if v is not None
                )
                body += f'<row r="{y}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_plate_map(spark, tmp_path):
    p = str(tmp_path / "map.xlsx")
    make_xlsx(p, {
        "Treatment_Map": [["Plate", "well_row", "well_column", "Treatment"], [1, "a", 3, 240], [1, "B", 4, "DMSO"], [2, "A", 3, None]],
        "Compound_IDs": [["Treatment", "Source Name"], [240, "vehicle"]],
    })
    rows = {(r.Plate, r.well_id): (r.Treatment, r["Source Name"]) for r in workbook.load_plate_map(spark, p).collect()}
    assert rows == {(1, "A3"): ("240", "vehicle"), (1, "B4"): ("DMSO", None), (2, "A3"): (None, None)}


def test_scans(spark, tmp_path):
    for d in ("per_file/run_Plate2_Sample3", "per_file/run_Plate2_Sample3_1", "per_file/abc", "abc"):
        m = tmp_path / d / "measurements"
        m.mkdir(parents=True)
        (m / "x_cell_measurements.csv").write_text("cell_id,mean_A,scene\n1,nan,s\n2,3.5,s\n")
        (m / "._x_cell_measurements.csv").write_text("junk")
    from tessera.functions.text import DATASET_PATTERN

    got = {r.dataset: (r.plate, r.sample, r.rescan) for r in workbook.find_scans(spark, str(tmp_path), DATASET_PATTERN).collect()}
    assert got == {"run_Plate2_Sample3_1": (2, 3, 1), "abc": (None, None, None)}
    t = workbook.read_table(spark, str(tmp_path / "abc/measurements/x_cell_measurements.csv"), ["cell_id", "mean_A"])
    assert sorted((r.cell_id, r.mean_A) for r in t.collect()) == [(1, None), (2, 3.5)]
