"""The TIFF subset microscopes and label images use: planes, zlib or none, OME and ImageJ headers."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np

from tessera.functions.text import MINUTES

# Bytes per TIFF field type, and micrometres per length unit.
_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_MICRONS = {"µm": 1.0, "um": 1.0, "micron": 1.0, "microns": 1.0, "\\u00b5m": 1.0, "nm": 1e-3, "mm": 1e3, "cm": 1e4, "m": 1e6, "inch": 25400.0}
_SAMPLE = {1: "u", 2: "i", 3: "f"}


class UnsupportedImage(ValueError):
    pass


def read_directory(f) -> list[dict]:
    """The tag dictionaries of all pages, without pixel data."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise UnsupportedImage("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    pages = []
    while at:
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size, inline = (20, 8) if big else (12, 4)
        block = f.read(n * size)
        nxt = struct.unpack(order + ("Q" if big else "I"), f.read(8 if big else 4))[0]
        page = {"order": order}
        for i in range(n):
            e = block[i * size: (i + 1) * size]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4: 12 if big else 8])[0]
            length = count * _WIDTH.get(kind, 1)
            raw = e[-inline:][:length]
            if length > inline:
                f.seek(struct.unpack(order + ("Q" if big else "I"), e[-inline:])[0])
                raw = f.read(length)
            if kind == 2:
                page[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                v = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
                page[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])]
            elif kind in _CODE:
                page[tag] = list(struct.unpack(order + _CODE[kind] * count, raw))
        pages.append(page)
        at = nxt
    return pages


def page_shape(page: dict) -> tuple[int, int, str]:
    bits, form = page.get(258, [1])[0], page.get(339, [1])[0]
    return page[257][0], page[256][0], f"{page['order']}{_SAMPLE.get(form, 'u')}{bits // 8}"


def page_store(page: dict) -> dict:
    """Where the samples of a grey plane lie: strips or stored tiles, their packing and sample type."""
    h, w, dtype = page_shape(page)
    if page.get(277, [1])[0] != 1:
        raise UnsupportedImage("only one sample per pixel is supported")
    packing, predictor = page.get(259, [1])[0], page.get(317, [1])[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise UnsupportedImage(f"TIFF compression {packing} (predictor {predictor}) is not supported")
    tiled = 322 in page
    tall, wide = (page[323][0], page[322][0]) if tiled else (min(h, page.get(278, [h])[0]), w)
    offsets, counts = (page[324], page[325]) if tiled else (page[273], page[279])
    return {"dtype": dtype, "packing": packing, "predictor": predictor, "tall": tall, "wide": wide, "offsets": offsets, "counts": counts}


def read_page(f, page: dict) -> np.ndarray:
    """One grey plane."""
    from tessera.sources.planes import read_region

    h, w, _ = page_shape(page)
    return read_region(f, page_store(page), w, 0, h, 0, w)


def layout(pages: list[dict]) -> list[dict]:
    """Scenes of a file: name, axis sizes, (t, c, z) of every page, and what the header tells."""
    text = pages[0].get(270, "") or ""
    if "<OME" in text[:4000]:
        return _ome(text, pages)
    n, info = len(pages), {}
    if text.startswith("ImageJ="):
        info = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
    c, z, t = (int(info.get(k, 1)) for k in ("channels", "slices", "frames"))
    if c * z * t != n:
        c, z, t = 1, n if t == 1 else 1, n if t > 1 else 1
    unit = _MICRONS.get(info.get("unit", ""), None)
    size = None
    if unit and pages[0].get(283, [0])[0]:
        size = unit / pages[0][283][0]
    every = float(info["finterval"]) / 60 if float(info.get("finterval", 0) or 0) > 0 else None
    at = {i: (i // (c * z), i % c, (i // c) % z) for i in range(n)}
    return [{"scene": "Image:0", "sizes": (t, c, z), "pages": at, "pixel_size_um": size, "frame_interval_min": every,
             "channels": [f"Channel:0:{i}" for i in range(c)], "objective": {}}]


def _ome(text: str, pages: list[dict]) -> list[dict]:
    root = ET.fromstring(text.encode("utf-8"))

    def find(el, name):
        return [e for e in el.iter() if e.tag.split("}")[-1] == name]

    objectives = find(root, "Objective")
    ob = objectives[0].attrib if objectives else {}
    objective = {"name": ob.get("Model") or ob.get("ID"), "magnification": ob.get("NominalMagnification"),
                 "na": ob.get("LensNA"), "immersion": ob.get("Immersion")} if ob else {}
    out, offset = [], 0
    for i, image in enumerate(find(root, "Image")):
        p = find(image, "Pixels")[0]
        a = p.attrib
        sizes = {k: int(a.get(f"Size{k}", 1)) for k in "TCZ"}
        axes = [k for k in a.get("DimensionOrder", "XYZCT")[2:]]
        n = sizes["T"] * sizes["C"] * sizes["Z"]
        at = {}
        ifd = {int(td.get("IFD")): td.attrib for td in find(p, "TiffData") if td.get("IFD") is not None}
        first = min(ifd) if ifd else offset
        for j in range(n):
            rest, pos = j, {}
            for k in axes:
                pos[k] = rest % sizes[k]
                rest //= sizes[k]
            at[first + j] = (pos["T"], pos["C"], pos["Z"])
        for page, td in ifd.items():
            if int(td.get("PlaneCount", 1)) == 1 and len(ifd) == n:
                at[page] = tuple(int(td.get(f"First{k}", 0)) for k in "TCZ")
        offset = first + n
        size = a.get("PhysicalSizeY") or a.get("PhysicalSizeX")
        unit = _MICRONS.get(a.get("PhysicalSizeYUnit", "µm"), 1.0)
        step = a.get("TimeIncrement")
        per = MINUTES.get((a.get("TimeIncrementUnit") or "s").lower(), MINUTES["s"])
        names = [ch.get("Name") or ch.get("ID") or f"Channel:{i}:{c}" for c, ch in enumerate(find(p, "Channel"))]
        out.append({"scene": image.get("Name") or image.get("ID") or f"Image:{i}", "sizes": (sizes["T"], sizes["C"], sizes["Z"]),
                    "pages": at, "pixel_size_um": float(size) * unit if size else None,
                    "frame_interval_min": float(step) * per if step and float(step) > 0 else None,
                    "channels": names, "objective": objective})
    return out


def encode(planes: list[np.ndarray], description: str = "", compress: bool = True) -> bytes:
    """A multi-page TIFF with one strip per page."""
    out, pages = bytearray(b"II*\0\0\0\0\0"), []
    for i, a in enumerate(planes):
        a = np.ascontiguousarray(a)
        raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw) if compress else raw
        at = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        text = description.encode("utf-8") + b"\0" if i == 0 and description else b""
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, a.dtype.itemsize * 8), (259, 3, 8 if compress else 1),
                (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, a.shape[0]), (279, 4, len(raw)), (339, 3, form)]
        if text:
            tags.append((270, 2, text_at, len(text)))
        pages.append((len(out), sorted(tags)))
        out += b"\0" * (2 + 12 * len(tags) + 4)
    struct.pack_into("<I", out, 4, pages[0][0])
    for i, (at, tags) in enumerate(pages):
        struct.pack_into("<H", out, at, len(tags))
        for j, tag in enumerate(tags):
            count = tag[3] if len(tag) > 3 else 1
            struct.pack_into("<HHII", out, at + 2 + 12 * j, tag[0], tag[1], count, tag[2])
        struct.pack_into("<I", out, at + 2 + 12 * len(tags), pages[i + 1][0] if i + 1 < len(pages) else 0)
    return bytes(out)
