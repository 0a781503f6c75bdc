"""Label images as files: a writable Spark data source that streams tiles into TIFF files.

Rows come sorted by file, page and tile, so a task holds one tile: it is packed, appended, and forgotten; the page directories follow at
the end.  A task writes hidden files of its run; they get their names when the job is committed, and none of them is left when it
fails, whatever became of its tasks.
"""

from __future__ import annotations

import dataclasses
import io
import os
import struct
import uuid
import zlib
from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.operators.tiles import Tiles
from tessera.session import look_up

#: ``height`` and ``width`` are the file's, ``rows`` and ``columns`` the tile's; ``top`` is the largest label of the file.
SCHEMA = "file string, page int, pages int, ty int, tx int, height int, width int, rows int, columns int, top bigint, pixels binary"


class Folder:
    """A folder of a mounted file system, or of one that pyarrow knows by its address."""

    def __init__(self, where: str):
        from pyarrow import fs

        self.local = "://" not in where
        self.system, self.base = (fs.LocalFileSystem(), os.path.abspath(where)) if self.local else fs.FileSystem.from_uri(where)
        self.system.create_dir(self.base, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def create(self, name: str):
        return open(self.path(name), "w+b") if self.local else io.BytesIO()

    def finish(self, name: str, f) -> None:
        if not self.local:  # packed labels are small; a store without seeking gets them at once
            with self.system.open_output_stream(self.path(name)) as out:
                out.write(f.getbuffer())
        f.close()

    def rename(self, old: str, new: str) -> None:
        self.system.move(self.path(old), self.path(new))

    def remove(self, prefix: str) -> None:
        from pyarrow import fs

        for info in self.system.get_file_info(fs.FileSelector(self.base)):
            if info.base_name.startswith(prefix):
                self.system.delete_file(info.path)


class Pages:
    """A TIFF of stored tiles that is written in one go."""

    def __init__(self, f, pages: int, height: int, width: int, size: int, dtype: str):
        self.f, self.pages, self.h, self.w, self.size, self.dtype = f, pages, height, width, size, np.dtype(dtype).newbyteorder("<")
        # offsets of 32 bits reach 4 GB; packed data are never much longer than the pixels
        self.big = pages * height * width * self.dtype.itemsize > 3 << 30
        self.down, self.across = -(-height // size), -(-width // size)
        self.places: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.blank: tuple[int, int] | None = None
        f.write(b"II+\0\x08\0\0\0" + b"\0" * 8 if self.big else b"II*\0" + b"\0" * 4)

    def _append(self, a: np.ndarray) -> tuple[int, int]:
        raw = zlib.compress(np.ascontiguousarray(a, self.dtype).tobytes())
        at = self.f.tell()
        self.f.write(raw)
        return at, len(raw)

    def add(self, page: int, ty: int, tx: int, a: np.ndarray) -> None:
        if ty < self.down and tx < self.across:
            part = np.zeros((self.size, self.size), self.dtype)
            a = a[: self.h - ty * self.size, : self.w - tx * self.size]
            part[: a.shape[0], : a.shape[1]] = a
            self.places[page, ty, tx] = self._append(part)

    def close(self) -> None:
        offset, count, entry, inline = ("<Q", "<Q", "<HHQ", 8) if self.big else ("<I", "<H", "<HHI", 4)
        link = 8 if self.big else 4
        for page in range(self.pages):
            tiles = []
            for i in range(self.down * self.across):
                at = self.places.get((page, i // self.across, i % self.across))
                if at is None:  # pixels without a row are black
                    self.blank = self.blank or self._append(np.zeros((self.size, self.size), self.dtype))
                    at = self.blank
                tiles.append(at)
            lists = []
            for k in range(2):
                lists.append(self.f.tell())
                self.f.write(b"".join(struct.pack(offset, t[k]) for t in tiles))
            kind, n = 16 if self.big else 4, len(tiles)
            tags = [(256, 4, 1, self.w), (257, 4, 1, self.h), (258, 3, 1, 8 * self.dtype.itemsize), (259, 3, 1, 8), (262, 3, 1, 1), (277, 3, 1, 1),
                    (322, 4, 1, self.size), (323, 4, 1, self.size), (324, kind, n, lists[0] if n > 1 else tiles[0][0]), (325, kind, n, lists[1] if n > 1 else tiles[0][1]), (339, 3, 1, 1)]
            here = self.f.tell()
            self.f.seek(link)
            self.f.write(struct.pack(offset, here))
            self.f.seek(here)
            self.f.write(struct.pack(count, len(tags)))
            for tag, type_, m, v in tags:
                self.f.write(struct.pack(entry, tag, type_, m) + struct.pack("<Q" if inline == 8 else "<I", v))
            link = self.f.tell()
            self.f.write(struct.pack(offset, 0))


@dataclasses.dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class LabelWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.size, self.dtype, self.run = options["path"], int(options["size"]), options["dtype"], options["run"]
        self.mask = str(options.get("mask", "false")).lower() == "true"
        self.ending, *self.replaced = options.get("endings", "").split(",")

    def write(self, iterator):
        folder, made = Folder(self.folder), []
        task = uuid.uuid4().hex
        for file, rows in groupby(iterator, key=lambda r: r.file):
            hidden = f".{self.run}-{task}-{len(made)}"
            made.append((hidden, file))
            f, out = folder.create(hidden), None
            for r in rows:
                if out is None:
                    out = Pages(f, r.pages, r.height, r.width, self.size, "u1" if self.mask else "u2" if r.top < 65535 else "u4")
                a = np.frombuffer(r.pixels, self.dtype).reshape(r.rows, r.columns)
                out.add(r.page, r.ty, r.tx, np.where(a > 0, 255, 0) if self.mask else a)
            out.close()
            folder.finish(hidden, f)
        return Written(made)

    def commit(self, messages):
        folder = Folder(self.folder)
        for m in messages:
            for hidden, file in m.files if m else ():
                folder.rename(hidden, file)
                for ending in self.replaced:  # of an earlier run that made other objects
                    folder.remove(file.removesuffix(self.ending) + ending)
        folder.remove(f".{self.run}-")  # of tasks that were lost or ran twice

    def abort(self, messages):
        Folder(self.folder).remove(f".{self.run}-")


class LabelSource(DataSource):
    @classmethod
    def name(cls):
        return "tessera_labels"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return LabelWriter(self.options)


def write_labels(t: Tiles, layer: str, folder: str, stem: Column, ending: str, page: str | None = None, mask: bool = False, replaced: Sequence[str] = ()) -> None:
    """One file ``stem + ending`` per image, or per series of images along the key ``page``; missing pages are black.

    Pages of unlike sizes are cut to what they share.  Files of the same stem with an ending in ``replaced`` are removed.
    """
    spark, size, dtype = t.df.sparkSession, t.size, t.layers[layer]
    spark.dataSource.register(LabelSource)

    def largest(b):
        return {"height": [b.height], "width": [b.width], "top": [int(b[layer].max(initial=0))]}

    name = F.concat(stem, F.lit(ending)).alias("file")
    number = F.col(page).cast("int") if page else F.lit(0)
    facts = t.select(layer).rows([layer], "height int, width int, top bigint", largest).groupBy(name).agg(
        F.min("height").alias("height"), F.min("width").alias("width"), F.max("top").alias("top"), F.min(number).alias("__first"), (F.max(number) - F.min(number) + 1).alias("pages"),
    )
    side_ = lambda n, at: F.least(F.lit(size), F.col(n) - F.col(at) * size)
    tiles = t.df.select(name, number.alias("__page"), "ty", "tx", side_("height", "ty").alias("rows"), side_("width", "tx").alias("columns"), F.col(layer).alias("pixels"))
    rows = look_up(tiles, facts, ["file"]).select("file", (F.col("__page") - F.col("__first")).alias("page"), "pages", "ty", "tx", "height", "width", "rows", "columns", "top", "pixels")
    sorted_ = rows.repartition("file").sortWithinPartitions("file", "page", "ty", "tx")
    made = sorted_.write.format("tessera_labels").mode("append").option("path", folder).option("size", size).option("dtype", dtype).option("run", uuid.uuid4().hex)
    made.option("mask", str(mask).lower()).option("endings", ",".join([ending, *replaced])).save()
