"""Images as tables of tiles, and operators that need a pixel's surroundings.

A tile is one row: image keys, tile position, image size, and one binary column per layer.
An operator that looks ``halo`` pixels around ships tile edges to the neighbouring tiles
(one shuffle), so an image of any size is spread over tasks and memory per task is one
tile.  Results that depend on far pixels (floods, components) repeat that step until no
tile changes.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from tessera.session import bounded_batches, cut, deal, look_up

POSITION = ("ty", "tx", "height", "width")


def gather(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group with its values as parallel lists, for groups of a known size.

    Unlike a function per group, many small groups share one Arrow batch.
    """
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("__s"))
    return packed.select(*keys, *[F.col("__s")[c].alias(c) for c in columns])


#: A Python worker hands its rows on as soon as it holds so many rows or bytes, and opens so many input rows at a time.
HELD_ROWS, HELD_BYTES, OPENED_ROWS = 16384, 8 << 20, 256

#: Functions that repeat until nothing changes work in blocks of tiles of at most this height and width.
BLOCK = 256


def _records(pdf: pd.DataFrame):
    for i in range(0, len(pdf), OPENED_ROWS):
        yield from pdf.iloc[i:i + OPENED_ROWS].to_dict("records")


def chained(head: Callable | None, steps: Sequence[Callable], finish: Callable, schema: StructType) -> Callable:
    """For ``mapInPandas``: rows opened by ``head``, passed through ``steps`` and turned by ``finish`` into equally long columns.

    What a worker holds does not depend on the rows of a batch or on how many rows come of one.
    """
    opened, steps, columns = head or _records, tuple(steps), schema.fieldNames()
    blobs = [f.name for f in schema if isinstance(f.dataType, BinaryType)]

    def run(batches):
        held: dict = {c: [] for c in columns}
        rows = weight = 0
        for pdf in batches:
            for row in opened(pdf):
                for step in steps:
                    row = step(row)
                made = finish(row)
                for c in columns:
                    held[c].extend(made[c])
                rows += len(made[columns[0]])
                weight += sum(len(v or b"") for c in blobs for v in made[c])
                if rows >= HELD_ROWS or weight >= HELD_BYTES:
                    yield pd.DataFrame(held, columns=columns)
                    held = {c: [] for c in columns}
                    rows = weight = 0
        if rows:
            yield pd.DataFrame(held, columns=columns)

    return run


@dataclasses.dataclass(frozen=True)
class Chain:
    """How the rows of a table of tiles come about: rows of ``source``, opened by ``head``, passed through ``steps``.

    Functions that need nothing of another tile are put behind each other in one Python worker; a table of its own for each
    would keep one more worker per core alive and send every tile through all of them.
    """

    source: DataFrame
    head: Callable | None = None
    steps: tuple[Callable, ...] = ()
    scalars: Mapping[str, str] = dataclasses.field(default_factory=dict)  # plain column -> its name in ``source``
    placed: bool = True  # ``source`` has one row per tile, with ``ty`` and ``tx``


def _shape(row, size: int) -> tuple[int, int, int, int]:
    y, x = row["ty"] * size, row["tx"] * size
    return y, x, min(size, row["height"] - y), min(size, row["width"] - x)


def _array(value, dtype: str, h: int, w: int) -> np.ndarray:
    if isinstance(value, (bytes, bytearray)):
        value = np.frombuffer(value, dtype)
    return np.array(value, dtype).reshape(h, w)


def _bytes(value, dtype: str):
    if value is None or isinstance(value, bytes):
        return value
    return np.ascontiguousarray(value, dtype=dtype).tobytes()


class Block:
    """What a tile function sees: the tile, its surroundings, and where they are."""

    def __init__(self, key, ty, tx, height, width, size, halo, arrays):
        self.key, self.ty, self.tx = key, ty, tx
        self.height, self.width, self.halo = height, width, halo
        self.core_y, self.core_x = ty * size, tx * size
        self.core_h = min(size, height - self.core_y)
        self.core_w = min(size, width - self.core_x)
        self.y0, self.x0 = max(0, self.core_y - halo), max(0, self.core_x - halo)
        self.arrays = arrays

    def __getitem__(self, layer):
        return self.arrays[layer]

    @property
    def core(self):
        dy, dx = self.core_y - self.y0, self.core_x - self.x0
        return slice(dy, dy + self.core_h), slice(dx, dx + self.core_w)

    def padded(self, layer, mode="edge", **kw):
        """The layer with a full halo; beyond the image it is padded."""
        a = self.arrays[layer]
        top, left = self.halo - (self.core_y - self.y0), self.halo - (self.core_x - self.x0)
        bottom = self.halo + self.core_h + self.halo - top - a.shape[0]
        right = self.halo + self.core_w + self.halo - left - a.shape[1]
        return np.pad(a, ((top, bottom), (left, right)), mode=mode, **kw)

    def positions(self):
        """Flat index plus one of every pixel of the surroundings (row-major in the image)."""
        h, w = next(iter(self.arrays.values())).shape
        y = np.arange(self.y0, self.y0 + h, dtype=np.int64)[:, None]
        return y * self.width + np.arange(self.x0, self.x0 + w, dtype=np.int64)[None, :] + 1


@dataclasses.dataclass(frozen=True)
class Tiles:
    df: DataFrame
    keys: tuple[str, ...]
    size: int
    layers: Mapping[str, str]  # layer -> numpy dtype
    single: bool = False  # every image fits one tile
    chain: Chain | None = None  # None: ``df`` is read as it is

    def _position(self) -> list[StructField]:
        return [self.df.schema[k] for k in self.keys] + [StructField(p, IntegerType()) for p in POSITION]

    def select(self, *layers: str) -> Tiles:
        return dataclasses.replace(
            self, df=self.df.select(*self.keys, *POSITION, *layers), layers={n: self.layers[n] for n in layers}
        )

    def _with(self, df: DataFrame, layers: Mapping[str, str]) -> Tiles:
        return dataclasses.replace(self, df=df, layers=dict(layers), chain=None)

    def _open(self) -> Chain:
        plain = [c for c in self.df.columns if c not in (*self.keys, *POSITION, *self.layers)]
        return self.chain or Chain(self.df, scalars={c: c for c in plain})

    def _close(self, chain: Chain, layers: Mapping[str, str], counters: Sequence[str] = (), plain: Sequence[StructField] = ()) -> Tiles:
        """The table that ``chain`` makes."""
        layers, scalars = dict(layers), dict(chain.scalars)
        schema = StructType(
            self._position() + [StructField(n, BinaryType()) for n in layers] + [StructField(n, LongType()) for n in counters] + list(plain)
        )
        meta, extra = [*self.keys, *POSITION, *counters], [f.name for f in plain]

        def finish(row):
            out = {c: [row[c]] for c in meta}
            out.update({n: [_bytes(row[n], d)] for n, d in layers.items()})
            out.update({n: [row[scalars[n]]] for n in extra})
            return out

        df = chain.source.mapInPandas(chained(chain.head, chain.steps, finish, schema), schema)
        return dataclasses.replace(self, df=df, layers=layers, chain=chain)

    def join(self, other: Tiles) -> Tiles:
        """Layers of both tables side by side."""
        on = [*self.keys, *POSITION]
        return self._with(self.df.join(other.df, on), {**self.layers, **other.layers})

    def cut(self) -> Tiles:
        return self._with(cut(self.df), self.layers)

    # ------------------------------------------------------------------ blocks

    def in_blocks(self, run: Callable[[Tiles], Tiles], limit: int | None = None) -> Tiles:
        """``run`` on tiles that are joined to blocks of at most ``limit`` pixels in height and width, cut up again afterwards.

        For functions whose results do not depend on tile borders: what lies within one block needs no further round, and an
        image of one block none at all.  A task holds one block.
        """
        side = (BLOCK if limit is None else limit) // self.size
        if self.single or side < 2:
            return run(self)
        return run(self._joined(side))._cut_up(self.size)

    def _joined(self, side: int) -> Tiles:
        """The layers in tiles of ``side`` times the height and width."""
        small, size, dtypes = self.size, self.size * side, dict(self.layers)
        meta = [*self.keys, *POSITION]
        top = self._open().source.agg(F.max("height"), F.max("width")).first()
        at = [(F.floor(F.col(c) / side)).cast("int").alias(c) for c in ("ty", "tx")]
        inner = [(F.col(c) % side).cast("int").alias(f"__{c}") for c in ("ty", "tx")]
        parts = self.df.select(*self.keys, *at, "height", "width", *inner, *dtypes)
        # at most side * side tiles meet in one group
        source = gather(parts, meta, ["__ty", "__tx", *dtypes])

        def head(pdf):
            for row in _records(pdf):
                _, _, h, w = _shape(row, size)
                made = {n: np.zeros((h, w), d) for n, d in dtypes.items()}
                for i, (ty, tx) in enumerate(zip(row["__ty"], row["__tx"])):
                    y, x = ty * small, tx * small
                    th, tw = min(small, h - y), min(small, w - x)
                    for n, d in dtypes.items():
                        made[n][y: y + th, x: x + tw] = _array(row[n][i], d, th, tw)
                yield {**row, **made}

        joined = dataclasses.replace(self, size=size, single=top[0] is not None and max(top) <= size, df=self.df.select(*self.keys))
        return joined._close(Chain(source, head), dtypes)

    def _cut_up(self, size: int) -> Tiles:
        """The layers in tiles of ``size``, which divides the present one."""
        big, dtypes = self.size, dict(self.layers)

        def head(pdf):
            for row in _records(pdf):
                y, x, h, w = _shape(row, big)
                arrays = {n: _array(row[n], d, h, w) for n, d in dtypes.items()}
                for dy in range(0, h, size):
                    for dx in range(0, w, size):
                        at = slice(dy, dy + size), slice(dx, dx + size)
                        yield {**row, "ty": (y + dy) // size, "tx": (x + dx) // size, **{n: a[at] for n, a in arrays.items()}}

        small = dataclasses.replace(self, size=size, single=False)
        return small._close(Chain(self.df.select(*self.keys, *POSITION, *dtypes), head, placed=False), dtypes)

    # ------------------------------------------------------------------ tile functions

    def transform(
        self, inputs: Sequence[str], outputs: Mapping[str, str], fn: Callable, halo: int = 0,
        counters: Sequence[str] = (), per_image: Sequence[str] = (), only: str | None = None,
    ) -> Tiles:
        """``fn(block)`` returns a dict of core arrays (``outputs``) and integer ``counters``.

        Other layers stay as they are.  ``per_image`` names plain columns of the table the
        function reads as scalars (a threshold, for example).  ``only`` names a boolean column:
        tiles where it is false lend their edges and are not computed.
        """
        keep = [n for n in self.layers if n not in outputs]
        layers = {**{n: self.layers[n] for n in keep}, **outputs}
        size, made_as = self.size, dict(outputs)

        def made(block, row):
            got = fn(block)
            out = dict(row)
            for name, dtype in made_as.items():
                out[name] = np.ascontiguousarray(got[name], dtype=dtype).reshape(_shape(row, size)[2:])
            for name in counters:
                out[name] = int(got[name])
            return out

        if halo == 0 or self.single:
            chain = (self._with(self.df.where(only), self.layers) if only else self)._open()
            block_of = self._block_of(inputs, halo, per_image, chain.scalars)
            chain = dataclasses.replace(chain, steps=(*chain.steps, lambda row: made(block_of(row), row)))
            return self._close(chain, layers, counters)

        source, assembled = self._surrounded(list(inputs), keep, halo, per_image, only)

        def head(pdf):
            for block, row in assembled(pdf):
                yield made(block, row)

        return self._close(Chain(source, head), layers, counters)

    def rows(self, inputs: Sequence[str], schema: StructType | str, fn: Callable, halo: int = 0,
             per_image: Sequence[str] = ()) -> DataFrame:
        """``fn(block)`` returns a dict of equally long columns; the image keys are added."""
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        full = StructType([self.df.schema[k] for k in self.keys] + list(schema))
        names, keys = schema.fieldNames(), list(self.keys)

        def listed(block, row):
            made = fn(block)
            return {**{k: [row[k]] * len(made[names[0]]) for k in keys}, **{n: made[n] for n in names}}

        if halo == 0 or self.single:
            chain = self._open()
            block_of = self._block_of(inputs, halo, per_image, chain.scalars)
            run = chained(chain.head, chain.steps, lambda row: listed(block_of(row), row), full)
            return chain.source.mapInPandas(run, full)
        source, assembled = self._surrounded(list(inputs), [], halo, per_image, None)
        return source.mapInPandas(chained(assembled, (), lambda met: listed(*met), full), full)

    def _block_of(self, inputs, halo, per_image, scalars) -> Callable:
        """A function from the row of a tile to its block, for functions that need nothing of another tile."""
        keys, size = list(self.keys), self.size
        dtypes = {n: self.layers[n] for n in inputs}
        named = {n: scalars[n] for n in per_image}

        def block_of(row):
            _, _, h, w = _shape(row, size)
            arrays = {n: _array(row[n], d, h, w) for n, d in dtypes.items()}
            block = Block(tuple(row[k] for k in keys), row["ty"], row["tx"], row["height"], row["width"], size, halo, arrays)
            for name, column in named.items():
                setattr(block, name, row[column])
            return block

        return block_of

    def _surrounded(self, inputs, keep, halo, per_image, only=None):
        """(table, opener): tiles met with the edges of their neighbours, and a function from its batches to (block, row)."""
        keys, size, dtypes = list(self.keys), self.size, dict(self.layers)
        meta, reach = [*keys, *POSITION], -(-halo // size)
        lent, kept = list(dict.fromkeys(inputs)), [n for n in keep]
        chain = self._open() if only is None else Chain(self.df, scalars={c: c for c in (*per_image, only)})
        named = {n: chain.scalars[n] for n in per_image}
        chosen = chain.scalars[only] if only else None
        extra = [StructField(n, chain.source.schema[c].dataType) for n, c in named.items()]
        piece = StructType(
            self._position()
            + extra
            + [StructField("own", BooleanType())]
            + [StructField(n, IntegerType()) for n in ("py", "px", "ph", "pw")]
            + [StructField(f"p_{n}", BinaryType()) for n in lent]
            + [StructField(f"k_{n}", BinaryType()) for n in kept]
        )
        columns = piece.fieldNames()

        def ship(row):
            out: dict = {c: [] for c in columns}
            y, x, h, w = _shape(row, size)
            arrays = {n: _array(row[n], dtypes[n], h, w) for n in lent}
            for ty in range(max(0, row["ty"] - reach), row["ty"] + reach + 1):
                for tx in range(max(0, row["tx"] - reach), row["tx"] + reach + 1):
                    if ty * size >= row["height"] or tx * size >= row["width"]:
                        continue
                    a0, a1 = max(y, ty * size - halo), min(y + h, (ty + 1) * size + halo)
                    b0, b1 = max(x, tx * size - halo), min(x + w, (tx + 1) * size + halo)
                    if a0 >= a1 or b0 >= b1:
                        continue
                    own = ty == row["ty"] and tx == row["tx"]
                    # a tile that is not computed is dropped where its pieces would meet
                    one = {k: row[k] for k in meta} | {n: row[c] for n, c in named.items()}
                    one.update(ty=ty, tx=tx, own=own and (chosen is None or bool(row[chosen])), py=a0, px=b0, ph=a1 - a0, pw=b1 - b0)
                    for n in lent:
                        one[f"p_{n}"] = arrays[n][a0 - y: a1 - y, b0 - x: b1 - x].tobytes()
                    for n in kept:
                        one[f"k_{n}"] = _bytes(row[n], dtypes[n]) if own else None
                    for c in columns:
                        out[c].append(one[c])
            return out

        lists = [f for f in columns if f not in (*keys, "ty", "tx")]

        def assembled(pdf):
            for group in _records(pdf):
                if not any(group["own"]):
                    continue
                n = int(np.argmax(group["own"]))
                # what was joined to the met tiles since stays with them
                mine = {k: v for k, v in group.items() if k not in lists}
                mine.update({c: group[c][n] for c in ("height", "width")})
                y, x, h, w = _shape(mine, size)
                y0, x0 = max(0, y - halo), max(0, x - halo)
                y1, x1 = min(mine["height"], y + h + halo), min(mine["width"], x + w + halo)
                arrays = {m: np.zeros((y1 - y0, x1 - x0), dtypes[m]) for m in lent}
                for i, (py, px_, ph, pw) in enumerate(zip(group["py"], group["px"], group["ph"], group["pw"])):
                    at = slice(py - y0, py - y0 + ph), slice(px_ - x0, px_ - x0 + pw)
                    for m in lent:
                        arrays[m][at] = np.frombuffer(group[f"p_{m}"][i], dtypes[m]).reshape(ph, pw)
                block = Block(tuple(mine[k] for k in keys), mine["ty"], mine["tx"], mine["height"], mine["width"], size, halo, arrays)
                for name in named:
                    setattr(block, name, group[name][n])
                yield block, {**mine, **{m: group[f"k_{m}"][n] for m in kept}}

        pieces = chain.source.mapInPandas(chained(chain.head, chain.steps, ship, piece), piece)
        # at most (2 * reach + 1)^2 pieces meet in one group
        return gather(pieces, [*keys, "ty", "tx"], lists), assembled

    def repeat(self, inputs, outputs, fn, halo: int = 1) -> Tiles:
        """Apply a relaxing ``fn`` until no tile reports a change (its ``changed`` counter).

        ``fn`` settles a tile as far as its surroundings allow, so a tile takes part in a round only if a tile near it changed in the
        one before; tiles around those lend their edges.  Layers that ``fn`` reads but does not write are written once.  A round
        writes the tiles that changed, and a small table says which round holds the last state of each tile.
        """
        step = self.transform(inputs, outputs, fn, halo, counters=["changed"])
        if self.single:
            return dataclasses.replace(step, df=step.df.drop("changed"))
        at, reach = [*self.keys, "ty", "tx"], -(-halo // self.size)
        raw = self.select(*[n for n in self.layers if n not in outputs]).cut()
        rounds = [cut(step.df.select(*at, *outputs, "height", "width", "changed"))]
        last = rounds[0].select(*at, F.lit(0).alias("round"))

        def state(wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
            """State layers of the tiles in ``wanted`` (at, round, columns), each from its last round."""
            used = sorted(r[0] for r in wanted.select("round").distinct().collect())
            parts = [rounds[i].select(*at, *outputs).join(wanted.where(F.col("round") == i).select(*at, *columns), at) for i in used]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        def around(tiles: DataFrame, own: bool) -> DataFrame:
            """The tiles within reach of ``tiles``, with ``own`` also themselves."""
            steps = F.sequence(F.lit(-reach), F.lit(reach))
            moved = tiles.withColumn("__y", F.explode(steps)).withColumn("__x", F.explode(steps)).where(F.lit(own) | (F.col("__y") != 0) | (F.col("__x") != 0)).select(
                *self.keys, (F.col("ty") + F.col("__y")).alias("ty"), (F.col("tx") + F.col("__x")).alias("tx"), "height", "width"
            )
            inside = (F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * self.size < F.col("height")) & (F.col("tx") * self.size < F.col("width"))
            return moved.where(inside).distinct()

        while True:  # a relaxing function changes every pixel finitely often
            targets = cut(around(rounds[-1].where("changed > 0").select(*at, "height", "width"), False))
            if targets.isEmpty():
                break
            lenders = around(targets, True).join(targets.select(*at, F.lit(True).alias("__t")), at, "left")
            wanted = cut(last.join(lenders.select(*at, F.coalesce("__t", F.lit(False)).alias("__target")), at))
            blocks = raw.df.select(*self.keys, *POSITION, *[n for n in inputs if n not in outputs]).join(state(wanted, ["__target"]), at)
            sub = self._with(blocks, {n: {**self.layers, **outputs}[n] for n in dict.fromkeys([*inputs, *outputs])})
            step = sub.transform(inputs, outputs, fn, halo, counters=["changed"], only="__target")
            rounds.append(cut(step.df.where("changed > 0").select(*at, *outputs, "height", "width", "changed")))
            moved = rounds[-1].select(*at, F.lit(len(rounds) - 1).alias("__new"))
            last = cut(last.join(moved, at, "left").select(*at, F.coalesce("__new", "round").alias("round")))
        done = raw.df.join(state(last, []), at).select(*self.keys, *POSITION, *raw.layers, *outputs)
        return self._with(done, {**raw.layers, **outputs})

    def strips(self, layer: str, output: str, dtype: str, fn: Callable, along: str) -> Tiles:
        """``fn(array)`` over whole columns (``along='y'``) or rows of tiles.

        A group is one tile-wide strip of an image, bounded by its height or width.
        """
        keys, size, from_dtype = list(self.keys), self.size, self.layers[layer]
        keep = [n for n in self.layers if n != output]
        schema = StructType(self._position() + [StructField(n, BinaryType()) for n in [*keep, output]])
        across, axis = ("tx", 0) if along == "y" else ("ty", 1)
        order = "ty" if along == "y" else "tx"

        if self.single:
            return self.transform([layer], {output: dtype}, lambda b: {output: fn(b[layer])})
        columns = [order, "height", "width", *dict.fromkeys([*keep, layer])]

        def run(batches):
            for pdf in batches:
                out = []
                for g in _records(pdf):
                    at = np.argsort(g[order])
                    rows, parts = [], []
                    for i in at:
                        row = {k: g[k] for k in (*keys, across)}
                        row.update({c: g[c][i] for c in columns})
                        h = min(size, row["height"] - row["ty"] * size)
                        w = min(size, row["width"] - row["tx"] * size)
                        parts.append(np.frombuffer(row[layer], from_dtype).reshape(h, w))
                        rows.append(row)
                    made = fn(np.concatenate(parts, axis=axis))
                    ends = np.cumsum([p.shape[axis] for p in parts])[:-1]
                    for row, a in zip(rows, np.split(made, ends, axis=axis)):
                        row[output] = np.ascontiguousarray(a, dtype=dtype).tobytes()
                    out += rows
                    if len(out) >= OPENED_ROWS:
                        yield pd.DataFrame(out)[schema.fieldNames()]
                        out = []
                if out:
                    yield pd.DataFrame(out)[schema.fieldNames()]

        df = gather(self.df, [*keys, across], columns).mapInPandas(run, schema)
        return self._with(df, {**{n: self.layers[n] for n in keep}, output: dtype})

    def relabel(self, layer: str, mapping: DataFrame, missing: str = "keep") -> Tiles:
        """Replace labels by ``mapping`` (keys, label, new); others stay or become 0."""
        dtype, size = self.layers[layer], self.size
        here = self.rows(
            [layer], "ty int, tx int, label bigint",
            lambda b: (lambda u: {"ty": [b.ty] * len(u), "tx": [b.tx] * len(u), "label": u.tolist()})(
                np.unique(b[layer][b[layer] > 0])
            ),
        )
        # a list holds at most the distinct labels of one tile
        lists = (
            here.join(mapping.select(*self.keys, "label", "new"), [*self.keys, "label"])
            .groupBy(*self.keys, "ty", "tx")
            .agg(F.collect_list("label").alias("__from"), F.collect_list("new").alias("__to"))
        )

        opened = self._open()
        chain = opened if opened.placed else dataclasses.replace(self, chain=None)._open()
        old_as, new_as = (f"__{c}{len(chain.steps)}_{len(chain.source.columns)}" for c in ("from", "to"))

        def apply(row):
            _, _, h, w = _shape(row, size)
            a = _array(row[layer], dtype, h, w)
            old, new = row[old_as], row[new_as]
            res = a.copy() if missing == "keep" else np.zeros_like(a)
            if old is not None and len(old) > 0:
                o = np.asarray(old, dtype=np.int64)
                order = np.argsort(o)
                o, n = o[order], np.asarray(new, dtype=np.int64)[order]
                at = np.minimum(np.searchsorted(o, a), len(o) - 1)
                hit = o[at] == a
                res[hit] = n[at[hit]]
            return {**row, layer: res.astype(dtype)}

        lists = lists.withColumnsRenamed({"__from": old_as, "__to": new_as})
        joined = chain.source.join(lists, [*self.keys, "ty", "tx"], "left")
        plain = [f for f in self.df.schema if f.name not in (*self.keys, *POSITION, *self.layers)]
        return self._close(dataclasses.replace(chain, source=joined, steps=(*chain.steps, apply)), self.layers, plain=plain)

    def labels_table(self, layer: str) -> DataFrame:
        """(keys, y, x, label): the layer as pixels, for modest images."""
        return self.pixels_table(layer, "label int")

    def pixels_table(self, layer: str, column: str = "v double") -> DataFrame:
        name = column.split()[0]

        def run(b):
            a = b[layer]
            y, x = np.mgrid[b.y0: b.y0 + a.shape[0], b.x0: b.x0 + a.shape[1]]
            return {"y": y.ravel().tolist(), "x": x.ravel().tolist(), name: a.ravel().tolist()}

        return self.rows([layer], f"y int, x int, {column}", run)

    def value_table(self, layer: str) -> DataFrame:
        """(keys, value, cnt): distinct pixel values, counted inside each tile first."""

        def run(b):
            v, n = np.unique(b[layer].astype(float), return_counts=True)
            return {"value": v.tolist(), "cnt": n.tolist()}

        counts = self.rows([layer], "value double, cnt bigint", run)
        return counts.groupBy(*self.keys, "value").agg(F.sum("cnt").alias("cnt"))

    def with_scalar(self, values: DataFrame) -> Tiles:
        """Attach per-image columns (for ``per_image``)."""
        names = [c for c in values.columns if c not in self.keys]
        if self.chain is None or any(c in self.df.columns for c in names):
            return self._with(look_up(self.df, values, list(self.keys)), self.layers)
        chain, n = self.chain, len(self.chain.steps)
        inside = {c: f"__{c}{n}_{len(chain.source.columns)}" for c in names}
        source = look_up(chain.source, values.withColumnsRenamed(inside), list(self.keys))
        chain = dataclasses.replace(chain, source=source, scalars={**chain.scalars, **inside})
        plain = [f for f in self.df.schema if f.name not in (*self.keys, *POSITION, *self.layers)]
        return self._close(chain, self.layers, plain=plain + [StructField(c, values.schema[c].dataType) for c in names])


def tile_images(
    images: DataFrame, keys: Sequence[str], layers: Mapping[str, str], size: int = 1024,
    single: bool | None = None,
) -> Tiles:
    """Cut image rows (keys, height, width, one binary or array column per layer) into tiles.

    A row is one plane of one file and is cut where it was read; only a small input is dealt
    out over the cores first.
    """
    bounded_batches(images.sparkSession)
    keys, names = list(keys), list(layers)
    dtypes = dict(layers)
    if single is None:
        top = images.agg(F.max("height"), F.max("width")).first()
        single = top[0] is not None and max(top) <= size
    if single:
        at = [F.lit(0).alias("ty"), F.lit(0).alias("tx"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")]
        chain = Chain(deal(images.select(*keys, *at, *names)))
    else:

        def cut_up(pdf):
            for row in _records(pdf):
                h, w = int(row["height"]), int(row["width"])
                arrays = {n: _array(row[n], dtypes[n], h, w) for n in names}
                for ty in range(-(-h // size)):
                    for tx in range(-(-w // size)):
                        at = slice(ty * size, (ty + 1) * size), slice(tx * size, (tx + 1) * size)
                        yield {**row, "ty": ty, "tx": tx, "height": h, "width": w, **{n: arrays[n][at] for n in names}}

        chain = Chain(deal(images.select(*keys, "height", "width", *names)), cut_up, placed=False)
    return Tiles(images.select(*keys), tuple(keys), size, {}, bool(single))._close(chain, dtypes)
