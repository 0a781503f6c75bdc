"""Substring deduplication: passages of ``WINDOW`` words or more that occur earlier are removed.

Method.  Every window of 20 consecutive words of one document has a Rabin-Karp hash, a polynomial over its words' hashes that is
taken from running sums.  All windows are counted in Spark: the hash decides the bucket, a bucket counts 32 further bits.
Windows whose count is above one come back as stretches of their document.  In a second round only those windows meet again, with
their whole 64-bit hashes, document and place; the smallest (doc_id, start) of each hash stays, the others are hits.  Hits of a document merge into
maximal removal intervals, and the kept words are joined again.

Shape.  Texts are cut into slices of about 4 MB of whole documents.  A slice sends one row per bucket, with the 32-bit remainders
and the places of its windows, each different window once, so a passage that a third of all documents share costs a bucket one
entry per slice.  The number of buckets follows the bytes of text (first round) or the windows that are left (second), so a bucket has a bounded
expected size.  A slice is named by its content, so a retried task names it alike.  Intervals are joined with the texts beside a measured
size: small ones are broadcast, and large ones shuffled.

Edge cases.  Null and blank texts have no words; texts under 20 words lose none.  Rows with one id and text are one document: each of
them gets that document's result.  Rows with one id and different texts follow each other in the order of a hash of the text.  A null
id comes before all others.  Extra columns are ignored; an empty table gives no rows.  Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import SPACE, _Powers, buffers, mix, run_hashes, slices, spans
from tessera.session import cut, look_up

WINDOW = 20
#: Bytes of text whose windows meet in one bucket of the first round, and windows in one of the second.
BUCKET_BYTES = 12 << 20
BUCKET_WINDOWS = 1 << 20
#: Rows that are not windows travel to groups of their own, this many.
ASIDE = 1 << 16

_ROLL = _Powers(0xC2B2AE3D27D4EB4F)
_KEYS = "id long, none boolean, th long"
#: Windows of a group of documents: their starts, the places of their documents in the table that follows, and that table.
_WINDOWS = {"start": np.uint32, "who": np.uint32, "id": np.int64, "none": np.uint8, "th": np.int64}


def windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the texts, one text after the other, and the number of windows of each text."""
    data, offsets = buffers(column)
    s, e, n = spans(~SPACE[data], offsets)
    w = run_hashes(data, s, e)
    up, down = _ROLL.to(len(w))
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    count = np.maximum(n - size + 1, 0)
    at = np.repeat(np.cumsum(n) - n - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return mix((sums[at + size] - sums[at]) * down[at]), count


def planes(x: np.ndarray, kind) -> bytes:
    """Numbers as bytes, all lowest bytes first: what is alike in them stands together and compresses well."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the hashes, and where each different one begins in it."""
    order = np.argsort(h, kind="stable")
    g = h[order]
    return order, np.append(True, g[1:] != g[:-1])[: len(g)]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key that stands for their id and text."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(text).alias("th"))
    return docs.select(key.alias("key"), text.alias("text"))


def _lists(values: np.ndarray, counts) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def repeated(docs: DataFrame, size: int) -> DataFrame:
    """(key, low, high): stretches of window places whose windows are counted more than once anywhere."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    form = f"bucket long, slice long, rest binary, at binary, {_KEYS.replace(' long', ' binary').replace(' boolean', ' binary')}, n binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                h, n = windows(part.column(1), size)
                if not len(h):
                    continue
                some = n > 0
                ids, none, th = (part.column(0).field(i).to_numpy(zero_copy_only=False)[some] for i in range(3))
                name = mix(ids.view(np.uint64) ^ mix(th.view(np.uint64)) + none.astype(np.uint64))
                name = mix(name * np.arange(1, 2 * len(name), 2, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)
                order, new = _sorted(h)
                again = ~new
                again[:-1] |= ~new[1:]
                first = order[new]
                g = h[first]
                ends = np.searchsorted(bucket_of(g, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(ends))
                rest = g.astype(np.uint32)
                rows = [[-1 - int(name % ASIDE), *full.tolist()], [name] * (len(full) + 1)]
                rows.append([b"", *(planes(rest[ends[k] : ends[k + 1]], np.uint32) for k in full)])
                rows.append([planes(np.sort(order[again]), np.uint32), *(planes(first[ends[k] : ends[k + 1]], np.uint32) for k in full)])
                for x, kind in ((ids, np.int64), (none, np.uint8), (th, np.int64), (n[some], np.uint32)):
                    rows.append([planes(x, kind)] + [None] * len(full))
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, [pa.int64()] * 2 + [pa.binary()] * 6)], form.replace(",", "").split()[::2])

    def count(t: pa.Table) -> pa.Table:
        t = t.drop(["bucket"])
        if t.column("n")[0].is_valid:
            return t.drop(["rest"])
        rest = [numbers(x.as_py(), np.uint32) for x in t.column("rest")]
        places = [numbers(x.as_py(), np.uint32) for x in t.column("at")]
        names, slot = np.unique(t.column("slice").to_numpy(), return_inverse=True)
        sizes = [len(x) for x in rest]
        # a slice that occurs twice holds the same documents twice: its windows count once
        where = np.repeat(slot.astype(np.uint64), sizes) << np.uint64(32) | np.concatenate(places).astype(np.uint64)
        rest = np.concatenate(rest)
        order = np.lexsort((where, rest))
        rest, where = rest[order], where[order]
        own = np.append(True, (rest[1:] != rest[:-1]) | (where[1:] != where[:-1]))
        rest, where = rest[own], where[own]
        same = rest[1:] == rest[:-1]
        where = np.sort(where[np.append(False, same) | np.append(same, False)])
        ends = np.searchsorted(where, np.arange(len(names) + 1, dtype=np.uint64) << np.uint64(32))
        full = np.flatnonzero(np.diff(ends))
        at = [planes(where[ends[k] : ends[k + 1]].astype(np.uint32), np.uint32) for k in full]
        empty = pa.nulls(len(full), pa.binary())
        return pa.table([pa.array(names[full]), pa.array(at, pa.binary()), empty, empty, empty, empty], ["slice", "at", "id", "none", "th", "n"])

    def gather(t: pa.Table) -> pa.Table:
        has = [i for i, v in enumerate(t.column("n")) if v.is_valid][0]
        ids, none, th, n = (numbers(t.column(c)[has].as_py(), k) for c, k in (("id", np.int64), ("none", np.uint8), ("th", np.int64), ("n", np.uint32)))
        mask = np.zeros(int(n.sum()), bool)
        for x in t.column("at"):
            mask[numbers(x.as_py(), np.uint32)] = True
        ends = np.cumsum(n.astype(np.int64))
        apart = np.insert(mask, ends, False)  # a stretch ends with its document
        low, high = stretches(apart)
        who = np.searchsorted(ends + np.arange(1, len(n) + 1), low, "right")
        low, high = (x - (ends - n)[who] - who for x in (low, high))
        full, counts = np.unique(who, return_counts=True)
        return pa.table([pa.array(ids[full]), pa.array(none[full].astype(bool)), pa.array(th[full]), _lists(low, counts), _lists(high, counts)], ["id", "none", "th", "low", "high"])

    counted = docs.mapInArrow(send, form).groupBy("bucket").applyInArrow(count, form.replace("bucket long, ", "").replace("rest binary, ", ""))
    found = counted.groupBy("slice").applyInArrow(gather, f"{_KEYS}, low array<int>, high array<int>")
    return cut(found.dropDuplicates(["id", "none", "th"]).select(F.struct("id", "none", "th").alias("key"), "low", "high"))


def later(docs: DataFrame, again: DataFrame, size: int) -> DataFrame:
    """(key, low, high): word intervals covered by windows that also start earlier."""
    left = again.agg(F.sum(F.aggregate(F.zip_with("low", "high", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = 1 + left // BUCKET_WINDOWS
    form = "bucket long, h binary, start binary, who binary, id binary, none binary, th binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                ids, none, th = (part.column(0).field(i).to_numpy(zero_copy_only=False) for i in range(3))
                rank = np.lexsort((th, ids, ~none))
                part = part.take(pa.array(rank))
                ids, none, th = ids[rank], none[rank], th[rank]
                h, n = windows(part.column(1), size)
                begin = np.cumsum(n) - n
                kept = np.zeros(len(h) + 1, np.int64)
                own = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (none[1:] != none[:-1]))
                for k in np.flatnonzero(own):
                    low, high = (np.asarray(part.column(c)[k].values) + begin[k] for c in (2, 3))
                    np.add.at(kept, low, 1)
                    np.add.at(kept, high, -1)
                at = np.flatnonzero(np.cumsum(kept)[:-1])
                if not len(at):
                    continue
                who = np.repeat(np.arange(len(n)), n)[at]
                start, h = at - begin[who], h[at]
                order, new = _sorted(h)  # stable: the first of equal windows is the earliest of this slice
                first, hit = order[new], np.sort(order[~new])
                g = h[first]
                ends = np.searchsorted(bucket_of(g, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(ends))
                sets = [first[ends[k] : ends[k + 1]] for k in full] + ([hit] if len(hit) else [])
                aside = -1 - int(np.bitwise_xor.reduce(th.view(np.uint64)) % np.uint64(ASIDE))
                rows = [[*full.tolist(), aside][: len(sets)], [planes(h[x], np.uint64) for x in sets], [planes(start[x], np.uint32) for x in sets]]
                present = [np.unique(who[x], return_inverse=True) for x in sets]
                rows.append([planes(i, np.uint32) for _, i in present])
                for x, kind in ((ids, np.int64), (none, np.uint8), (th, np.int64)):
                    rows.append([planes(x[u], kind) for u, _ in present])
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, [pa.int64()] + [pa.binary()] * 6)], form.replace(",", "").split()[::2])

    def ranked(t: pa.Table):
        """Keys of all windows of a group (rank of the document, start), the documents by rank, and the row of each window."""
        start, who, ids, none, th = ([numbers(x.as_py(), k) for x in t.column(c)] for c, k in _WINDOWS.items())
        sizes, tables = [len(x) for x in start], [len(x) for x in ids]
        start, who, ids, none, th = (np.concatenate(x) for x in (start, who, ids, none, th))
        who = who + np.repeat(np.cumsum(tables) - tables, sizes)
        order = np.lexsort((th, ids, 1 - none))
        ids, none, th = ids[order], none[order], th[order]
        own = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (none[1:] != none[:-1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(own) - 1
        return rank[who].astype(np.uint64) << np.uint64(32) | start.astype(np.uint64), ids[own], none[own], th[own]

    def decide(t: pa.Table) -> pa.Table:
        """Hits of a bucket, packed by the group in which their documents gather."""
        key, ids, none, th = ranked(t)
        if t.column("bucket")[0].as_py() >= 0:  # the earliest window of each hash stays; a window that came twice is one window
            h = np.concatenate([numbers(x.as_py(), np.uint64) for x in t.column("h")])
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            new = np.append(True, h[1:] != h[:-1])
            key = key[key != key[new][np.cumsum(new) - 1]]
        key = np.unique(key)
        full, counts = np.unique((key >> np.uint64(32)).astype(np.int64), return_counts=True)
        part = (mix(ids[full].view(np.uint64) ^ mix(th[full].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        start, owner = key.astype(np.uint32), np.repeat(np.arange(len(full)), counts)
        rows = [[] for _ in range(6)]
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(buckets + 1))
        place = np.empty(len(full), np.int64)
        place[order] = np.arange(len(full))
        mine = np.argsort(place[owner], kind="stable")
        reach = np.append(0, np.cumsum(counts[order]))
        for k in np.flatnonzero(np.diff(ends)):
            docs_, hits_ = order[ends[k] : ends[k + 1]], mine[reach[ends[k]] : reach[ends[k + 1]]]
            values = (start[hits_], place[owner[hits_]] - ends[k], ids[full[docs_]], none[full[docs_]], th[full[docs_]])
            for r, x in zip(rows, (int(k), *(planes(v, kind) for v, kind in zip(values, _WINDOWS.values())))):
                r.append(x)
        return pa.table([pa.array(r, kind) for r, kind in zip(rows, [pa.int64()] + [pa.binary()] * 5)], ["part", *_WINDOWS])

    def merge(t: pa.Table) -> pa.Table:
        """Maximal intervals of words of the documents of one group."""
        key, ids, none, th = ranked(t)
        key = np.unique(key)
        apart = np.append(True, np.diff(key) > np.uint64(size))  # another document is further away than any window is long
        low, high = key[apart], key[np.append(apart[1:], True)[: len(key)]] + np.uint64(size)
        full, counts = np.unique((low >> np.uint64(32)).astype(np.int64), return_counts=True)
        low, high = (_lists(x & np.uint64(0xFFFFFFFF), counts) for x in (low, high))
        return pa.table([pa.array(ids[full]), pa.array(none[full].astype(bool)), pa.array(th[full]), low, high], ["id", "none", "th", "low", "high"])

    hits = look_up(docs, again, ["key"]).mapInArrow(send, form).groupBy("bucket").applyInArrow(decide, f"part long, {form.split(', ', 2)[2]}")
    whole = hits.groupBy("part").applyInArrow(merge, f"{_KEYS}, low array<int>, high array<int>")
    return whole.select(F.struct("id", "none", "th").alias("key"), "low", "high")


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, low, high): each document without its repeated passages, and their word intervals."""
    own = keyed(docs)
    gone = later(own, repeated(own, size), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, low, high in zip(b.column(1), b.column(2), b.column(3)):
                words = t.as_py().encode().split()
                n = len(words)
                if low.is_valid:
                    keep = np.ones(n, bool)
                    for x, y in zip(low.as_py(), high.as_py()):
                        keep[x:y] = False
                    words = list(compress(words, keep.tolist()))
                kept = b" ".join(words)
                out.append((n, n - len(words), kept.decode()))
            if out:
                key = b.column(0)
                ids = pa.array([None if none else i for i, none in zip(key.field(0).to_pylist(), key.field(1).to_pylist())], pa.int64())
                n, removed, kept = zip(*out)
                columns = [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), b.column(2), b.column(3)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "low", "high"])

    schema = "doc_id long, n_words long, n_removed long, kept string, low array<int>, high array<int>"
    return look_up(own, gone, ["key"], "left").mapInArrow(run, schema)
