"""Benchmark decontamination by spaced-seed hashing.

Method.  A text is its words (letters, digits and characters beyond ASCII, A-Z lower-cased, so punctuation is no
obstacle).  A fixed mask lays a window over word positions and ignores some of them; the hash of the positions it keeps
is equal in document and benchmark item when only ignored words were replaced.  Window hashes of all masks
are joined; a hit gives a diagonal (place in the document minus place in the item), and each diagonal is verified on whole
word sequences: matching words around the hits are extended while at most ``SLACK`` words of a run differ.  The item
positions covered by all verified runs must make up ``percent`` of the item, so replaced, inserted and missing words are tolerated.

Scale.  Documents are hashed in place.  Only windows that pass a two-probe bit table of fixed size (made from
the benchmark) leave a task, and they meet the benchmark's windows in an ordinary join.  Only documents with hits are read
again for verification.  Equal texts are verified once.

Short items.  An item shorter than the longest mask gets a mask of its own length, so it is found where all its words stand, and from
six words on two more: one that ignores its middle, and one without its first or last third, so that it is also found if the words replaced lie in one
third.  An item of fewer than ``LEAST_ITEM`` words says nothing about a longer text: it is found only in a text of exactly its words.

Edge cases.  Null, empty and wordless texts never match; repeated items and documents each get their rows; a null id is kept as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import beside, tidied
from tessera.llm.text import FINE, FOLD, ODD, buffers, mix, run_hashes, slices, spans
from tessera.session import cut

#: 1: the word counts, 0: it may be anything.
MASKS = ("111111", "111011", "110111", "1101011001", "1011001101", "11100010011", "1010110011")
SLACK = 3
MIN_RUN = 5
LEAST_ITEM = 3
TABLE_BITS = 22

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def word_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    data = FOLD[data]
    s, e, n = spans(WORD[data], offsets)
    return run_hashes(data, s, e), n


def windows(w: np.ndarray, ends: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a mask and their first word; ``ends``: for each word the end of its text."""
    span = len(mask)
    if len(w) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w) - span + 1
    at = np.flatnonzero(np.arange(m) + span <= ends[:m])
    h = np.full(m, number + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h = h * ODD + w[j : m + j]
    return mix(h[at]), at


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << TABLE_BITS) - 1)
    return h & low, (h >> np.uint64(TABLE_BITS)) & low


def short_masks(lengths: list[int]) -> dict[str, list[int]]:
    """Masks for items of these few words, each with the lengths of the items that it is for."""
    made: dict[str, list[int]] = {}
    for n in sorted(lengths):
        third = n // 3
        for mask in ["1" * n] + (["1" * third + "0" * (n - 2 * third) + "1" * third, "1" * (n - third)] if n > MIN_RUN else []):
            made.setdefault(mask, []).append(n)
    return made


def hash_windows(rows: DataFrame, masks: list[str], table=None, only: dict[str, list[int]] | None = None) -> DataFrame:
    """(h, key, at) of the texts in rows (key, text); ``table``: a broadcast of two bit tables that windows must pass; ``only``: masks for texts of these lengths."""

    def run(batches):
        for b in batches:
            for part in slices(b, "text", FINE):
                w, n = word_list(part.column(1))
                ends = np.repeat(np.cumsum(n), n)
                text = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                keys = part.column(0).to_numpy()
                for i, mask in enumerate(masks):
                    h, at = windows(w, ends, mask, i)
                    if only and mask in only:
                        meant = np.isin(n[text[at]], only[mask])
                        h, at = h[meant], at[meant]
                    if len(mask) < LEAST_ITEM:  # whole texts only
                        whole = n[text[at]] == len(mask)
                        h, at = h[whole], at[whole]
                    if table is not None:
                        one, two = _probes(h)
                        ok = table.value[0][one] & table.value[1][two]
                        h, at = h[ok], at[ok]
                    if len(h):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.view(np.int64)), pa.array(keys[text[at]]), pa.array(at - first[text[at]])], ["h", "key", "at"]
                        )

    return rows.mapInArrow(tidied(run), "h long, key long, at long")


def bit_tables(bench_windows: DataFrame) -> np.ndarray:
    """Two tables of 2**TABLE_BITS flags; each task of the benchmark's windows sends the cells that it sets."""

    def run(batches):
        seen = np.zeros((2, 1 << TABLE_BITS), bool)
        for b in batches:
            for i, cells in enumerate(_probes(b.column(0).to_numpy().view(np.uint64))):
                seen[i, cells] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    seen = np.zeros((2, 1 << TABLE_BITS), bool)
    for row in bench_windows.select("h").mapInArrow(tidied(run), "bits binary").toLocalIterator():
        seen |= np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool).reshape(seen.shape)
    return seen


def covered(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[np.ndarray, int]:
    """Which item positions verified runs cover with equal words, and where in the document the first one stands."""
    got, first = np.zeros(len(item), bool), len(doc)
    for d in diagonals:
        low, high = max(0, -d), min(len(item), len(doc) - d)
        same = np.flatnonzero(item[low:high] == doc[low + d : high + d]) + low
        for run in np.split(same, np.flatnonzero(np.diff(same) > SLACK + 1) + 1):
            if len(run) >= min(MIN_RUN, len(item)):
                got[run] = True
                first = min(first, int(run[0]) + d)
    return got, first


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 50, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(text_key, item_id, n_words, n_matched, first_word): each text and benchmark item that overlap enough.

    ``text_key`` is xxhash64 of the text, so that a result holds for all documents with that text.
    """
    spark = docs.sparkSession
    items = cut(benchmark.where("text is not null").select("item_id", "text", F.xxhash64("item_id", "text").alias("key")).distinct())

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_list(b.column(0))[1])], ["n"])

    longest = max(map(len, masks))
    short = [r.n for r in items.select("text").mapInArrow(lengths, "n long").where((F.col("n") > 0) & (F.col("n") < longest)).distinct().collect()]
    own = {m: n for m, n in short_masks(short).items() if m not in masks}
    masks = [*masks, *own]
    bench = cut(hash_windows(items.select("key", "text"), masks, only=own).select("h", F.col("key").alias("item"), F.col("at").alias("item_at")).distinct())
    flags = spark.sparkContext.broadcast(bit_tables(bench))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    hits = hash_windows(texts, masks, flags).join(bench, "h").select("key", "item", (F.col("at") - F.col("item_at")).alias("d")).distinct()
    hits = cut(hits.groupBy("key", "item").agg(F.collect_list("d").alias("diagonals")))

    def arrays(batches):
        for b in batches:
            for part in slices(b, "text", FINE):
                w, n = word_list(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(w.view(np.int64)))], ["key", "words"]
                )

    def verify(batches):
        for b in batches:
            rows = b.to_pydict()
            n, matched, first = [], [], []
            for doc, item, ds in zip(rows["doc_words"], rows["item_words"], rows["diagonals"]):
                got, at = covered(np.array(doc, np.int64), np.array(item, np.int64), ds)
                n.append(len(item)), matched.append(int(got.sum())), first.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(matched, pa.int64()), pa.array(first, pa.int64())], ["text_key", "item_id", "n_words", "n_matched", "first_word"])

    found = beside(texts, cut(hits.select("key").distinct()), "key", "inner", 16).dropDuplicates(["key"])
    found = found.mapInArrow(arrays, "key long, words array<long>").withColumnRenamed("words", "doc_words")
    item_words = items.select("key", "text").mapInArrow(arrays, "key long, words array<long>").withColumnsRenamed({"key": "item", "words": "item_words"})
    pairs = hits.join(found, "key").join(item_words, "item").join(items.select(F.col("key").alias("item"), "item_id"), "item")
    checked = pairs.select("key", "item_id", "doc_words", "item_words", "diagonals").mapInArrow(
        verify, f"text_key long, item_id {dict(items.dtypes)['item_id']}, n_words long, n_matched long, first_word long"
    )
    return checked.where((F.col("n_matched") * 100 >= F.col("n_words") * percent) & (F.col("n_matched") > 0))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 50) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, first_word): a row for each document and the item that it holds."""
    found = cut(leaks(docs, benchmark, percent))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    return beside(keyed, found, "text_key", "inner").drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 50) -> DataFrame:
    """The documents, with all their columns, whose text holds no benchmark item."""
    found = cut(leaks(docs, benchmark, percent).select("text_key").distinct())
    key = "__text_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return beside(keyed, found.withColumnRenamed("text_key", key), key, "left_anti", 16).drop(key)
