"""Document fingerprints by consistent weighted sampling.

Method.  A text is a weighted set of words (A-Z lower-cased), the weight of a word being ``1 + log2(count)``.  For each of ``SAMPLES``
samples, every word has fixed variates r and c from Gamma(2, 1) and b from Uniform(0, 1), drawn by the word's hash and the sample's number.
A weight w is put on the grid ``t = floor(ln w / r + b)``, and the word with the smallest ``ln c - r * (t - b) - r`` is
the sample, together with its t.  Two texts agree in a sample with a probability equal to their generalised Jaccard
similarity, sum of the smaller weights over sum of the larger ones.  A fingerprint is 16 bits of a hash of each sample.

The variates come from tables of ``1 << 16`` quantile-spaced draws that each worker makes from a fixed seed, so that a sample
costs three look-ups, and executors agree bit by bit.

The edited text needs the next document.  Documents are dealt by ranges of doc_id; the first row of a range is also sent to the range before it,
and each range is read in order as a stream.  Range bounds are a fixed number of quantiles.

Edge cases.  Null and blank texts have the empty set, whose fingerprint is all zeros; two empty sets are alike (1), an
empty and another one are not (0).  Rows with equal ids follow in the order of their texts; null ids come first.  A single
document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import mix, words

SAMPLES = 64
SEED = 20_240_229
#: Texts whose words are sampled at once have about so many characters.
AT_ONCE = 1 << 19


class Variates:
    """Tables of draws, and the offsets that give each sample its own."""

    def __init__(self, samples: int = SAMPLES):
        g = np.random.Generator(np.random.PCG64(SEED))
        n = 1 << 16
        self.r = g.gamma(2.0, 1.0, n)
        self.log_c = np.log(g.gamma(2.0, 1.0, n)).astype(np.float32)
        self.b = ((g.permutation(n) + 0.5) / n).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.r = self.r.astype(np.float32)
        self.salts = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(w: np.ndarray, counts: np.ndarray, v: Variates) -> np.ndarray:
    """(texts, samples) 16-bit samples of the texts whose word hashes follow each other in ``w``."""
    samples = len(v.salts)
    out = np.zeros((len(counts), samples), np.uint16)
    if not len(w):
        return out
    text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    order = np.lexsort((w, text))
    w, text = w[order], text[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(w)))
    h, owner = w[at], text[at]
    log_w = np.log(1 + np.log2(times)).astype(np.float32)
    # a word with one weight has the same value in every text, so it is valued once
    code = mix(h ^ times.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, one, back = np.unique(code, return_index=True, return_inverse=True)
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who = owner[begins]
    hashes, logs = h[one], log_w[one]
    length = np.diff(np.append(begins, len(owner)))
    for k in range(samples):
        x = mix(hashes ^ v.salts[k])
        i, j = (x & np.uint64(0xFFFF)).astype(np.intp), (x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.intp)
        b = v.b[(x >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.intp)]
        t = np.floor(logs * v.inverse[i] + b)
        value = (v.log_c[j] - v.r[i] * (t - b + np.float32(1)))[back]
        least = np.minimum.reduceat(value, begins)
        hit = np.flatnonzero(value == np.repeat(least, length))
        whose = owner[hit]
        got = back[hit[np.append(True, whose[1:] != whose[:-1])]]
        sample = mix(x[got] ^ (t[got].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out[who, k] = (sample >> np.uint64(48)).astype(np.uint16) | np.uint16(1)  # never the zeros of an empty set
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _report(ids, texts: list[str], follow: list[str], v: Variates) -> pa.RecordBatch:
    """Rows of ``texts``, each with its next document."""
    changed = [edited(a, b) for a, b in zip(texts, follow)]
    # the next text is the one after it, so only the last one has to be added
    w, n = words(pa.array([*texts, follow[-1], *changed], pa.large_string()))
    s = sketches(w, n, v)
    own, after, other = s[: len(texts)], s[1 : len(texts) + 1], s[len(texts) + 1 :]
    hexes = lambda m: [x.tobytes().hex() for x in m.astype(">u2")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(hexes(own)), pa.array(hexes(other)),
            pa.array(likeness(own, other)), pa.array(likeness(own, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """A row for each document with its fingerprint, that of its edited text, and both likenesses."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<long>")
    area = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    placed = rows.withColumn("area", area)
    # the first id of each range that has rows: its rows also end the range before (the last range ends with the very first id)
    firsts = sorted((r.area, r.least) for r in rows.select("doc_id", area.alias("area")).groupBy("area").agg(F.min(F.struct(F.col("doc_id"))).alias("m")).select("area", F.col("m.doc_id").alias("least")).collect())
    marks = spark.createDataFrame([(least, firsts[k - 1][0]) for k, (_, least) in enumerate(firsts)], "first long, before int")
    ends = placed.join(F.broadcast(marks), F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("before").alias("area"), F.lit(True).alias("sent"), "doc_id", "text")
    sent = placed.select(F.col("area").cast("int").alias("area"), F.lit(False).alias("sent"), "doc_id", "text").unionByName(ends)
    dealt = sent.repartitionById(parts, "area").sortWithinPartitions("area", "sent", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Variates(samples)
        ids: list = []
        texts: list[str] = []
        area, size, closed = None, 0, True

        def flush(last: str):
            return _report(ids, texts, [*texts[1:], last], v)

        for b in batches:
            for a, end, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if a != area:
                    area, closed, ids, texts, size = a, False, [], [], 0
                if closed:  # further rows with the first id of the next range
                    continue
                if end:
                    closed = True
                    if ids:
                        yield flush(t)
                    ids, texts, size = [], [], 0
                    continue
                if size > AT_ONCE:
                    yield flush(t)
                    ids, texts, size = [], [], 0
                ids.append(i), texts.append(t)
                size += len(t)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
