"""Language identification by compression.

Method.  Each language has a raw-content dictionary for zstandard, made of excerpts of labelled documents.  A
text (lower case, each run of other characters than letters as one space) is compressed with every dictionary and gets
the language with the smallest size.  Where the margin to the second best language, as a share of it, is below
``CLOSE``, sizes at a slower level are added.  The margin is the score; a text whose margin is below ``margin`` is rejected,
as are texts without a letter.  A text that compresses to ``LEAST`` bytes or more is also rejected if the margin in bytes is narrow on both sides: to the second best
language and to compression with no dictionary.  Such are letter noise and languages that were not learned.

What is learned.  Dictionaries are fitted on a bounded sample (``SAMPLE_DOCS`` documents a language, chosen by the hash
of doc_id among the training rows, ``DICT_BYTES`` in all, an equal share of each document); every text is then
compressed whole.  Prediction sees the text alone.

Edge cases.  Null text or no letter: ``und``, score 0, rejected.  Equal sizes: the alphabetically first language
with score 0, rejected if ``margin`` is positive.  No labelled row at all: every text is ``und``.  Repeated rows
and ids each get a row; other columns do not matter.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

SAMPLE_DOCS = 256
DICT_BYTES = 96 << 10
LEVEL, SLOW_LEVEL = 6, 12
CLOSE = 0.03
#: As a share, the default rejects nothing: a short clean text has a narrow margin too.
MARGIN = 0.0
#: From LEAST bytes on, compressed with no dictionary, a text is noise if the best dictionary wins by less than GAP bytes over the second, and saves
#: GAIN bytes over none at most.
LEAST, GAP, GAIN = 96, 16, 4
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(rb"[^a-z\x80-\xff]+")


def letters(text: str) -> bytes:
    return OTHER.sub(b" ", text.lower().encode())


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def dictionaries(training: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw dictionary for each language of training rows (doc_id, text, lang)."""
    draw = (F.xxhash64("doc_id", "text").bitwiseAND((1 << 53) - 1)).cast("double") / float(1 << 53)
    known = training.where("lang is not null and length(text) > 0").withColumn("draw", draw)
    # rows that repeat share a draw
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * sample_docs / n))) for k, n in counts.items()])
    each = max(64, size // sample_docs)
    # a longer excerpt is kept, in case that there are fewer documents than the sample holds
    rows = (
        known.where(F.col("draw") < share)
        .select("lang", "draw", F.substring("text", 1, 16 * each).alias("text"))
        .groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()  # rows that repeat count once, however many there are
    )
    made = {}
    for lang in sorted(counts):
        own = [letters(r.text) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.draw, r.text))][:sample_docs]
        part = max(each, size // max(1, len(own)))
        made[lang] = b" ".join(t[:part] for t in own)[-size:]
    return {k: v for k, v in made.items() if len(v) >= 8}


def compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False)


def predict(docs: DataFrame, raw: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score and rejected to rows with a ``text``; earlier columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    added = ["lang_pred", "score", "rejected"]
    kept = docs.drop(*added)
    names_out = [*kept.columns, *added]

    def run(batches):
        made = {lang: (compressor(data, LEVEL), compressor(data, SLOW_LEVEL)) for lang, data in sent.value.items()}

        none = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

        def best(data: bytes) -> tuple[str, float, bool]:
            sizes = sorted((len(fast.compress(data)), lang) for lang, (fast, _) in made.items())
            close = len(sizes) == 1 or sizes[1][0] - sizes[0][0] < GAP
            alone = len(none.compress(data)) if close and len(data) >= LEAST else 0
            noise = alone >= LEAST and alone - sizes[0][0] <= GAIN
            gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            if gap < CLOSE:
                sizes = sorted((n + len(made[lang][1].compress(data)), lang) for n, lang in sizes)
                gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            return sizes[0][1], gap, noise

        for b in batches:
            names, scores, out = [], [], []
            for text in b.column("text").to_pylist():
                if not made or not text or not LETTER.search(text):
                    names.append("und"), scores.append(0.0), out.append(True)
                    continue
                lang, gap, noise = best(letters(text))
                names.append(lang), scores.append(gap), out.append(noise or gap < margin)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(out)], names_out)

    schema = StructType(list(kept.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return kept.mapInArrow(tidied(run), schema)


def learned(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the documents whose fold is not 0."""
    return dictionaries(docs.select("doc_id", "text", "lang").where(fold() != 0))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document."""
    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, learned(docs)).drop("text")


def identified(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, whose language was found."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return predict(rows, learned(docs)).where(~F.col("rejected")).select("row.*")
