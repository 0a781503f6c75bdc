"""Token ids of the public word-level BPE file, quickly and exactly as the ``tokenizers`` library gives them.

Texts are cut at white space, and the different chunks of a batch go through tiktoken's byte-pair core in one call: an end mark that no
such chunk holds is set behind each part of a word, and the tokens that end with it tell the parts apart.  Chunks of other than simple
characters go through the library itself.  Nothing is remembered from batch to batch, so a worker holds one batch.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters that neither composition nor lower-casing changes in ways that depend on their neighbours.
SIMPLE = regex.compile(r"(?:[\x21-\x7EÀ-ÖØ-öø-ÿ](?!\|)| )*")
OTHER = regex.compile(r"[^ ]*(?:[^\x20-\x7EÀ-ÖØ-öø-ÿ]|[^ ]\|)[^ ]*")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: So many different chunks are encoded at a time, and the ids of so many chunks are put in place at a time.
CODED, PLACED = 1 << 13, 1 << 17
#: Ends a part of a word; of three bytes, which merge before all others.
MARK = "\ue000"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Ids as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        mark = MARK.encode()
        letters, ranks = _byte_alphabet(), {}
        for token, i in json.load(open(path))["model"]["vocab"].items():
            if not token.startswith("<|"):
                ends = token.endswith("</w>")
                ranks[bytes(letters[c] for c in (token[:-4] if ends else token)) + mark * ends] = i + 2
        ranks |= {mark[:2]: 0, mark: 1}
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[i for t, i in ranks.items() if t.endswith(mark)]] = True
        self.pairs = tiktoken.Encoding("words", pat_str=rf"[^\s{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def chunks(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks that are joined by single blanks, and where each chunk's ids begin and how many they are."""
        others: list[tuple[int, list[int]]] = []
        if not SIMPLE.fullmatch(joined):
            pieces, at, number = [], 0, 0
            for m in OTHER.finditer(joined):
                number += joined.count(" ", at, m.start())
                others.append((number, self.library.encode(m.group(), add_special_tokens=False).ids))
                pieces.append(joined[at : m.start()])
                at = m.end()
            joined = "".join([*pieces, joined[at:]])
        marked = PARTS.sub(rf"\g<0>{MARK}", joined.lower())
        ids = np.array(self.pairs.encode_ordinary(marked), np.int64)
        # tokens up to the end of each part, and parts up to the end of each chunk
        part_ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        data = np.frombuffer(marked.encode(), np.uint8)
        parts = np.append(0, np.cumsum(data == MARK.encode()[0]))
        ends = part_ends[parts[np.append(np.flatnonzero(data == 32), len(data))]]
        begin = np.append(0, ends[:-1])
        ids, size = (ids - 2).astype("<u4"), ends - begin
        if others:
            where, more = [k for k, _ in others], [len(x) for _, x in others]
            size[where] = more
            begin[where] = len(ids) + np.cumsum(more) - more
            ids = np.concatenate([ids, *(np.array(x, "<u4") for _, x in others)])
        return ids, begin, size

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end; a null text has none."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        if isinstance(chunks, pa.ChunkedArray):
            chunks = chunks.combine_chunks()
        words = np.append(0, np.cumsum(pc.list_value_length(chunks).to_numpy()))[1:]
        coded = chunks.flatten().dictionary_encode()
        del chunks
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(len(words), np.int64)
        codes, different = coded.indices.to_numpy(), coded.dictionary
        flat, begin, size, known = [], [], [], 0
        for k in range(0, len(different), CODED):
            some = different.slice(k, CODED).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            made, at, n = self.chunks(joined)
            flat.append(made), begin.append(at + known), size.append(n)
            known += len(made)
        flat, begin, size = np.concatenate(flat), np.concatenate(begin), np.concatenate(size)
        ends = np.append(0, np.cumsum(size[codes]))
        ids = np.empty(ends[-1], "<u4")
        for k in range(0, len(codes), PLACED):
            some = codes[k : k + PLACED]
            n = size[some]
            low, high = ends[k], ends[min(k + PLACED, len(codes))]
            ids[low:high] = flat[np.repeat(begin[some] - ends[k : k + len(some)], n) + np.arange(low, high)]
        return ids, ends[words]

    def of(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian bytes."""
        return self.of_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The one map of a worker."""
    return WordIds(path)
