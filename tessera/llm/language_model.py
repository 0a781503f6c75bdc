"""Scores of whole texts by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words (A-Z lower-cased), then one end per text.  Every hot word (see below) has an input and an output vector; all other
words are the one output *rare*, and as input share vectors by their last letters.  The vectors of the ``CONTEXT`` tokens before a token, each scaled
by its place, predict its vector in two levels: first a class, then the word inside it.  The most frequent words and *rare* are classes of their own, the
other words share about as many classes as each has words, by frequency.  The product with a vector and a bias give the logit at either level.

Training is data-parallel: each task runs over all windows of its training documents, half of them in either round, in minibatches that share their
noise classes, and starts from common parameters; a vector is averaged over the tasks that used it, by how often they did, and a second round goes on
from there.  Scoring normalises over all classes and over all words of the class.

Inside *rare*, a known word has ``(1 - u) * count / count of rare tokens``, and all unknown words share u, the Good-Turing estimate (the share of rare
tokens that occur once).  So the model is a distribution over the known words and the unknown one, like the base.

Counting.  The most frequent words (``hot`` at most, which grows with the training tokens; from each task's own heavy hitters) are counted exactly in place and sent to all
tasks: they are few and would be hot keys.  All other tokens are shuffled once, by word, and counted there, whatever their number.
Words are 64-bit hashes.

Edge cases.  Null and blank texts are the end token alone; with no training row the base and the model know nothing and every token is
unknown; repeated rows are separate texts; rows without a doc_id are training texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import buffers, run_hashes, slices, spans
from tessera.session import cut

#: The first words and the rare ones are classes of one; all further words share classes.
CLASSES = 128
SUFFIXES = 32
CONTEXT = 3
WIDTH = 16
NOISE = 32
#: Noise words of the target's own class.
INSIDE = 8
BATCH = 512
#: Noise is drawn for so many windows at a time.
PLANNED = 64 * BATCH
#: Up to so many rows of one number are added up together with those of other numbers; numpy adds longer runs in another order.
LAYERS = 8
#: About so many logits are made at a time, so that they stay in a core's own cache.
TILE = 1 << 17
RATE = 0.15
ROUNDS = 2
HOT = 1 << 16
BLOCK = 1 << 18
SEED = 7
END = np.uint64(0x0E4D)  # no word's hash but by chance


def hot(total: int) -> int:
    """The most words with vectors of their own, for so many training tokens."""
    return max(HOT, 8 * math.isqrt(total))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, a suffix bucket for each token, and the number of tokens of each text."""
    data, offsets = buffers(column)
    blank = data - np.uint8(9) < 5
    blank |= data == 32
    s, e, n = spans(~blank, offsets)
    data = data + ((data - np.uint8(65) < 26).view(np.uint8) << 5)
    at = np.cumsum(n)  # an END goes before the first word of the next text
    h = np.insert(run_hashes(data, s, e), at, END)
    last = data.take(e - 1).astype(np.uint16)
    before = data.take(np.maximum(e - 2, 0))
    before[e - s == 1] = 0
    return h, np.insert((last * 31 + before) % SUFFIXES, at, 0).astype(np.int64), n + 1


class Vocabulary:
    """The hot words, numbered from the most frequent one on; the number after the last one stands for all other words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        known = np.append(hashes[np.lexsort((hashes, -counts))], END)
        self.hot, first = np.unique(known, return_index=True)
        self.number = np.empty(len(self.hot), np.int32)
        self.number[np.argsort(first)] = np.arange(len(self.hot))
        self.size = len(self.hot) + 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the hot words (-1: none) and number of each token."""
        at = pc.index_in(pa.array(h), value_set=pa.array(self.hot)).fill_null(-1).to_numpy()
        return at, np.where(at < 0, self.size - 1, self.number[at])


def contexts(number: np.ndarray, suffix: np.ndarray, n: np.ndarray, size: int = CLASSES) -> np.ndarray:
    """(tokens, CONTEXT) input numbers of the tokens before each; one number stands for places before the text."""
    start = size + SUFFIXES - 1
    inputs = np.where(number == size - 1, size - 1 + suffix, number).astype(np.int32)
    place = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((len(number), CONTEXT), start, np.int32)
    for j in range(CONTEXT):
        out[j + 1 :, j] = np.where(place[j + 1 :] > j, inputs[: len(number) - j - 1], start)
    return out


class LogBilinear:
    """Rows of WIDTH numbers and a bias: input vectors, place weights, class vectors, and vectors of words inside classes."""

    def __init__(self, unigram: np.ndarray, flat: np.ndarray | None = None):
        v = len(unigram)
        self.single = min(v, CLASSES) - 1  # classes of one word each, then the rare words, then the groups
        grouped = v - 1 - self.single
        self.share = max(1, int(np.ceil(np.sqrt(grouped))))
        self.class_of = np.arange(v)
        self.class_of[self.single : v - 1] = self.single + 1 + np.arange(grouped) // self.share
        self.class_of[v - 1] = self.single
        classes = self.single + 1 + -(-grouped // self.share)
        self.noise = np.bincount(self.class_of, unigram, classes)
        self.unigram, self.inside = unigram, unigram / self.noise[self.class_of]
        sizes = (v + SUFFIXES, CONTEXT, classes, v)
        self.at = np.cumsum((0, *sizes))
        if flat is None:
            g = np.random.Generator(np.random.PCG64(SEED))
            table = g.normal(0, 0.1, (self.at[-1], WIDTH + 1))
            table[self.at[1] : self.at[2]] = 1
            table[self.at[2] : self.at[3], -1], table[self.at[3] :, -1] = np.log(self.noise), np.log(self.inside)
            flat = table.reshape(-1)
        self.flat = flat.astype(np.float32)
        self.table = self.flat.reshape(-1, WIDTH + 1)
        self.r, self.c, self.q, self.w = (self.table[a:b] for a, b in zip(self.at, self.at[1:]))
        self.used = np.zeros(len(self.table))

    def predicted(self, ctx: np.ndarray) -> np.ndarray:
        """The predicted vectors, with a one for the bias."""
        return self.summed(self.r.take(ctx, axis=0))

    def summed(self, inputs: np.ndarray) -> np.ndarray:
        """The predicted vectors of (tokens, CONTEXT) input vectors."""
        parts = inputs * self.c
        out = parts[:, 0] + parts[:, 1]
        for j in range(2, CONTEXT):
            out += parts[:, j]
        out[:, -1] = 1
        return out

    def train(self, ctx: np.ndarray, target: np.ndarray, draw: np.random.Generator, squares: np.ndarray) -> None:
        """Noise-contrastive steps with Adagrad, for the class and for the word inside it; ``squares`` are the sums of squared gradients so far."""
        shift, within = np.log(NOISE * self.noise).astype(np.float32), np.log(INSIDE * self.inside).astype(np.float32)
        sampler, squares = Sampler(self), squares.reshape(self.table.shape)
        places = Places()
        rows = np.empty((places.end, WIDTH + 1), np.float32)
        each_input = np.repeat(np.arange(BATCH), CONTEXT)
        for begin in range(0, len(target), PLANNED):
            x, y = ctx[begin : begin + PLANNED], target[begin : begin + PLANNED]
            classes = self.class_of.take(y)
            noises, inner, bounds, words = sampler.draws(y, classes, draw)
            steps = Steps(places, self.at, x, classes, noises, inner, bounds, words)
            for k in range(len(noises)):
                low, high = k * BATCH, min((k + 1) * BATCH, len(y))
                n, own, cls, noise = high - low, slice(bounds[k], bounds[k + 1]), classes[low:high], noises[k]
                inputs = self.r.take(x[low:high], axis=0)
                p = self.summed(inputs)
                q, qn = self.q.take(cls, axis=0), self.q.take(noise, axis=0)
                right = _missing(np.einsum("ij,ij->i", p, q), shift.take(cls), 1)
                wrong = _missing(p @ qn.T, shift.take(noise), -1)
                right = right[:, None]
                dp = right * q
                dp -= wrong @ qn
                np.multiply(right, p, out=rows[:n])
                np.negative(wrong.T @ p, out=rows[places.noise : places.words])
                some, z = inner[own] - low, words[own]
                if len(some):
                    qz, ps = self.w.take(z, axis=0), p.take(some, axis=0)
                    e = _missing(np.matmul(qz, ps[:, :, None])[:, :, 0], within.take(z), -1)
                    np.negative(e, out=e)
                    e[:, 0] += 1
                    _items(dp)[some] = _items(dp.take(some, axis=0) + np.matmul(e[:, None, :], qz)[:, 0])
                    np.einsum("ij,ik->ijk", e, ps, out=rows[places.words : places.words + z.size].reshape(*z.shape, WIDTH + 1))
                dp[:, -1] = 0
                dp = dp.take(each_input[: CONTEXT * n], axis=0).reshape(inputs.shape)
                np.multiply(dp, self.c, out=rows[places.inputs : places.inputs + CONTEXT * n].reshape(inputs.shape))
                inputs *= dp
                inputs.sum(axis=0, out=rows[places.weights :])
                self.step(*steps.summed(k, rows), squares)
            self.used += steps.used(len(self.used))

    def step(self, at: np.ndarray, g: np.ndarray, squares: np.ndarray) -> None:
        """One step for the different rows ``at`` with gradients ``g``, which are used up."""
        s = squares.take(at, axis=0)
        s += g * g
        _items(squares)[at] = _items(s)
        g *= np.float32(RATE)
        g /= np.sqrt(s, out=s)
        g += self.table.take(at, axis=0)
        _items(self.table)[at] = _items(g)

    def log_probabilities(self, ctx: np.ndarray, target: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Normalised natural log-probabilities of the target words: of the class, and of the word inside it."""
        out = np.empty(len(target), np.float32)
        for k in range(0, len(target), step):
            y, own = target[k : k + step], out[k : k + step]
            p, cls = np.empty((len(y), WIDTH + 1), np.float32), self.class_of.take(y)
            for some in _tiles(0, len(y), len(self.q)):
                p[some] = self.predicted(ctx[k : k + step][some])
                own[some] = _log_share(p[some], self.q, cls[some])
            order = np.argsort(cls.astype(np.min_scalar_type(len(self.noise))), kind="stable")
            begins = np.searchsorted(cls.take(order), np.arange(self.single + 1, len(self.noise) + 1))
            for g in np.flatnonzero(begins[1:] > begins[:-1]):
                low = self.single + g * self.share
                words = self.w[low : min(low + self.share, len(self.unigram) - 1)]
                for tile in _tiles(begins[g], begins[g + 1], len(words)):
                    some = order[tile]
                    own[some] += _log_share(p.take(some, axis=0), words, y.take(some) - low)
        return out


class Sampler:
    """Draws noise classes and noise words of all minibatches of some windows at once, from the same numbers and in the same order as one by one."""

    def __init__(self, model: LogBilinear):
        self.single, self.share, self.last = model.single, model.share, len(model.unigram) - 1
        self.cumulative, self.running = np.cumsum(model.noise), np.append(0, np.cumsum(model.unigram))
        low = self.single + self.share * np.arange(len(model.noise) - self.single - 1)
        self.base = self.running[low]
        self.span = self.running[np.minimum(low + self.share, self.last)] - self.base
        # where the search for a word of a class begins, by the first bits of the number drawn: at the word of the least such number
        self.cells = 1 << self.share.bit_length()
        least = self.base[:, None] + np.arange(self.cells) / self.cells * self.span[:, None]
        self.guide = np.searchsorted(self.running, least.reshape(-1), "right") - 1

    def draws(self, target: np.ndarray, classes: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minibatches, NOISE) classes; places of the windows whose word is inside a class; where each minibatch's begin; their own words, each followed by INSIDE noise words."""
        batches = -(-len(target) // BATCH)
        inner = np.flatnonzero(classes > self.single)
        bounds = np.searchsorted(inner, BATCH * np.arange(batches + 1))
        numbers = draw.random(NOISE * batches + INSIDE * len(inner))
        first = (NOISE * np.arange(batches) + INSIDE * bounds[:-1])[:, None] + np.arange(NOISE)
        noises = np.minimum(np.searchsorted(self.cumulative, numbers[first]), len(self.cumulative) - 1)
        rest = np.ones(len(numbers), bool)
        rest[first] = False
        group = classes.take(inner) - self.single - 1
        words = np.empty((len(inner), 1 + INSIDE), np.int64)
        words[:, 0] = target[inner]
        words[:, 1:] = self.inside(np.repeat(group, INSIDE), numbers[rest]).reshape(-1, INSIDE)
        return noises, inner, bounds, words

    def inside(self, group: np.ndarray, number: np.ndarray) -> np.ndarray:
        """For each number from 0 to 1 a word of the group, by the words' shares."""
        u = self.base.take(group) + number * self.span.take(group)
        top = np.minimum(self.single + self.share * (group + 1), self.last) - 1
        z = np.minimum(self.guide.take(group * self.cells + (number * self.cells).astype(np.int64)), top)
        ahead = np.flatnonzero((z < top) & (self.running.take(z + 1) <= u))
        while len(ahead):
            z[ahead] += 1
            further = z.take(ahead)
            ahead = ahead[(further < top.take(ahead)) & (self.running.take(further + 1) <= u.take(ahead))]
        return z


class Places:
    """Where a minibatch's gradients stand: for its windows' classes, the noise classes, own and noise words, inputs and place weights."""

    def __init__(self):
        self.noise = BATCH
        self.words = self.noise + NOISE
        self.inputs = self.words + (1 + INSIDE) * BATCH
        self.weights = self.inputs + CONTEXT * BATCH
        self.end = self.weights + CONTEXT
        # those of one input are added up by its place in the context first
        self.order = np.arange(self.end)
        self.order[self.inputs : self.weights] = self.inputs + np.arange(CONTEXT * BATCH).reshape(BATCH, CONTEXT).T.reshape(-1)


class Steps:
    """For each minibatch of some windows, the different rows it changes and the places of their gradients.

    A row's gradients are added up in the order of ``np.add.reduceat``, but those with up to ``LAYERS`` of them all at once: first all second ones to the third ones
    and so on, each time of all rows that have so many, and then the sums to the first ones.
    """

    def __init__(self, places: Places, at: np.ndarray, x: np.ndarray, classes: np.ndarray, noises: np.ndarray, inner: np.ndarray, bounds: np.ndarray, words: np.ndarray):
        batches, windows = np.arange(len(noises)), np.arange(len(x))
        bits, row_bits = places.end.bit_length(), int(at[-1]).bit_length()

        def keys(batch, row, place):
            return (((batch << row_bits) | row) << bits) | place

        of, i = windows // BATCH, windows % BATCH
        own = inner // BATCH
        key = np.concatenate([x.reshape(-1) for x in (
            keys(of, classes + at[2], i),
            keys(batches[:, None], noises + at[2], places.noise + np.arange(NOISE)),
            keys(own[:, None], words + at[3], (places.words + (1 + INSIDE) * (np.arange(len(inner)) - bounds[own]))[:, None] + np.arange(1 + INSIDE)),
            keys(of[:, None], x, (places.inputs + i)[:, None] + BATCH * np.arange(CONTEXT)),
            keys(batches[:, None], at[1] + np.arange(CONTEXT), places.weights + np.arange(CONTEXT)),
        )])
        key.sort()
        order = places.order.take(key & ((1 << bits) - 1))
        key >>= bits
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(begins, len(key)))
        key &= (1 << row_bits) - 1
        self.rows = key
        ends = np.searchsorted(begins, np.append(0, np.cumsum(self._sizes(len(x), bounds))))  # of the minibatches' different rows
        single, more = np.flatnonzero(count == 1), np.flatnonzero(count > 1)
        self.once = begins[single]
        self.once_bounds = np.searchsorted(single, ends)
        # rows with several gradients by their number, those with the most first
        fewer = LAYERS + 1 - np.minimum(count[more], LAYERS + 1)
        group = np.repeat(batches, np.diff(np.searchsorted(more, ends))) * LAYERS + fewer
        more = more[np.argsort(group.astype(np.min_scalar_type(len(batches) * LAYERS)), kind="stable")]
        sizes = np.bincount(group, minlength=len(batches) * LAYERS).reshape(len(batches), LAYERS).cumsum(axis=1)  # [:, LAYERS - j]: rows with more than j gradients
        begins, count = begins[more], count[more]
        self.several_bounds = np.append(0, np.cumsum(sizes[:, -1]))
        self.many = sizes[:, 0]
        often = _ranges(self.several_bounds[:-1], self.many)
        self.often = order.take(_ranges(begins[often], count[often]))
        self.often_begins, self.often_bounds = np.append(0, np.cumsum(count[often])), np.append(0, np.cumsum(self.many))
        self.layers = []
        for j in range(1, LAYERS):
            size = sizes[:, LAYERS - j] - self.many
            self.layers.append((order.take(begins[_ranges(self.several_bounds[:-1] + self.many, size)] + j), np.append(0, np.cumsum(size))))
        self.once_at, self.once = key.take(self.once), order.take(self.once)
        self.several_at, self.several = key.take(begins), order.take(begins)

    @staticmethod
    def _sizes(windows: int, bounds: np.ndarray) -> np.ndarray:
        """How many gradients each minibatch has."""
        full = np.full(len(bounds) - 1, BATCH)
        full[-1] = windows - BATCH * (len(full) - 1)
        return (1 + CONTEXT) * full + NOISE + (1 + INSIDE) * np.diff(bounds) + CONTEXT

    def summed(self, k: int, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different rows of a minibatch, and for each the sum of its gradients."""
        once, several, many = slice(*self.once_bounds[k : k + 2]), slice(*self.several_bounds[k : k + 2]), self.many[k]
        at = np.concatenate([self.several_at[several], self.once_at[once]])
        out = gradients.take(np.concatenate([self.several[several], self.once[once]]), axis=0)
        if many:
            begins = self.often_begins[self.often_bounds[k] : self.often_bounds[k + 1] + 1]
            out[:many] = np.add.reduceat(gradients.take(self.often[begins[0] : begins[-1]], axis=0), begins[:-1] - begins[0], axis=0)
        rest = None
        for places, bounds in self.layers:
            some = places[bounds[k] : bounds[k + 1]]
            if not len(some):
                break
            if rest is None:
                rest = gradients.take(some, axis=0)
            else:
                rest[: len(some)] += gradients.take(some, axis=0)
        if rest is not None:
            out[many : many + len(rest)] += rest
        return at, out

    def used(self, rows: int) -> np.ndarray:
        """How often each row is used."""
        return np.bincount(self.rows, minlength=rows)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, so many of them."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _items(table: np.ndarray) -> np.ndarray:
    """Each row of a table as one value."""
    return table.view(f"V{table.strides[0]}")[:, 0]


def _missing(logit: np.ndarray, shift: np.ndarray, sign: int) -> np.ndarray:
    """The probability that a word is noise (sign 1) or not (sign -1), given its logit and its noise's."""
    x = logit - shift if sign > 0 else shift - logit
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _tiles(begin: int, end: int, columns: int):
    """Parts of begin:end with about ``TILE`` logits."""
    size = max(64, TILE // columns)
    for k in range(begin, end, size):
        yield slice(k, min(k + size, end))


def _log_share(p: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the shares that the vectors numbered ``at`` have of all, one for each predicted vector."""
    logits = p @ vectors.T
    picked = logits.reshape(-1).take(np.arange(0, logits.size, len(vectors)) + at)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(len(vectors), np.float32))


def dealt(r: int, count: int) -> np.ndarray:
    """The windows of a round: each window has its round."""
    return np.arange(r, count, ROUNDS)


def heavy_hitters(training: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and approximate counts of the frequent words of all training texts (``hot`` at most), and the number of all tokens."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for b in batches:
            for part in slices(b, "text"):
                h, _, _ = tokens(part.column(0))
                total += len(h)
                held.append(np.unique(h, return_counts=True))
                if len(held) == 8:
                    held = [_merged(held)]
        if held:
            h, n = _merged(held)
            keep = n >= max(2, total // (32 * HOT))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["h", "n"])

    found = cut(training.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = found.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = found.where("h is not null").orderBy(F.desc("n"), "h").limit(hot(total)).toPandas()
    return rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), total


def _merged(parts):
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    u, back = np.unique(h, return_inverse=True)
    return u, np.bincount(back, n, len(u)).astype(np.int64)


def fit(training: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, exact counts of its hot words, and the parameters of the trained model."""
    sc = training.sparkSession.sparkContext
    hashes, counts, total = heavy_hitters(training)
    vocabulary = Vocabulary(hashes, counts)
    near = np.zeros(len(vocabulary.hot))
    near[np.searchsorted(vocabulary.hot, hashes)] = counts
    unigram = np.bincount(vocabulary.number, near, vocabulary.size) + 1.0
    unigram[-1] += max(0, total - counts.sum())
    unigram /= unigram.sum()
    flat, exact = LogBilinear(unigram).flat, None
    # every task sends a whole model: a few tasks a core, however many parts the input has
    texts = training.select("text").coalesce(4 * sc.defaultParallelism)
    for r in range(ROUNDS):
        sent = sc.broadcast((vocabulary, unigram, flat))

        def run(batches, r=r, sent=sent):
            voc, noise, start = sent.value
            model, seen, rare = LogBilinear(noise, start), 0, 0
            squares = np.full(len(start), 1e-3, np.float32)
            hot = np.zeros(len(voc.hot), np.int64)
            draw = np.random.Generator(np.random.PCG64(SEED + r))
            for b in batches:
                for part in slices(b, "text"):
                    h, suffix, n = tokens(part.column(0))
                    at, number = voc.look_up(h)
                    if r == 0:
                        hot += np.bincount(at[at >= 0], minlength=len(hot))
                        rare += int((at < 0).sum())
                    pick = draw.permutation(dealt(r, len(number)))
                    model.train(contexts(number, suffix, n, voc.size).take(pick, axis=0), number.take(pick), draw, squares)
                    seen += len(pick)
            if seen:
                sums = np.column_stack([model.table * model.used[:, None], model.used])
                for kind, values in ((0, sums.reshape(-1)), (1, np.append(hot, rare))):
                    for i in range(0, len(values), BLOCK):
                        x = values[i : i + BLOCK].astype(np.float64 if kind else np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["kind", "i", "x"])

        def added(blocks):
            kind = blocks.column("kind")[0].as_py()
            x = sum(np.frombuffer(x.as_py(), np.float64 if kind else np.float32).astype(np.float64) for x in blocks.column("x"))
            return pa.table({"kind": blocks.column("kind")[:1], "i": blocks.column("i")[:1], "x": pa.array([x.tobytes()], pa.binary())})

        got = texts.mapInArrow(run, "kind int, i int, x binary").groupBy("kind", "i").applyInArrow(added, "kind int, i int, x binary").collect()
        if not got:
            return vocabulary, np.zeros(len(vocabulary.hot), np.int64), flat
        summed, seen = (np.concatenate([np.frombuffer(x.x) for x in sorted(got, key=lambda x: x.i) if x.kind == kind]) for kind in (0, 1))
        # a row is averaged over the tasks that used it, by how often they did
        summed = summed.reshape(-1, WIDTH + 2)
        table, used = flat.reshape(-1, WIDTH + 1).copy(), summed[:, -1] > 0
        table[used] = summed[used, :-1] / summed[used, -1:]
        flat = table.reshape(-1)
        if r == 0:
            exact = seen[:-1].astype(np.int64)
            unigram = np.bincount(vocabulary.number, seen[:-1], vocabulary.size) + 1.0
            unigram[-1] += seen[-1]
            unigram /= unigram.sum()
    return vocabulary, exact, flat


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_unknown) for every document."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    vocabulary, exact, flat = fit(rows.where(~F.col("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, exact, flat))

    def run(batches):
        voc, counts, flat = sent.value
        model = LogBilinear(np.full(voc.size, 1 / voc.size), flat)
        near = np.log10(counts + 0.5)
        for b in batches:
            for part in slices(b, "text"):
                h, suffix, n = tokens(part.column(2))
                at, number = voc.look_up(h)
                begins = np.cumsum(n) - n
                hot = at >= 0
                known = hot & (counts[at] > 0)
                lost = hot & ~known

                def total(x, begins=begins):
                    return np.add.reduceat(x, begins) if len(begins) else np.zeros(0)

                chance = model.log_probabilities(contexts(number, suffix, n, voc.size), number) / np.log(10)
                tail = np.flatnonzero(~hot)
                ends = np.searchsorted(tail, np.append(begins, len(h)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[tail].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(total(known.astype(np.int64)).astype(np.int64)), pa.array(total(np.where(hot, near[at], 0.0))),
                     pa.array(total(chance.astype(float))), pa.array(total(lost.astype(np.int64)).astype(np.int64)), lists],
                    ["doc_id", "held_out", "n_tokens", "known", "near", "chance", "lost", "tail"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    first = cut(rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, near double, chance double, lost long, tail array<long>"
    )).withColumn("row", F.monotonically_increasing_id())  # of a stored table: the same whenever it is read

    # all other tokens meet once, by word
    word = Window.partitionBy("h")
    tail = (
        first.select("row", "held_out", F.explode("tail").alias("h"))
        .withColumn("c", F.sum(F.when(F.col("held_out"), 0).otherwise(1)).over(word))
        .withColumn("one", F.row_number().over(word.orderBy("row")) == 1)  # the word itself is counted on one of its rows
    )
    of_tail = cut(tail.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 0.5)).alias("t_near"), F.sum(F.when(F.col("c") > 0, F.log10("c")).otherwise(0.0)).alias("t_logs"),
        F.count_if(F.col("c") > 0).alias("t_known"), F.count_if(F.col("c") == 0).alias("t_lost"),
        F.count_if(F.col("one") & (F.col("c") > 0)).alias("types"), F.count_if(F.col("one") & (F.col("c") == 1)).alias("singles"),
        F.sum(F.when(F.col("one"), F.col("c")).otherwise(0)).alias("tokens"),
    ))
    sums = of_tail.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "singles", "tokens")]).first()
    n_train = int(exact.sum()) + sums.tokens
    types = int((exact > 0).sum()) + sums.types
    rare_tokens = sums.tokens
    unseen = min(0.9, max(1.0, sums.singles) / rare_tokens) if rare_tokens else 1.0
    known_rare = float(np.log10((1 - unseen) / rare_tokens)) if rare_tokens else 0.0
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("t_near", "t_logs", "t_known", "t_lost")}
    lost = F.col("lost") + zero["t_lost"]
    return first.drop("tail").join(of_tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero["t_known"]).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("near") + zero["t_near"] - F.col("n_tokens") * float(np.log10(n_train + 0.5 * (types + 1)))).alias("base_score"),
        (F.col("chance") + zero["t_logs"] + zero["t_known"] * known_rare + lost * float(np.log10(unseen))).alias("score"),
        lost.cast("long").alias("n_unknown"),
    )
