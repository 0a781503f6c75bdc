"""Operators on documents against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, fingerprints, jaccard_join, language, language_model, licenses, packing, sharding, text, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the tion ing er on re th and of in".split(), "de": "ung keit ein sch der ü ß ver en ge".split()}


def say(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def edit(draw, t, k):
    w = t.split()
    for _ in range(k):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    made = [(i, say(draw, "en" if i % 3 else "de", draw.randint(30, 200)), "en" if i % 3 else "de") for i in range(60)]
    passage = say(draw, "en", 60)
    made += [(100 + i, passage + " " + say(draw, "en", 20 + 4 * i), "en") for i in range(12)]  # a passage that many share
    made += [(200 + i, edit(draw, made[4][1], i % 3), "en") for i in range(15)]  # near copies
    made += [(300 + i, made[7][1], "en") for i in range(10)]  # exact copies
    made += [(400, None, "en"), (401, "", None), (402, " \t\n", "en"), (403, "Hi", "de"), (404, "### 12 ...", "en"), (405, say(draw, "de", 9000), "de")]
    made += [(406, "a b c", None), (407, "A  b\nc", None), (406, "a b c", None), (None, "no id here at all for this text", "en"), (None, None, None)]
    return [(i, t, lang, "s", None) for i, t, lang in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().lower().split()


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["The cat", None, "", " the\tCAT \n", "x" * 50, "é the", "cat"] * 3
    h, n = text.words(pa.array(texts))
    assert n.tolist() == [len(split(t)) for t in texts]
    flat = [w for t in texts for w in split(t)]
    seen = {}
    assert all(seen.setdefault(w, int(x)) == int(x) for w, x in zip(flat, h)) and len(set(seen.values())) == len(seen)
    small, text.PIECE = text.PIECE, 16
    try:
        assert (text.words(pa.array(texts))[0] == h).all()
    finally:
        text.PIECE = small
    assert (text.words(pa.array(texts).slice(3, 2))[0] == h[n[:3].sum() : n[:5].sum()]).all()


def test_window_hashes_hold_a_bounded_part_of_a_batch():
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    run = decontaminate.hash_windows(Rows(), list(decontaminate.MASKS))
    batch = pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array([f"{i:03d} hold these few words " * 1200 for i in range(256)])], ["key", "text"])
    tracemalloc.start()
    made = sum(len(b) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == sum(256 * (6000 - len(m) + 1) for m in decontaminate.MASKS)
    assert peak < 60 << 20, peak


def shingle_set(t, k=5):
    w = split(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_roots(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def brute_components(rows):
    sets, root = brute_roots(rows)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r[0])
    low = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return sorted(((r[0], len(sets[i]), low[root[i]] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_near_duplicates(spark, docs, rows, none):
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_near_duplicates_of_many_random_edits(spark):
    draw = random.Random(11)
    base = [say(draw, "en", 60) for _ in range(4)]
    rows = [(i, edit(draw, base[i % 4], draw.randint(0, 3)) + (" " + base[(i + 1) % 4] if i % 7 == 0 else ""), "en", "s", 0) for i in range(120)]
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute_components(rows)


def test_one_of_each_keeps_columns_and_blank_rows(docs, rows):
    clash = docs.withColumnRenamed("source", "component_id").withColumnRenamed("n_chars", "node")
    kept = jaccard_join.one_of_each(clash)
    assert kept.columns == clash.columns
    want = collections.Counter(r[0] for r, c in zip(rows, sorted_by_row(rows)) if c)
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


def sorted_by_row(rows):
    """Whether a row stays: one of each component, with its smallest id (null last); rows without words always."""
    sets, root = brute_roots(rows)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    first = {}
    for i in sorted(range(len(rows)), key=order):
        first.setdefault(root[i], i)
    return [not sets[i] or first[root[i]] == i for i in range(len(rows))]


def test_one_of_each_decides_by_row(spark):
    draw = random.Random(21)
    a, b, c, d = (say(draw, "en", 60) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, d), (4, edit(draw, d, 1)), (5, b + " more"), (5, None), (5, ""), (None, c), (None, "a null id and a text of its own"), (None, "another text beside a null id"), (6, None)]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert kept == sorted(((r[0], r[1]) for r, stays in zip(rows, sorted_by_row(rows)) if stays), key=str)
    assert (2, b) in kept and (3, d) in kept and (2, a) not in kept
    one = [(7, " ".join(f"w{i}x{j}" for j in range(9)) if i % 3 else a, "en", "s", i) for i in range(60)]  # one id on all rows
    left = jaccard_join.one_of_each(spark.createDataFrame(one, SCHEMA)).collect()
    assert sorted(r.text for r in left) == sorted({r[1] for r in one})


def test_decontamination(spark, none):
    draw = random.Random(3)
    items = [(i, say(draw, "en", 15 + i)) for i in range(20)] + [(30, "only four words here"), (31, None), (32, ""), (33, items_text := say(draw, "de", 25)), (33, items_text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = [(i, say(draw, "en", 100)) for i in range(30)]
    for i in range(20):
        w = items[i][1].split()
        w[5] = "replaced"  # a substitution
        if i % 2:
            w.insert(9, "inserted")
        made.append((100 + i, say(draw, "en", 40) + " " + ", ".join(w).upper() + " " + say(draw, "en", 40)))
    made += [(200, "before only four words here after"), (201, None), (202, ""), (203, items_text), (203, items_text), (204, items[3][1].rsplit(" ", 12)[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted([(100 + i, i) for i in range(20)] + [(200, 30), (203, 33), (203, 33)])
    clash = docs.withColumnRenamed("source", "text_key")
    left = decontaminate.clean(clash, bench)
    assert left.columns == clash.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([*range(30), 201, 202, 204])
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(made)


def test_short_items(spark):
    """Items of 1 to 10 words: whole ones are found, with one word replaced from six words on, and very short ones only as a whole text."""
    draw = random.Random(13)
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(1, 11)]
    bench = spark.createDataFrame([*items, (20, " ".join(f"long{k}" for k in range(40)))], "item_id long, text string")
    made, want = [], []
    for n, t in items:
        made += [(100 * n, t), (100 * n + 1, say(draw, "en", 30) + " " + t + " " + say(draw, "en", 30))]
        want += [(100 * n, n)] + [(100 * n + 1, n)] * (n >= decontaminate.LEAST_ITEM)
        for k in range(n):
            w = t.split()
            w[k] = "replaced"
            made.append((100 * n + 10 + k, say(draw, "en", 30) + " " + " ".join(w) + " " + say(draw, "en", 30)))
            same = [p for p in range(n) if p != k]
            want += [(100 * n + 10 + k, n)] * (len(same) >= 5)
    made += [(5000, "long3 long4 long5 long6 " + say(draw, "en", 20)), (5001, "item1word0"), (5002, "item1word0 item1word0")]
    want.append((5001, 1))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted(want)


def test_a_language_of_repeats_is_learned(spark):
    many = [(7, "der hund und die katze sind nicht in der stadt " * 4, "de")] * 9000
    one = [(i, "the dog and the cat are not in the city " * (1 + i % 5), "en") for i in range(40)]
    docs = spark.createDataFrame([*many, *one], "doc_id long, text string, lang string")
    assert zlib.crc32(b"7") % 5 and set(language.learned(docs)) == {"de", "en"}


def test_language(docs, rows, none):
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, lang, *_ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            assert {"und"} == {r.lang_pred for r in by[i] if r.score == 0 and r.rejected} if len(by[i]) == 1 else True
        elif i is not None:
            assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for r in by[i])
    long = [(i, lang) for i, t, lang, *_ in rows if t and len(t) > 100]
    assert sum(by[i][0].lang_pred == lang for i, lang in long) >= 0.97 * len(long)
    clash = docs.withColumnRenamed("source", "score").withColumnRenamed("n_chars", "lang_pred")
    kept = language.identified(clash)
    assert kept.columns == clash.columns and kept.count() == sum(bool(t and re.search(r"[^\W\d_]", t)) for _, t, *_ in rows)
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}


def test_tokens_equal_the_library():
    path = packing.tokenizer_path()
    ids = tokens.WordIds(path)
    draw = random.Random(1)
    odd = ["It's", "don't", "ABC's x", "a b", " ", "<|endoftext|>", "x<|startoftext|>y", "é", "é", "Σίσυφος ΟΔΟΣ", "日本語 123", "👍🏽", "\x1f", "İI", "a|b <|", "1,234.5", "ﬁ", "", None, "ǅ", "'S 'LL", "\x85"]
    odd += [say(draw, "de", 50).upper(), "".join(chr(draw.randrange(33, 700)) for _ in range(400))]
    for t in odd:
        want = ids.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids.of(t), "<u4").tolist() == want, t


def test_packing(docs, rows, none):
    got = packing.packed(docs).collect()
    ids = tokens.WordIds(packing.tokenizer_path())
    want = collections.Counter()
    for i, t, *_ in rows:
        data = ids.of(t) + b"\0\0\0\0"
        for k in range(0, len(data), 8192):
            want[(i, k // 8192, k // 4, len(data[k : k + 8192]) // 4, zlib.crc32(data[k : k + 8192]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.packed(none).count() == 0


def test_packing_of_several_groups_uses_few_sequences(spark):
    draw = random.Random(2)
    items = [(i, 0, 0, min(100, int(draw.expovariate(1 / 30)) + 1), i) for i in range(900)]
    frame = spark.createDataFrame(items, "doc_id long, piece int, start long, length int, ids_crc32 long")
    got = packing.pack(frame, capacity=100, group=150).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    room = collections.Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 100 and len(room) <= -(-sum(x[3] for x in items) // 100) + 2


def test_crossover_keeps_every_item_once():
    draw = random.Random(4)
    p = packing.Packer([draw.randint(1, 60) for _ in range(200)], 100, 9)
    a, b = p.first()[:2]
    child = p.cross(a, b)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(p.free(x) >= 0 for x in child)


def test_fingerprints(docs, rows, none):
    known = [(i, t or "") for i, t, *_ in rows]
    known.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = collections.defaultdict(list)
    for r in fingerprints.fingerprints(docs).collect():
        got[(r.doc_id, r.edited_sha256)].append(r)
    prints = {}
    for k, (i, t) in enumerate(known):
        follow = known[(k + 1) % len(known)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + follow[:half]
        r = got[(i, hashlib.sha256(changed.encode()).hexdigest())].pop()
        assert r.n_chars == len(t)
        assert prints.setdefault(tuple(sorted(split(t))), r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) >= (split(t) == split(follow))
    assert not any(got.values())
    assert fingerprints.fingerprints(none).count() == 0


def test_collision_rate_is_generalised_jaccard():
    draw = random.Random(8)
    v = fingerprints.Variates(2048)
    a = [draw.choice("abcdefghijklmnopq") for _ in range(60)]
    b = a[:35] + [draw.choice("klmnopqrstuv") for _ in range(30)]
    w, n = text.words(pa.array([" ".join(a), " ".join(b), "", "   "]))
    s = fingerprints.sketches(w, n, v)
    ca, cb = ({k: 1 + math.log2(c) for k, c in collections.Counter(x).items()} for x in (a, b))
    keys = set(ca) | set(cb)
    want = sum(min(ca.get(k, 0), cb.get(k, 0)) for k in keys) / sum(max(ca.get(k, 0), cb.get(k, 0)) for k in keys)
    assert abs(fingerprints.likeness(s[:1], s[1:2])[0] - want) < 0.05
    assert (s[2] == s[3]).all() and fingerprints.likeness(s[:1], s[2:3])[0] == 0


def test_shards(docs, rows, none):
    got = sharding.assign(docs).collect()
    size = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == size
    by, of = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        by[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in of.values())
    assert sharding.assign(none).count() == 0


def test_hash_tree_shares_and_confined_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    before = sharding.tree(40)
    after = {r: {k: dict(s) for k, s in racks.items()} for r, racks in before.items()}
    after[2][1][20] = 3.0  # one shard gets heavier
    got = ids.select(sharding.shard_of(ids.doc_id, before).alias("a"), sharding.shard_of(ids.doc_id, after).alias("b")).collect()
    counts = collections.Counter(r.a for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.25 * 500 and min(counts.values()) > 0.75 * 500
    assert all(r.b in before[2][0] or r.b in before[2][1] for r in got if r.a != r.b)  # rows move into its region alone
    assert 2.2 < sum(r.b == 20 for r in got) / 500 < 3.6


def test_slots_of_a_hot_key(spark):
    rows = spark.createDataFrame([(7, 3)] * 50 + [(i, i % 3) for i in range(100)], "doc_id long, shard int")
    got = sharding.with_slots(sharding.cut(rows), cell_rows=10).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 150 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_language_model(docs, rows, none):
    got = collections.defaultdict(list)
    for r in language_model.score(docs).collect():
        got[(r.doc_id, r.n_tokens)].append(r)
    listed = [(i, split(t) + [None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in listed if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in listed:
        r = got[(i, len(ws))].pop()
        assert (r.held_out, r.train_tokens, r.n_known) == (held(i), n, sum(c[w] > 0 for w in ws))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0
    assert language_model.score(none).count() == 0


def test_class_probabilities_sum_to_one_and_training_helps():
    draw = np.random.default_rng(1)
    classes, k = language_model.CLASSES, 40_000
    cls = np.zeros(k, np.int64)  # each class mostly follows its predecessor
    for t in range(1, k):
        cls[t] = (cls[t - 1] + 1) % 20 if draw.random() < 0.8 else draw.integers(classes)
    n = np.full(k // 100, 100)
    ctx = language_model.contexts(cls, np.zeros(k, np.int64), n)
    unigram = (np.bincount(cls, minlength=classes) + 1) / (k + classes)
    model = language_model.LogBilinear(unigram)
    every = [model.log_probabilities(ctx[:50], np.full(50, y)) for y in range(classes)]
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(50), rel=1e-4)
    before = model.log_probabilities(ctx, cls).mean()
    squares = np.full(len(model.flat), 1e-3, np.float32)
    for _ in range(3):
        model.train(ctx, cls, np.random.default_rng(2), squares)
    assert model.log_probabilities(ctx, cls).mean() > before + 0.5


def test_words_inside_classes_are_predicted_from_their_context():
    draw = np.random.default_rng(4)
    size, k = 400, 60_000
    word = draw.integers(0, size - 1, k)  # far more words than classes of one word, each mostly followed by its successor
    for t in range(1, k):
        if draw.random() < 0.8:
            word[t] = (word[t - 1] + 1) % (size - 1)
    vocabulary = language_model.Vocabulary(np.arange(1, size - 1, dtype=np.uint64) * np.uint64(10**6), np.arange(size - 2, 0, -1))
    assert vocabulary.size == size and len(set(vocabulary.number.tolist())) == size - 1
    n = np.full(k // 100, 100)
    ctx = language_model.contexts(word, np.zeros(k, np.int64), n, size)
    unigram = (np.bincount(word, minlength=size) + 1) / (k + size)
    model = language_model.LogBilinear(unigram)
    every = [model.log_probabilities(ctx[:20], np.full(20, y)) for y in range(size)]
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(20), rel=1e-4)
    squares = np.full(len(model.flat), 1e-3, np.float32)
    for _ in range(6):
        model.train(ctx, word, np.random.default_rng(2), squares)
    inside = word > language_model.CLASSES
    assert np.exp([model.log_probabilities(ctx[:20], np.full(20, y)) for y in range(size)]).sum(axis=0) == pytest.approx(np.ones(20), rel=1e-4)
    assert model.log_probabilities(ctx[inside], word[inside]).mean() > np.log(unigram[word[inside]]).mean() + 0.5
    assert language_model.hot(10**12) > language_model.hot(10**6) >= 1 << 16


def test_rounds_train_on_every_window():
    assert sorted(np.concatenate([language_model.dealt(r, 1001) for r in range(language_model.ROUNDS)]).tolist()) == list(range(1001))


def plain_training(model, ctx, target, draw, squares):
    """The minibatches one after the other, every gradient as a row of its own."""
    m, lm = model, language_model
    shift, within = np.log(lm.NOISE * m.noise).astype(np.float32), np.log(lm.INSIDE * m.inside).astype(np.float32)
    cumulative, running = np.cumsum(m.noise), np.append(0, np.cumsum(m.unigram))
    squares = squares.reshape(m.table.shape)
    for k in range(0, len(target), lm.BATCH):
        x, y = ctx[k : k + lm.BATCH], target[k : k + lm.BATCH]
        cls = m.class_of[y]
        p = np.ones((len(x), lm.WIDTH + 1), np.float32)
        p[:, :-1] = sum(m.c[j, :-1] * m.r[x[:, j], :-1] for j in range(lm.CONTEXT))
        noise = np.minimum(np.searchsorted(cumulative, draw.random(lm.NOISE)), len(m.noise) - 1)
        q, qn = m.q[cls], m.q[noise]
        right = 1 / (1 + np.exp(np.einsum("ij,ij->i", p, q) - shift[cls]))
        wrong = 1 / (1 + np.exp(shift[noise] - p @ qn.T))
        dp = right[:, None] * q - wrong @ qn
        at, rows = [cls + m.at[2], noise + m.at[2]], [right[:, None] * p, -(wrong.T @ p)]
        some = np.flatnonzero(cls > m.single)
        if len(some):
            low = (cls[some] - m.single - 1) * m.share + m.single
            high = np.minimum(low + m.share, len(m.unigram) - 1)
            u = running[low, None] + draw.random((len(some), lm.INSIDE)) * (running[high] - running[low])[:, None]
            z = np.clip(np.searchsorted(running, u, "right") - 1, low[:, None], high[:, None] - 1)
            z = np.concatenate([y[some][:, None], z], axis=1)
            e = -1 / (1 + np.exp(within[z] - np.matmul(m.w[z], p[some][:, :, None])[:, :, 0]))
            e[:, 0] += 1
            dp[some] += np.matmul(e[:, None, :], m.w[z])[:, 0]
            at.append(z.reshape(-1) + m.at[3]), rows.append((e[:, :, None] * p[some][:, None, :]).reshape(-1, lm.WIDTH + 1))
        dp[:, -1] = 0
        for j in range(lm.CONTEXT):
            at += [x[:, j], [j + m.at[1]]]
            rows += [dp * m.c[j], (dp * m.r[x[:, j]]).sum(axis=0, keepdims=True)]
        at, rows = np.concatenate(at), np.concatenate(rows)
        to, order = np.divmod(np.sort(at * len(at) + np.arange(len(at))), len(at))
        begins = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        g, to = np.add.reduceat(rows[order], begins, axis=0), to[begins]
        m.used[to] += np.diff(np.append(begins, len(at)))
        squares[to] += g * g
        m.table[to] += lm.RATE * g / np.sqrt(squares[to])


def made_windows(draw, size, k):
    word = np.minimum((size * draw.random(k) ** 4).astype(np.int64), size - 1)  # frequent words, and words that come once
    unigram = (np.bincount(word, minlength=size) + 1.0) / (k + size)
    return language_model.contexts(word, draw.integers(0, language_model.SUFFIXES, k), np.full(k // 50, 50), size), word, unigram


@pytest.mark.parametrize("size,k", [(60, 1300), (300, 5000), (5000, 4950), (5000, 200)])
def test_steps_planned_together_are_those_of_one_minibatch_after_the_other(monkeypatch, size, k):
    monkeypatch.setattr(language_model, "PLANNED", 3 * language_model.BATCH)
    ctx, word, unigram = made_windows(np.random.default_rng(3), size, k)
    models, squares, draws = [language_model.LogBilinear(unigram) for _ in "ab"], [], []
    for m, train in zip(models, (plain_training, language_model.LogBilinear.train)):
        squares.append(np.full(len(m.flat), 1e-3, np.float32)), draws.append(np.random.default_rng(2))
        train(m, ctx, word, draws[-1], squares[-1])
    a, b = models
    assert np.array_equal(a.used, b.used) and draws[0].random() == draws[1].random()
    assert np.allclose(a.table, b.table, rtol=1e-4, atol=1e-5) and np.allclose(*squares, rtol=1e-4, atol=1e-6)


def test_training_takes_less_time_than_one_minibatch_after_the_other():
    ctx, word, unigram = made_windows(np.random.default_rng(3), 1 << 16, 40_000)
    least = {}
    for train in 3 * (plain_training, language_model.LogBilinear.train):
        model = language_model.LogBilinear(unigram)
        squares, begin = np.full(len(model.flat), 1e-3, np.float32), time.process_time()
        train(model, ctx, word, np.random.default_rng(2), squares)
        least[train] = min(least.get(train, math.inf), time.process_time() - begin)
    assert least[language_model.LogBilinear.train] < 0.75 * least[plain_training], least


def test_scoring_holds_few_logits_at_a_time():
    ctx, word, unigram = made_windows(np.random.default_rng(3), 1 << 16, 40_000)
    model = language_model.LogBilinear(unigram)
    tracemalloc.start()
    got = model.log_probabilities(ctx, word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all classes of 16,384 tokens are 25 MB
    some = np.arange(0, len(word), 40)
    p, cls = model.predicted(ctx[some]).astype(float), model.class_of[word[some]]
    logits = p @ model.q.T.astype(float)
    want = logits[np.arange(len(some)), cls] - np.log(np.exp(logits).sum(axis=1))
    for i, w in enumerate(word[some]):
        same = np.flatnonzero(model.class_of == cls[i])
        if len(same) > 1:
            inside = model.w[same].astype(float) @ p[i]
            want[i] += inside[w - same[0]] - np.log(np.exp(inside).sum())
    assert np.allclose(got[some], want, rtol=1e-5, atol=1e-5)


def test_tokens_and_their_places():
    texts = ["Aa Zz @[`{", None, "", "q \t\nQ\x0b\x0c\rä É\x1f", "x", "aZ"]
    h, suffix, n = language_model.tokens(pa.array(["left out", *texts]).slice(1))
    each = [w for t in texts for w in [*re.findall(rb"[^ \t-\r]+", (t or "").encode().lower()), None]]
    assert n.tolist() == [4, 1, 1, 5, 2, 2] and len(h) == len(each)
    assert suffix.tolist() == [0 if w is None else (w[-1] * 31 + (w[-2] if len(w) > 1 else 0)) % language_model.SUFFIXES for w in each]
    assert len(set(zip(h.tolist(), each))) == len(set(each)) == len(set(h.tolist()))
    vocabulary = language_model.Vocabulary(h[[0, 9]], np.array([3, 5]))
    at, number = vocabulary.look_up(h)
    known = [vocabulary.hot.tolist().index(x) if x in vocabulary.hot else -1 for x in h]
    assert at.tolist() == known and [i for i, a in enumerate(known) if a < 0] == [i for i, w in enumerate(each) if w not in (each[0], each[9], None)]
    assert number.tolist() == [vocabulary.number[a] if a >= 0 else vocabulary.size - 1 for a in known]


def test_license_scan(docs, rows, none, spark):
    made = [
        (1, "Released under the MIT License."), (2, "X. This work is licensed under the GNU\n# General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."),
        (4, "SPDX-License-Identifier: BSD-3-Clause"), (5, "mit! LICENSE and apache, license; mit license"), (6, "emit license"), (7, "GNU Lesser General Public License v2.1"), (8, None), (9, ""),
        (10, "é " * 30000 + "Licensed under the Apache License, Version 2.0"), (1, "Released under the MIT License."),
    ]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in made], SCHEMA).union(docs)
    got = collections.defaultdict(list)
    for r in licenses.scan(frame).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].labels for i in range(1, 11)] == ["mit", "gpl", "cc-by-nc", "bsd", "apache,mit", "", "gpl,lgpl", "", "", "apache"]
    assert [got[i][0].base_labels for i in (2, 4, 7, 10)] == ["gpl", "", "gpl", "apache"] and len([r for r in got[1] if r.n_words == 5]) == 2
    assert [(got[5][0].n_base, got[5][0].first_word, got[5][0].last_word), (got[10][0].first_word, got[10][0].n_words)] == [(3, 0, 5), (30003, 30008)]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = collections.Counter((i, len(word.findall((t or "").translate(lower)))) for i, t, *_ in rows)
    assert want <= collections.Counter((i, r.n_words) for i, rs in got.items() for r in rs)
    assert licenses.scan(none).count() == 0


def test_licenses_are_found_in_their_official_names():
    s = licenses.Scanner()
    names = {
        "mit": "MIT License", "apache": "Apache License 2.0", "gpl": "GNU General Public License v3.0", "lgpl": "GNU Lesser General Public License v2.1",
        "agpl": "GNU Affero General Public License v3.0", "gfdl": "GNU Free Documentation License v1.3", "bsd": 'BSD 3-Clause "New" or "Revised" License', "isc": "ISC License",
        "zlib": "zlib License", "mpl": "Mozilla Public License 2.0", "epl": "Eclipse Public License 2.0", "edl": "Eclipse Distribution License 1.0",
        "cpl": "Common Public License 1.0", "cddl": "Common Development and Distribution License 1.0", "eupl": "European Union Public License 1.2", "unlicense": "The Unlicense",
        "wtfpl": "Do What The F*ck You Want To Public License", "boost": "Boost Software License 1.0", "busl": "Business Source License 1.1",
        "sspl": "Server Side Public License, v 1", "elastic": "Elastic License 2.0", "artistic": "Artistic License 2.0", "python": "Python Software Foundation License 2.0",
        "php": "PHP License v3.01", "ruby": "Ruby License", "postgresql": "PostgreSQL License", "openssl": "OpenSSL License", "ofl": "SIL Open Font License 1.1",
        "cecill": "CeCILL Free Software License Agreement v2.1", "mulan": "Mulan Permissive Software License, Version 2", "ms-pl": "Microsoft Public License",
        "ms-rl": "Microsoft Reciprocal License", "apsl": "Apple Public Source License 2.0", "osl": "Open Software License 3.0", "afl": "Academic Free License v3.0",
        "ncsa": "University of Illinois/NCSA Open Source License", "qpl": "Q Public License 1.0", "upl": "Universal Permissive License v1.0",
        "odbl": "Open Data Commons Open Database License v1.0", "odc-by": "Open Data Commons Attribution License v1.0",
        "pddl": "Open Data Commons Public Domain Dedication & License 1.0", "cc0": "Creative Commons Zero v1.0 Universal",
        "cc-by-nc-nd": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
        "cc-by-nc-sa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc": "Creative Commons Attribution-NonCommercial 4.0 International",
        "cc-by-nd": "Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-sa": "Creative Commons Attribution-ShareAlike 4.0 International",
        "cc-by": "Creative Commons Attribution 4.0 International",
    }
    assert set(names) == {label for label, *_ in licenses.LICENSES} - {"public-domain", "proprietary"}
    for label, name in names.items():
        assert {r.label for _, _, r in s.settle(s.detections(f"this is under {name.lower()}."))} == {label}, name
    assert {r.label for _, _, r in s.settle(s.detections("creative commons attribution-share alike 3.0"))} == {"cc-by-sa"}


def test_rules_hold_their_keywords_and_settle():
    s = licenses.Scanner()
    assert len(s.rules) > 300 and all(r.keywords for r in s.rules)
    found = s.settle(s.detections("licensed under the terms of the mozilla public license, version 2.0"))
    assert [(r.label, r.priority) for _, _, r in found] == [("mpl", 2)]


def test_chunks_are_encoded_and_placed_in_bounded_parts(monkeypatch):
    path = packing.tokenizer_path()
    ids, seen = tokens.WordIds(path), []
    texts = [" ".join(f"word{(i * j) % 9973} Ünïted 12.5" for i in range(2000)) for j in (1, 7, 31)] + [None, "", " \n", "Größe 漢字 a|b"]
    monkeypatch.setattr(ids, "chunks", lambda joined: seen.append(joined.count(" ") + 1) or tokens.WordIds.chunks(ids, joined))
    monkeypatch.setattr(tokens, "CODED", 1000, raising=False)
    monkeypatch.setattr(tokens, "PLACED", 777, raising=False)
    got, ends = ids.of_all(pa.array(texts, pa.string()))
    assert len(seen) == 5 and max(seen) <= 1000
    want = [ids.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
