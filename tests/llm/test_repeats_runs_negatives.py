"""Repeated passages, periodic runs and hard negatives against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import negatives, repeats, runs

SCHEMA = "doc_id long, text string, lang string, id long, low string, w string"


def say(draw, n, k=400):
    return " ".join(f"w{draw.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    passage, line = say(draw, 70), say(draw, 20)
    made = [(i, say(draw, draw.randint(0, 120))) for i in range(40)]
    made += [(100 + i, f"{say(draw, 9)} {passage} {say(draw, 9)} {line}\t{say(draw, i)}") for i in range(20)]
    made += [(200 + i, made[3][1]) for i in range(5)]  # exact copies
    made += [(50, passage + "\n" + passage), (51, " ".join(["a"] * 90)), (52, line), (53, " ".join(line.split()[:19])), (54, None), (55, ""), (56, " \t\n")]
    made += [(57, say(draw, 30_000, 5000) + " " + passage), (58, "Ä ö " * 30), (59, "x y z " * 20 + "x")]
    made += [(60, passage), (60, passage), (60, line + " " + passage), (None, passage), (None, None), (61, say(draw, 200, 2))]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "clash", "clash") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def xxhash_order(spark, rows):
    """Rows in the order in which an earlier window is looked for."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(t or "",) for t in {t for _, t in rows}], "text string")
    h = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    return {(i, t): (i is not None, i or 0, h[t or ""]) for i, t in rows}


def removed(spark, rows, size):
    order, first = xxhash_order(spark, rows), {}
    split = {r: (r[1] or "").encode().split() for r in rows}
    for r, w in split.items():
        for s in range(len(w) - size + 1):
            k, at = tuple(w[s : s + size]), (*order[r], s)
            first[k] = min(first.get(k, at), at)
    out = []
    for r in rows:
        w = split[r]
        keep = [True] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (*order[r], s):
                keep[s : s + size] = [False] * size
        kept = b" ".join(x for x, k in zip(w, keep) if k).decode()
        out.append((r[0], len(w), keep.count(False), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [20, 6])
def test_repeated_passages(spark, docs, none, rows, size):
    got = sorted(map(tuple, repeats.remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == removed(spark, rows, size)
    if size == 20:
        assert repeats.remove_repeats(none).count() == 0


def test_repeats_do_not_depend_on_buckets_or_slices(spark, docs, rows, monkeypatch):
    whole = repeats.slices
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 100)
    own = repeats.keyed(docs.repartition(7))
    gone = repeats.later(own, repeats.repeated(own, 20), 20).selectExpr("key.id", "key.none", "low", "high")
    monkeypatch.undo()
    assert repeats.slices is whole
    own = repeats.keyed(docs)
    again = repeats.later(own, repeats.repeated(own, 20), 20).selectExpr("key.id", "key.none", "low", "high")
    assert sorted(map(str, gone.collect())) == sorted(map(str, again.collect()))


def test_a_passage_on_all_rows_is_kept_once(spark):
    passage = say(random.Random(1), 40)
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(3000)], "doc_id long, text string").repartition(20)
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert got[0] == 0 and set(got.values()) == {0, 40} and sum(got.values()) == 40 * 2999


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def looped(i, text):
    w = (text or "").encode().split()
    if i is None or not w or (h := zlib.crc32(str(i).encode())) % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k if k < a else a + (k - a) % p] for k in range(n)]


def digest(i, text):
    w = looped(i, text)
    found = brute_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    s, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(found), s, n, q, 1000 * n // q if found else None, sha(lines.encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_documents(docs, none, rows):
    some = [r for r in rows if len(r[1] or "") < 20_000]
    got = {str(r[0]) + str(r[7]): tuple(r) for r in runs.digests(runs.collapse_runs(runs.with_loops(docs))).collect()}
    want = {str(d[0]) + str(d[7]): d for d in (digest(*r) for r in some)}
    assert any(d[1] for d in want.values()) and {k: got[k] for k in want} == want
    assert runs.digests(runs.collapse_runs(runs.with_loops(none))).count() == 0


def test_runs_of_drawn_sequences():
    draw = random.Random(3)

    def sequence():
        k = draw.choice([1, 2, 3, 8, 50])
        w = [draw.randrange(k) for _ in range(draw.randint(0, 200))]
        for _ in range(draw.randint(0, 3)):
            base = [draw.randrange(k) for _ in range(draw.randint(1, 12))]
            at = draw.randint(0, len(w))
            w[at:at] = (base * 80)[: draw.randint(1, 80)]
        return w + w[: draw.randint(0, len(w))] if draw.random() < 0.5 else w

    texts = [sequence() for _ in range(300)] + [[0] * 3000, [0, 1] * 500 + [0] * 99, [], [1]]
    n = np.array([len(t) for t in texts])
    codes = runs.mix(np.arange(1, 60, dtype=np.uint64))
    s, e, q = runs.runs_of(np.concatenate([codes[np.array(t, int)] for t in texts]), n)
    begins = np.cumsum(n) - n
    owner = np.searchsorted(np.cumsum(n), s, "right")
    got = sorted((int(k), int(a - begins[k]), int(b - a), int(p)) for k, a, b, p in zip(owner, s, e, q))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]


def test_rules_cover_a_sequence():
    draw = random.Random(9)
    for _ in range(30):
        ids = [draw.randrange(4) for _ in range(draw.randint(0, 120))]
        made, left = runs.rules(ids)
        for part, whole, at in made:
            assert len(at) > 1 and 0 < part < whole and len({tuple(ids[i : i + whole]) for i in at}) == 1
        assert left == sorted(left) and (not ids or left[0] == 0)


def brute_negatives(rows):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [float(np.floor(256 * float(np.float32(x)))) for x in v])
        seen[i] = min(seen.get(i, one), one)
    out = []
    for a, (label, v) in seen.items():
        if a % 100:
            continue
        score = {i: min(max(sum(int(x) * int(y) for x, y in zip(v, w)), -(2**63)), 2**63 - 1) for i, (_, w) in seen.items() if i != a}
        rank = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in rank if seen[i][0] == label][:5]:
            window = [i for i in rank if seen[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(window, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    g = np.random.default_rng(4)
    centres = g.normal(size=(6, 8))
    made = [(i, [float(x) for x in (centres[i % 6] + 0.3 * g.normal(size=8)).astype(np.float32)], int(g.integers(0, 4))) for i in range(0, 3000, 3)]
    made += [(100_000 + 100 * i, made[5][1], 1) for i in range(40)]  # equal anchors
    made += [(1, None, 1), (2, [1.0] * 8, None), (4, [1.0, None] * 4, 2), (5, [float("nan")] * 8, 2), (7, [float("inf")] * 8, 2), (None, [1.0] * 8, 1)]
    made += [(8, [], 1), (200, [], 1), (10, [1.0, 2.0], 2), (400, [0.5] * 12, 3), (11, [1e12] * 8, 2), (500, [-1e30, 1e30], 2), (300, [0.25] * 8, 0), (300, [0.125] * 8, 0), (300, [0.125] * 8, 0)]
    rows = spark.createDataFrame([(i, v, x, "clash", 1) for i, v, x in made], "vec_id long, embedding array<float>, label int, v string, part int").repartition(5)
    want = brute_negatives(made)
    assert len(want) > 500 and sorted(map(tuple, negatives.mine(rows).collect())) == want
    monkeypatch.setattr(negatives, "BLOCK", 150)
    monkeypatch.setattr(negatives, "GROUP", 9)
    assert sorted(map(tuple, negatives.mine(rows).collect())) == want
    assert negatives.mine(rows.limit(0)).count() == 0


def test_bounds_leave_out_candidates():
    g = np.random.default_rng(6)
    v = np.floor(256 * (g.normal(size=(1, 16)) + 0.01 * g.normal(size=(30, 16))))
    block = negatives.Block(np.arange(500), np.zeros(500, int), np.floor(256 * g.normal(size=(500, 16))))
    order, parents, edges = negatives.spanning_tree(v)
    counted = []
    for k, rows, exact in block.walk(v[order], parents, edges, lambda k, low, high: (high >= 200_000) & (low <= 400_000)):
        full = negatives.scores(block.x, v[order][k])
        assert set(np.flatnonzero((full >= 200_000) & (full <= 400_000))) <= set(rows.tolist())
        counted.append(len(rows))
    assert sum(counted) < 0.6 * 500 * len(v)
