"""Pages, conversations, and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import chat, html_text, language


@pytest.fixture(scope="module")
def trees():
    draw = random.Random(1)
    words = [f"word{i}," for i in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    pages = []
    for _ in range(60):
        body = "".join(f"<p>{say(draw.randint(3, 80))}</p>" for _ in range(draw.randint(2, 9)))
        menu = "".join(f"<li><a href=/{i}>{say(2)}</a></li>" for i in range(5))
        pages.append(f"<html><head><title>{say(4)}</title><script>if(a<b)x()</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{say(6)}</div><article><h1>{say(5)}</h1>{body}</article><footer>{say(7)}</footer></body></html>")
    return pages


def main_text(model, source):
    page = html_text.Page(source)
    taken = html_text.choose(page.parent, model.log_odds(html_text.features(page)))
    return " ".join(t for b, t in page.text if taken[b])


def test_pages(spark, trees):
    frame = spark.createDataFrame([(i, f"u{i}", s, 1) for i, s in enumerate(trees)] + [(100, None, None, 1), (101, "u", "", 1), (None, "u", trees[0], 1), (0, "u0", trees[0], 1)], "page_id long, url string, html string, text long")
    model = html_text.fit(frame)
    got = html_text.extract(frame, model).collect()
    assert len(got) == len(trees) + 4
    for r in got:
        s = trees[r.page_id if r.page_id is not None and r.page_id < 100 else 0]
        want = "" if r.page_id in (100, 101) else " ".join(s.split("<article>")[1].split("</article>")[0].replace("<", " <").replace(">", "> ").replace("<p>", "").replace("</p>", "").replace("<h1>", "").replace("</h1>", "").split())
        assert r.text == want and r.n_chars == len(want)
    none = html_text.extract(frame.limit(0))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]
    side = trees[3].replace("<article>", '<div class="post-content">').replace("</article>", "</div><section id='comments'><p>reader word1, word2,</p></section>")
    assert main_text(model, side) == main_text(model, trees[3])


def test_one_page_with_a_landmark_among_many_is_learned_from(spark, trees):
    plain = [f"<html><body><div><p>page {i}</p></div></body></html>" for i in range(3000)]
    frame = spark.createDataFrame([(i, "u", s) for i, s in enumerate([*plain, trees[0]])], "page_id long, url string, html string")
    model = html_text.fit(frame, sample=5)
    assert model is not None and "word" in main_text(model, trees[0])


def test_copies_of_a_page_count_once(spark, trees):
    frame = spark.createDataFrame([(i, "u", trees[0]) for i in range(6000)] + [(9000 + i, "u", t) for i, t in enumerate(trees[1:4])], "page_id long, url string, html string")
    model = html_text.fit(frame)
    assert model is not None and "word" in main_text(model, trees[0])


def test_pages_without_landmarks_use_the_prior(spark):
    page = "<html><body><div class=menu><a href=/>Home</a></div><div><h1>Title</h1><p>The text, of the page.</p></div><ul><li><a href=/x>More</a></li></ul><div id='site-footer'>Contact</div></body></html>"
    frame = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    assert html_text.fit(frame) is None
    assert {r.page_id: r.text for r in html_text.extract(frame).collect()} == {1: "Title The text, of the page.", 2: "", 3: ""}


def test_page_reader():
    read = lambda s: [(html_text.Page(s).tag[b], t) for b, t in html_text.Page(s).text]
    assert read("<p><b>One<br>two<p>a&amp;b<i>c</i>&nbsp; d") == [("p", "One two"), ("p", "a&bc d")]
    assert read("<ul><li>x<li>y<ul><li>z</ul></ul>tail") == [("li", "x"), ("li", "y"), ("li", "z"), ("html", "tail")]
    assert read("<body><!-- <p>no</p> --><script>var t='</p>'</SCRIPT ><div title='a>b'>t<![CDATA[<x>]]></div></i></div>u") == [("div", "t<x>"), ("body", "u")]
    assert read("<table><tr><td>1<td>2<tr><td>3</table><select><option>no</select>") == [("td", "1"), ("td", "2"), ("td", "3")]
    deep = html_text.Page("<div>" * 5000 + "x")
    assert len(html_text.features(deep)) == len(deep.tag)


def test_choice_is_the_best_consistent_one():
    draw = random.Random(2)
    for _ in range(50):
        n = draw.randint(1, 9)
        parent = [-1] + [draw.randrange(k) for k in range(1, n)]
        odds = np.array([draw.uniform(-2, 2) for _ in range(n)])
        taken = html_text.choose(parent, odds)
        assert all(not taken[k] or parent[k] < 0 or taken[parent[k]] for k in range(n))
        allowed = [m for m in range(2**n) if all(not m >> k & 1 or parent[k] < 0 or m >> parent[k] & 1 for k in range(n))]
        assert odds[taken].sum() == pytest.approx(max(sum(odds[k] for k in range(n) if m >> k & 1) for m in allowed))


ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "[OUT] x</s>", "", None, "é\n\n[ROLE:a]", "<s>" * 3, "plain"]


def conversations(spark):
    draw = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(draw.randint(1, 6)):
            role = ["system", "user", "assistant", "tool", None, "a]:b"][draw.choice([1, 2, 2, 0, 3, 4, 5])] if c % 5 == 4 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "hello" if t == 0 and c % 5 else draw.choice(ODD)))
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 7}") for t in range(300)]
    rows += [(60, 0, "user", "hello"), (60, 0, "user", "hello"), (None, 1, "user", "no id"), (None, None, "user", None)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")


def test_chats_are_read_back(spark):
    rows, frame = conversations(spark)
    got = {r.conv_id: r for r in chat.digests(frame).collect()}
    want = collections.defaultdict(list)
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, _, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    want[-7] = [("user", ODD[0]), ("assistant", ODD[0])]
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(*x)[0]) for x in turns)


def test_trees_are_laid_depth_first_and_attend_to_their_path(spark):
    _, frame = conversations(spark)
    nodes, members = (x.collect() for x in chat.prefix_trees(frame))
    by_path, flat = {r.path: r for r in nodes}, {}
    assert len(by_path) == len(nodes)
    for r in nodes:
        for k, ch in enumerate(r.turn):
            assert flat.setdefault((bytes(r.tree), r.start + k), ch) == ch
    sizes = collections.Counter(t for t, _ in flat)
    assert all(sum(r.length for r in nodes if bytes(r.tree) == t) == n and (t, n - 1) in flat for t, n in sizes.items())  # gapless, nothing twice
    paths = collections.defaultdict(dict)
    for r in members:
        paths[r.conv][r.depth] = bytes(r.path)
    spans = collections.defaultdict(list)
    for conv, by_depth in paths.items():
        position, seen = 0, []
        for d in range(len(by_depth)):
            r = by_path[by_depth[d]]
            assert r.position == position
            attended = "".join(flat[(bytes(r.tree), k)] for a in r.attend for k in range(a.start, a.stop))
            assert attended == "".join(by_path[p].turn for p in seen)
            position += r.length
            seen.append(by_depth[d])
            spans[by_depth[d]].append(seen[:])
    # depth first: the nodes below a node follow it without a gap
    below = collections.defaultdict(set)
    for by_depth in paths.values():
        line = [by_depth[d] for d in range(len(by_depth))]
        for k, p in enumerate(line):
            below[p].update(line[k:])
    for p, under in below.items():
        assert max(by_path[q].start + by_path[q].length for q in under) - by_path[p].start == sum(by_path[q].length for q in under)
    assert chat.digests(frame.limit(0)).count() == 1


def test_stages_follow_each_other(spark, tmp_path):
    draw = random.Random(9)
    say = lambda n, s="the of in on er and".split(): " ".join("".join(draw.choice(s) for _ in range(3)) for _ in range(n))
    item = say(30)
    rows = [(i, say(80), "en") for i in range(25)]
    rows += [(30, rows[2][1], "en"), (31, rows[3][1] + " more", "en"), (40, say(20) + " " + item + " " + say(20), "en"), (50, None, "en"), (51, "...", "en")]
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    left = [set(range(25)) | {30, 31, 40}, set(range(25)) | {40}, set(range(25))]
    for (_, stage), want in zip(corpus_pipeline.STAGES, left):
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(25)) and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


def test_stages_take_empty_tables_clashing_names_and_repeated_ids(spark, tmp_path):
    draw = random.Random(4)
    say = lambda n: " ".join("".join(draw.choice("the of in on er and".split()) for _ in range(3)) for _ in range(n))
    a, b, item = say(70), say(70), say(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, component_id string, text_key int, row string"
    rows = [(i, t, "en", "s", 0, 0, "c", 1, "r") for i, t in [(1, a), (2, a), (2, b), (3, say(20) + " " + item), (None, say(40))]]
    docs = spark.createDataFrame(rows, schema)
    for wanted, frame in ((3, docs), (0, docs.limit(0))):
        for _, stage in corpus_pipeline.STAGES[:3]:
            frame = stage(spark, frame, str(tmp_path)).cache()
            assert frame.columns == docs.columns
        assert frame.count() == wanted and (not wanted or {r.text for r in frame.collect()} == {a, b, rows[4][1]})
        assert corpus_pipeline.STAGES[3][1](spark, frame, str(tmp_path)).select("doc_id").distinct().count() == wanted


def test_rejection_margin(spark):
    docs = spark.createDataFrame([(1, "xyz", "en"), (2, "the thing and the other thing " * 9, "en"), (3, "der die das und die sache " * 9, "de"), (4, "der hund und die katze " * 9, "de"), (6, "the dog and the cat and " * 9, "en")], "doc_id long, text string, lang string")
    strict = language.predict(docs.select("doc_id", "text"), language.learned(docs), margin=0.9).collect()
    assert all(r.rejected == (r.score < 0.9) for r in strict)


def test_stage_drops_noise_and_languages_that_were_not_learned(spark):
    draw = random.Random(6)
    parts = {"en": "the tion ing er on re th and of in".split(), "de": "ung keit ein sch der ver en ge".split()}
    say = lambda s, n: " ".join("".join(draw.choice(s) for _ in range(3)) for _ in range(n))
    made = [(i, say(parts[lang], 60), lang) for i in range(80) for lang in [draw.choice(["en", "de"])]] + [(80, "Hi", None), (81, "der die", None)]
    odd = lambda s: "".join(draw.choice(s + "    ") for _ in range(600))
    bad = [(100 + i, odd("abcdefghijklmnopqrstuvwxyz"), None) for i in range(20)] + [(200 + i, odd("абвгдежзиклмнопрстуф"), None) for i in range(20)]
    docs = spark.createDataFrame(made + bad, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [i for i, *_ in made]
