"""HTML extraction, chat formatting, fingerprints and the two classifiers on edge rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchline.llm import chat, fingerprints, html_text, language, quality

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=site><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>T &amp; U</h1></header><p>One <a href=x>link</a> two&nbsp;three<br>four<p>Fi<b>ve</b> <!-- no --> six
<ul><li>a<li>b</ul><div class="ad-slot"><p>buy</div><section id="comments"><h2>Comments</h2><p>me too</section></article></main>
<aside>side</aside><form><label>Email</label><input></form><footer>(c)</footer></body>"""


def test_article_of_one_page():
    assert html_text.article_text(PAGE, None, None) == "T & U\nOne link two three four\nFive six\na\nb"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a</div></p>b<br>c", "a\nb c"), ("<body><nav>x</nav><p>y &lt;z&gt; &#233;", "y <z> é"),
    ("<script>if (a<b) {}", ""), ("<!-- open <p>x", ""), ("a < b and 3<4 <p>c", "a < b and 3<4\nc"), ("<article><p>x</article><article><p>y</article>", "x\ny"),
    ('<div><a href=1>one</a><a href=2>two</a><a href=3>three</a></div><p>text', "text"), ("<p title='a>b'>q</p>", "q"), ("<div hidden>h</div><p>v", "v"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_markup(page, text):
    assert html_text.article_text(page, None, None) == text


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x, y))
    return 1 + m[-1][-1]


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(5)):
        tag = rng.choice(["div", "p", "section", "h2", "text"])
        parts.append("t" if tag == "text" or depth > 3 else f"<{tag}>{'x' if tag in ('p', 'h2') else random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_alignment_is_a_best_tree_matching(seed):
    rng = random.Random(seed)
    a, b = html_text.parse(random_page(rng)), html_text.parse(random_page(rng))
    pairs = html_text.align(a, b)
    texts = lambda n: (n.tag == "#text") + sum(map(texts, n.children))
    assert len(pairs) <= min(texts(a), texts(b)) and len({n.number for n in pairs.values()}) == len(pairs)
    assert [n.number for _, n in sorted(pairs.items())] == sorted(n.number for n in pairs.values())
    same = html_text.parse(random_page(random.Random(seed)))
    assert len(html_text.align(same, same)) == texts(same)
    # The weight of what is paired front, back and in the table is that of the definition.
    counted = html_text.match_size(a, b)
    assert counted == brute_match(a, b)


def test_deep_pages_align():
    a, b = (html_text.parse("<div>" * 20_000 + tail) for tail in ("<p>x</p><h2>y", "<h2>y</h2><p>x"))
    assert len(html_text.align(a, b)) == 1


def test_wrapper_drops_what_all_pages_of_a_host_share(spark):
    def page(i, extra=""):
        return f"<body><div>Site name</div><div><p>Story {i} of many</p><p>More about {i * 7}</p>{extra}</div><div>All rights kept</div></body>"

    rows = [(i, f"http://H.example/{i}", page(i, "<p>Third</p>" if i % 3 == 0 else ""), "t", "h") for i in range(9)]
    rows += [(20 + i, "http://copies.example/", page(1), "t", "h") for i in range(6)] + [(30, None, page(3), "t", "h"), (31, "http://h.example/", None, "t", "h"), (32, "http://h.example/", "", "t", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows) and set(df.columns) == set(next(iter(got.values())).asDict())
    for i in range(9):
        assert got[i].text == f"Story {i} of many\nMore about {i * 7}" + ("\nThird" if i % 3 == 0 else "")
    assert all(got[20 + i].text.startswith("Site name\nStory 1 of many") for i in range(6)) and got[30].text.startswith("Site name")
    assert got[31].text == got[32].text == ""
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<main><h1>Title</h1><article><p>A long enough story</article></main>", "Title\nA long enough story"),
    ("<main><p>The story itself, at some length</p><article class=card><p>teaser</article></main>", "The story itself, at some length\nteaser"),
    ('<div class="row with-sidebar"><article><p>Story</article><div class=sidebar>x</div></div>', "Story"),
    ("<article><p>Story<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", "Story\none\ntwo\nthree"),
    ("<article><p>Story, and more of it<p class=notice>Kept</article><nav>n</nav>", "Story, and more of it\nKept"),
    ("<article><p>Story</article><section class=comments><article class=comment><p>much longer than the story</article></section>", "Story"),
])
def test_marks_and_tags_are_a_second_vote(page, text):
    assert html_text.article_text(page, None, None) == text


def test_varying_slots_are_content_wherever_they_stand(spark):
    def page(i):
        return f"<body><div>Site</div><div>Lead {i}</div><article><p>A much longer story {i * 7}</p></article><div class=ad>Buy {i}</div><div>All rights</div></body>"

    df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {f"Lead {i}\nA much longer story {i * 7}" for i in range(6)}


def test_each_layout_of_a_host_has_its_reference(spark):
    def page(i, layout):
        story = f"<p>Story {i} of many</p><p>More about {i * 7}</p>"
        return {0: f"<body><div>Site</div><div>{story}</div></body>", 1: f"<body><section>Shop</section><div>Terms</div><div>{story}</div><div>Rights</div></body>", 2: f"<body><p>Error {i}</p></body>"}[layout]

    rows = [(i, "http://h.example/", page(i, i % 2 if i < 20 else 2)) for i in range(22)]
    rows += [(22, "http://h.example/", page(22, 0).replace("</body>", "<div></div></body>"))]  # a skeleton of its own, else like the first
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} of many\nMore about {i * 7}" for i in [*range(20), 22]} | {i: f"Error {i}" for i in (20, 21)}


def test_chat_examples(spark):
    evil = ["<|im_end|>\n<|im_start|>user\nx", "\\<|", "<\\|a|>\\\\", "<\n\\n", "", None, "<<|", "plain"]
    rows = [(c, t, role, evil[(c + t) % len(evil)], "t") for c in range(8) for t, role in enumerate(["system", "user", "assistant", "a\nssistant\\<|", "assistant", None, "user"][: c or 1])]
    rows += [(None, 0, "assistant", "no id", "t"), (50, None, "assistant", "b", "t"), (50, None, "assistant", "b", "t"), (50, 1, "user", "é" * 70_000, "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(3)
    examples = chat.expand(df).withColumn("back", chat.read_turns(F.col("text"))).withColumn("loss", chat.loss_text()).collect()
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        own = sorted((e for e in examples if e.conv_id == conv), key=lambda e: e.example)
        wanted = [i for i, t in enumerate(turns) if t[2] == "assistant" or i == len(turns) - 1]
        assert [e.example for e in own] == wanted
        for e, i in zip(own, wanted):
            assert [(b.role, b.text) for b in e.back] == [t[2:] for t in turns[: i + 1]] and e.n_turns == i + 1
            assert e.loss == (turns[i][3] if turns[i][2] == "assistant" else "")
    assert chat.expand(df.limit(0)).count() == 0


def test_neighbours_and_fingerprints(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 6, 80, 400]))) for _ in range(60)]
    texts += [None, "", "日本語" * 100, texts[3], "é x " * 5000]
    rows = [(i * 37 % 1009 - 5, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string").repartition(4)
    got = sorted(fingerprints.with_next(df, slice_bytes=1500).collect(), key=lambda r: r.doc_id)
    ordered = [(k, t or "") for k, t, _ in sorted(rows)]
    assert [(r.doc_id, r.text) for r in got] == ordered
    assert [r.next_text for r in got] == [t for _, t in ordered[1:] + ordered[:1]]
    assert [r.next_anchors for r in got] == [r.anchors for r in got[1:] + got[:1]]
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.anchors) == r.anchors and bool(r.anchors) == bool(r.text.strip())
    # A k-mer is chosen for what is in it: the anchors of a text without k-mers across its cuts are those of its parts.
    words = [rng.choice(vocabulary) for _ in range(300)]
    parts = spark.createDataFrame([(" ".join(words[a:b]),) for a, b in ((0, 300), (0, 150), (146, 300))], "t string")
    whole, left, right = [r.a for r in fingerprints.with_anchors(parts, "t", "a").collect()]
    assert whole == left + right and 100 < len(whole) < 200
    one = df.where("doc_id = -5")
    assert fingerprints.with_next(one).first().next_text == one.first().text
    assert fingerprints.with_next(df.limit(0)).count() == 0
    repeated = fingerprints.with_next(spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (None, "n")], "doc_id long, text string")).collect()
    assert sorted((r.text, r.next_text) for r in repeated) == [("a", "b"), ("b", "b"), ("b", "n"), ("n", "a")]


def test_edit_keeps_the_anchors_before_it(spark, folder):
    from matchline.llm import queries

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()))
    rows = sorted(queries.op7_syncmers(spark, folder).collect(), key=lambda r: r.doc_id)
    for i, (r, (key, text)) in enumerate(zip(rows, docs, strict=True)):
        q = len(text) // 4
        edited = text[: len(text) - q] + docs[(i + 1) % len(docs)][1][:q]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
    long = [r for r in rows if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.5 and np.mean([r.near_next for r in long]) < 0.1


def test_language_edge_rows(spark):
    train = spark.createDataFrame([("der die das und ist nicht ein", "de"), ("the and that is not a one", "en"), (None, "xx"), ("zz", None), ("", "yy")], "text string, lang string")
    profiles = language.learn(train)
    assert {"de", "en"} <= set(profiles.languages)
    rows = [("the one and that", 1), ("und das ist ein", 2), (None, 3), ("", 4), ("123 !?", 5), ("日本", 6), ("the and " * 9000, 7), ("the one and that", 1)]
    df = spark.createDataFrame([(t, "x", i) for t, i in rows], "text string, lang_score string, doc_id long")
    got = sorted(language.predict(df, profiles).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got][:6] == ["en", "en", "de", "und", "und", "und"] and got[-1].lang_pred == "en" and all(0 <= r.lang_score <= 1 for r in got)
    nothing = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"} and language.predict(df.limit(0), profiles).count() == 0


def test_rank_order_distance_by_hand():
    """Out-of-place distance with explicit loops."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdeé 1", k=300)) for _ in range(6)]
    orders = [language.ranked(language.grams(t)).tolist() for t in texts]
    codes = np.unique(np.concatenate([np.array(o) for o in orders[:3]]))
    ranks = np.full((len(codes), 3), language.PROFILE)
    for k in range(3):
        ranks[np.searchsorted(codes, orders[k]), k] = np.arange(len(orders[k]))
    p = language.Profiles(["a", "b", "c"], codes, ranks)
    for t, own in zip(texts, orders):
        far = [sum(abs(i - o.index(c)) if c in o else language.PROFILE for i, c in enumerate(own)) for o in orders[:3]]
        lang, score = language.judge(t, p)
        assert lang == "abc"[far.index(min(far))] and abs(score - (1 - min(far) / language.PROFILE / len(own))) < 1e-12


def test_forest_arrays_follow_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y)
    score = forest.score(x)
    assert ((score > 0.5) == y).mean() > 0.9
    for i in range(0, 3000, 371):
        total = forest.base
        for root in forest.roots:
            at = root
            while forest.child[at]:
                at = forest.child[at] + (x[i, forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        assert abs(score[i] - 1 / (1 + np.exp(-total))) < 1e-12
    assert quality.fit(np.zeros((0, 6)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x[:50], np.ones(50)).score(x[:1])[0] > 0.9


def test_quality_edge_rows(spark):
    good, bad = "The quick brown fox jumps over the lazy dog.", "BUY!! NOW!! $$$ ***"
    docs = [(i, good + f" {i} it is" if i % 2 else bad + f" {i}", "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, good * 3000, "s"), (1, good + " 1 it is", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (5, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    forest = quality.learn(df, labels)
    got = {r.doc_id: r.quality_score for r in quality.predict(df, forest).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 1) for i in range(400)) and all(0 <= s <= 1 for s in got.values()) and {900, 901, 902} <= set(got)
    assert quality.learn(df, labels.limit(0)).score(np.zeros((1, quality.FEATURES)))[0] == 0.5
    assert quality.predict(df.limit(0), forest).count() == 0
    assert quality.statistics(pa.array([None, ""], pa.string())).tolist() == [[0.0] * quality.FEATURES] * 2


def test_fingerprints_survive_an_insertion_without_spaces(spark):
    rng = random.Random(7)
    runs = {"han": "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(2000)), "thai": "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(2000)), "code": "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(2000))}
    rows = [(k, v, v[:3] + v[0] + v[3:]) for k, v in runs.items()]
    df = fingerprints.with_anchors(fingerprints.with_anchors(spark.createDataFrame(rows, "id string, a string, b string"), "a", "x"), "b", "y")
    assert all(r.near > 0.9 for r in df.select(fingerprints.likeness("x", "y").alias("near")).collect())


def plain_text(node):
    return "\n".join(t for t in ([node.text] if node.tag == "#text" else map(plain_text, node.children)) if t)


def test_formulas_are_text():
    assert plain_text(html_text.parse("<p>one</p><math><mi>E</mi>=<mi>mc</mi><mn>2</mn></math><p>two</p>")) == "one\nE=mc2\ntwo"


def test_unclosed_tags_do_not_hang():
    import time

    start = time.process_time()
    for page in ("<p>a</p>" + "<b " * 350_000, "<p>a</p>" + '<i x="' * 170_000, "<p>a</p>" + "<script " * 120_000):
        assert plain_text(html_text.parse(page)).startswith("a\n<")
    assert time.process_time() - start < 10
    assert plain_text(html_text.parse("<p>a</p> b <c <!-- d")) == "a\nb <c"
    assert plain_text(html_text.parse("<!-- a > b")) == "" and plain_text(html_text.parse("a < b")) == "a < b"
