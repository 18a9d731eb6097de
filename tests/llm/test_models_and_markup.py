"""Language identification, quality rules, page extraction and chat formatting."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pursuit.llm import chat_format, html_extract, language_id, quality


def test_language_on_held_out_documents(given):
    docs = given("documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(docs).count() == docs.count()


def test_language_of_odd_texts(docs_of):
    rows = [(i, t * 30, lang, None) for i in range(40) for t, lang in (("the cat sat ", "x"), ("ßüö äh öä ", "y"))]
    odd = [(1000, None, "x", None), (1001, "", "x", None), (1002, "12 !! \n", None, None), (None, "the cat", "y", None), (1003, "ü", None, None),
           (1004, "the cat sat " * 9000 + "ßüö", None, None)]
    got = {r.doc_id: r for r in language_id.identify(docs_of(rows + odd)).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004].lang_pred == "x" and got[None].held_out
    assert got[0].held_out == ((__import__("zlib").crc32(b"0") % 4) == 2)
    unlabelled = language_id.identify(docs_of([(1, "words", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    assert language_id.identify(docs_of([])).collect() == []


def test_windows_cover_every_byte():
    data = np.frombuffer(b"a" * 1000 + b"bc", np.uint8)
    w, owner = language_id.windows_of(data, np.array([0, 1000]), np.array([1000, 1002]))
    assert owner.tolist() == [0] * 4 + [1] and w.shape == (5, language_id.WINDOW) and w[4, :3].tolist() == [98, 99, 0]
    assert sum((x > 0).sum() for x in w[:4]) == 1000 + 3 * (max(language_id.WIDTHS) - 1)


def test_features_equal_plain_convolution():
    rng = np.random.default_rng(1)
    net = language_id.train(rng.integers(0, 255, (40, language_id.WINDOW), dtype=np.uint8), rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    x = rng.integers(0, 255, (3, language_id.WINDOW), dtype=np.uint8)
    want = []
    for w in language_id.WIDTHS:
        n = x.shape[1] - w + 1
        want.append(np.maximum(sum(net.filters[w][j][x[:, j:j + n]] for j in range(w)).max(1) + net.bias[w], 0))
    assert np.allclose(net.features(x, net.pair_tables()), np.concatenate(want, 1), atol=1e-4)


def test_quality_on_held_out_documents(given):
    got = quality.score(given("documents"), given("labels")).join(given("labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    clean = [r.predicted for r in got if r.quality == 1]
    assert np.mean(clean) > 0.95


def test_quality_of_odd_texts(spark, docs_of):
    docs = docs_of([(1, None, None, None), (2, "", None, None), (3, "x" * 100_000, None, None), (None, "text", None, None), (2, "", None, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels)
    assert got.count() == 5 and set(docs.columns) - {"stats"} <= set(got.columns) and got.where("score between 0 and 1").count() == 5
    assert [r.score for r in quality.score(docs, labels.where("false")).collect()] == [0.5] * 5
    assert quality.score(docs.where("false"), labels).collect() == []


def test_compiled_rules_equal_numpy(spark, docs_of):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abAB 12!?*|\n"), 80)) for _ in range(60)]
    stats = quality.with_statistics(docs_of([(i, t, None, None) for i, t in enumerate(texts)]).drop("stats"))
    rows = stats.orderBy("doc_id").select("stats.*").toPandas()[quality.STATISTICS].to_numpy(float)
    y = (rows[:, 3] > np.median(rows[:, 3])).astype(float)
    rules, intercept = quality.fit_rules(rows, y)
    z = intercept + sum(w * quality.holds(r, rows) for r, w in rules)
    got = [r.s for r in stats.orderBy("doc_id").select(quality.compiled(rules, intercept).alias("s")).collect()]
    assert rules and np.allclose(got, 1 / (1 + np.exp(-z))) and np.mean((np.array(got) > 0.5) == y) > 0.95


def test_statistics(docs_of):
    text = "Aa bB!! *** 12\nAa bB!! *** 12\n"
    s = quality.with_statistics(docs_of([(1, text, None, None)]).drop("stats")).select("stats.*").first()
    assert (s.length, s.words, s.lines) == (30, 8, 3) and s.upper == pytest.approx(4 / 30) and s.digits == pytest.approx(4 / 30)
    assert s.distinct == 0.5 and s.distinct_lines == pytest.approx(2 / 3) and s.exclaim == pytest.approx(4 / 30) and s.symbols == pytest.approx(6 / 30)


def test_best_region_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 12)).tolist()
        best = max([0.0] + [sum(s[a:z]) for a in range(len(s)) for z in range(a + 1, len(s) + 1)])
        lo, hi = html_extract.best_region(s)
        assert sum(s[lo:hi]) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>not text</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News today</a></li></ul></nav><div class="ad">Buy this thing now, it is very cheap</div>
<article><h1>A  title &amp; more</h1><p>First <b>bold<i>er</i></b> words&nbsp;here with a <a href="x">link in it</a> and so on.<p>Second
block, unclosed <br>and broken &lt;b&gt; of some length &eacute;.<aside>An aside with words</aside><p>Third block closes the text of the page.</p>
<div class="comments"><p>I agree with the author of this</p></div></article><footer>&copy; example, all rights reserved by us</footer></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(i, f"u{i}", PAGE.replace("First", f"First{i}"), "clash") for i in range(20)] + [(50, "n", None, ""), (51, None, "", ""), (52, "m", "<p>", ""),
         (53, "o", "plain words without any tag", ""), (None, "o", "<b>a<b" + "<p>word " * 3000, ""), (54, "q", "<script>never ends <p>text", "")],
        "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert got[3].text == "A title & more\nFirst3 bolder words here with a link in it and so on.\nSecond block, unclosed and broken <b> of some length é.\nThird block closes the text of the page."
    assert got[3].n_chars == len(got[3].text) and [got[i].text for i in (50, 51, 52, 54)] == [""] * 4
    assert got[53].text == "plain words without any tag" and got[None].text.count("word") == 3000
    assert html_extract.main_text(pages.where("false")).collect() == []
    assert html_extract.main_text(pages.where("page_id = 53")).first().text == "plain words without any tag"


RICH = """<html><body><nav><ul><li>Home page</li><li>World news</li></ul></nav><table><tr><td>Old layout cell</td></tr></table><h2>Outside head</h2>
<ARTICLE><h1>Title here</h1><p>The first paragraph of the text has some words.</p><h2>Part one</h2><ul><li>apples</li><li>pears and plums</li></ul>
<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><aside><ul><li>See also this</li></ul></aside><div>A block in a div.</div>
<ol><li>last point</li></ol></ARTICLE><footer>All rights reserved</footer></body></html>"""


def test_lists_tables_and_subheadings_inside_articles(spark):
    page = RICH.replace("ARTICLE", "article")
    rows = [(i, "u", PAGE) for i in range(20)] + [(100 + i, "u", page.replace("first", f"first{i}")) for i in range(3)]
    rows += [(i, "u", "<nav><ul><li>a b c</li></ul></nav><table><tr><td>x y</td></tr></table><h2>some head</h2><article><p>words</p></article>") for i in range(200, 300)]
    rows += [(400, "u", "<nav><ul><li>Home page</li></ul></nav><p>One paragraph has some words.</p><ul><li>apples</li><li>pears and plums</li></ul>"
              "<p>Another paragraph has more words.</p>")]
    got = {r.page_id: r.text.split("\n") for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = ["Title here", "The first1 paragraph of the text has some words.", "Part one", "apples", "pears and plums", "k", "v", "1", "2",
            "A block in a div.", "last point"]
    assert got[101] == want and {"apples", "pears and plums"} <= set(got[400]) and not {"See also this", "Home page"} & set(got[400])


def test_hints_of_outer_blocks_modifiers_and_closed_svg(spark):
    inner = "<p>First words of the text.</p><p>More words of the text.</p>"
    pages = [f'<body class="has-sidebar"><article>{inner}</article></body>', f'<html class="no-js no-sidebar"><body class="search"><p></p>{inner}</body></html>',
             f'<main id="search-results">{inner}</main>', f'<article class="post share">{inner}</article>', f'<div class="page with-left-sidebar">{inner}</div>',
             f'<svg viewBox="0 0 1 1"/>{inner}', f'<p><svg class="x" /></p>{inner}<svg><text>no</text></svg>',
             f'<article>{inner}<article class="comment">I agree with this</article></article><div class="sidebar"><p>Not this</p></div>']
    rows = [(100 + i, "u", PAGE) for i in range(20)] + [(i, "u", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == ["First words of the text.\nMore words of the text."] * len(pages)
    assert html_extract.key_of("div", 'class="has-post sidebar"') == "div.sidebar" and html_extract.key_of("div", "class=no-ads") == "div"


def test_extraction_of_given_pages(given):
    for r in html_extract.main_text(given("pages")).join(given("pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


THREAD = [
    (1, 0, "a", "Shall we meet\non Monday?\n\nBring the plan."), (1, 1, "b", "On Tuesday I could."),
    (1, 2, "c", "Anna wrote:\n> Shall we  MEET\n> on monday?\nYes."), (1, 5, "d", "Ben wrote:\n> On Tuesday I could.\n>> Bring the plan.\n\nFine with me."),
    (1, 6, "a", "> Yes.\nGood."), (1, 7, "e", "> nobody said this\nOdd."), (2, 3, "x", None), (2, 4, "y", "> \n>\n"), (None, 1, "z", "lost"), (2, None, "z", "lost"),
]


@pytest.mark.parametrize("page, text", [
    ('<article><p data-id="share">kept here</p><p id="search">and here</p><h2 id="related">and a title</h2></article>', "kept here\nand here\nand a title"),
    ("<body><form action=x><div class=page><article>all in one form</article></div></form></body>", "all in one form"),
    ("<body><form>name and mail</form><article>out of the form</article><form>more</form></body>", "out of the form"),
    ('<article><a title="never closed>link</a> and the words after it</article>', "link and the words after it"),
])
def test_names_forms_and_broken_tags(page, text):
    assert html_extract.extract(page, html_extract.Weights({})) == text


@pytest.mark.parametrize("part", ["<div>", "<span>", "<a ", '<a "', "<ul><li>", "<p>w ", "<b><div>", "<!-- ", "</div>", "<form>", "<script>"])
def test_time_grows_with_the_page_and_not_with_its_depth(part):
    import time

    def took(n):
        page = "<article>" + part * n
        start = time.process_time()
        html_extract.extract(page, html_extract.Weights({}))
        html_extract.count_page(page)
        return time.process_time() - start

    took(1000)
    small, large = took(8000), took(64000)
    assert large < 40 * max(small, 0.02)  # 64 times for the square


def test_replies_and_order(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in THREAD], "conv_id long, turn long, role string, text string, depth int, position int")
    rows = chat_format.link_conversations(df).collect()
    assert len(rows) == len(THREAD)
    loose = [r for r in rows if r.conv_id is None or r.turn is None]
    assert len(loose) == 2 and all((r.reply_to, r.position, r.depth, r.n_linked) == (None, None, None, 0) for r in loose)
    got = {(r.conv_id, r.turn): r for r in rows if r not in loose}
    assert {k: r.reply_to for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 5): 1, (1, 6): 2, (1, 7): 6, (2, 3): None, (2, 4): 3}
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position) if k[0] == 1] == [0, 1, 5, 2, 6, 7]
    assert got[1, 2].text == "Yes." and got[1, 5].text == "Fine with me." and got[1, 5].n_quotes == 2 and got[1, 5].n_linked == 2
    assert got[1, 7].n_linked == 0 and got[2, 3].text == "" and got[1, 5].depth == 1 and got[1, 6].depth == 2
    assert chat_format.link_conversations(df.where("false")).collect() == []


def test_a_quoted_sentence_is_linked_after_whole_lines(spark):
    rows = [(1, 0, "a", "Take the first road. It is short."), (1, 1, "b", "Take the old road."), (1, 2, "a", "Or not."),
            (1, 3, "b", "> It is  short.\nIs it?"), (1, 4, "a", "> Take the old road.\nNo."), (1, 5, "b", "> Or not. It is short.\nHm."),
            (2, 1, "a", "It is short."), (2, 2, "b", "> short\nWhat?")]
    got = {(r.conv_id, r.turn): r.reply_to for r in chat_format.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 1, (1, 5): 2, (2, 1): None, (2, 2): 1}


def test_long_chains_of_answers(spark):
    rows = [(1, t, "r", f"> say {t - 2} now\nsay {t} now" if t > 1 else f"say {t} now") for t in range(60)] + [(1, 9, "r", "again")]
    got = chat_format.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [r.turn for r in sorted(got, key=lambda r: r.position)]
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(1, 62))
    reply = {}
    for r in got:
        assert r.reply_to is None or order.index(r.reply_to) < order.index(r.turn)
        reply[r.turn] = r.reply_to
    assert reply[59] == 57 and order[0] == 0 and set(order) == set(range(60))


def test_parsed_quotes():
    own, quotes = chat_format.parse("Hi\n> a\n> b\n>\n> c\n>> d\ntext\n > e")
    assert own == "Hi\ntext" and quotes == [(1, "a\nb"), (1, "c"), (2, "d"), (1, "e")]
    assert chat_format.parse("no quotes \n") == ("no quotes \n", []) and chat_format.parse("")[1] == []


def test_counted_words_of_levels(given):
    df = given("conversations")
    got = chat_format.link_conversations(df)
    assert got.count() == df.count()
    assert got.groupBy("conv_id").agg(F.max("position").alias("n"), F.count("*").alias("k")).where("n <> k").count() == 0
