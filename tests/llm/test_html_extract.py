import html
import random
import re

import numpy as np
import pytest

from jobtide.llm import boosting, dom, html_extract
from jobtide.llm.html_extract import LEFT_OUT, decode, extract, extract_text, fit_model, made_page

WORDS = "alpha beta gamma delta epsilon the of and in to river stone cloud".split()


def article(source):
    """The text of a page's article by plain string work."""
    begin = source.find("<article>")
    end = source.find("</article>", begin)
    body = source[begin:end] if end >= 0 else re.sub(r"<[^>]*$", "", source[begin:])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split())
              for b in re.split(r"</?(?:article|h1|p)>", body)]
    return " ".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model():
    return fit_model([])


def test_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r.page_id: article(r.html) for r in pages.collect()}
    rows = extract_text(pages).collect()
    assert {r.page_id: r.text for r in rows} == wanted
    assert all(r.n_chars == len(r.text) for r in rows)


def test_held_out_made_pages(model):
    draw = random.Random(99)
    right = 0
    for _ in range(200):
        source, text = made_page(draw, WORDS)
        right += extract(source, model) == " ".join(text.split())
    assert right >= 195


def test_reading_of_broken_markup():
    page = dom.parse('<P>a<b>b</B> c<p>d<!-- x <p> --><br>e &amp; f&lt;g &#233; &am<div>h</span> i < j</div>'
                     '<script>if (a<b) "</p>"</script>k<ul><li>l<li>m</ul><img src="x>y">n<a href="cut')
    assert dom.joined(page, [True] * len(page.tag)) == "ab c d e & f<g é &am h i < j k l m n"
    assert dom.joined(dom.parse(""), [True]) == ""
    assert dom.joined(dom.parse("<a 'x>y<b \"z>w"), [True] * 9) != ""


def test_head_and_raw_elements_have_no_text():
    page = dom.parse("<html><head><title>t</title><style>s</style>x</head><body>y<textarea>z</textarea><style/>w")
    assert dom.joined(page, [True] * len(page.tag)) == "yw"


def test_states_never_contradict(model):
    draw = np.random.default_rng(3)
    maker = random.Random(3)
    for _ in range(50):
        page = dom.parse(made_page(maker, WORDS)[0])
        kept = decode(page, draw.normal(0, 3, len(page.tag)))
        for i in range(1, len(page.tag)):
            if kept[i]:
                above, left = page.parent[i], True
                while above > 0:  # once text is left, nothing above is text again
                    assert left or not kept[above]
                    left = kept[above]
                    above = page.parent[above]
    assert LEFT_OUT == 2


def test_corner_cases(spark, model):
    rows = [(1, None, "u"), (2, "", "u"), (3, "plain words only", "u"), (4, "<" * 5000, "u"), (5, "<a " * 3000, "u"),
            (6, "<div>" * 3000 + "deep", "u"), (7, "<article><p>" + "w " * 300_000 + "</article>", "u"),
            (7, "<article><p>x</p></article>", "u"), (7, "<article><p>x</p></article>", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "text", "n_chars"]
    found = sorted((r.page_id, r.text[:4], r.n_chars) for r in out.collect())
    assert [f for f in found if f[0] == 7] == [(7, "w w ", 599_999), (7, "x", 1), (7, "x", 1)] or (
        [f[2] for f in found if f[0] == 7] == [1, 1, 599_999])
    assert found[0] == (1, "", 0) and found[1] == (2, "", 0) and len(found) == len(rows)
    assert extract_text(pages.filter("false")).count() == 0


def test_boosting_learns_and_is_reproducible():
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(3000, 5))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    one, two = (boosting.fit(rows[:2000], labels[:2000], np.ones(2000)) for _ in range(2))
    odds = one.log_odds(rows[2000:])
    assert ((odds > 0) == (labels[2000:] > 0.5)).mean() > 0.95
    assert (odds == two.log_odds(rows[2000:])).all()
    assert len(one.log_odds(rows[:0])) == 0


def test_structure_alone_tells_the_parts(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    learned = fit_model(pages[:100])
    right = 0
    for source in pages[100:]:
        page = html_extract.masked(dom.parse(source))
        assert not any(page.names) and "article" not in page.tag and "nav" not in page.tag
        right += html_extract.main_text(page, learned.log_odds(html_extract.features(page))) == article(source)
    assert right >= 0.9 * len(pages[100:])


def test_structure_alone_on_held_out_made_pages(model):
    draw = random.Random(98)
    right = 0
    for _ in range(100):
        source, text = made_page(draw, WORDS)
        page = html_extract.masked(dom.parse(source))
        right += html_extract.main_text(page, model.log_odds(html_extract.features(page))) == " ".join(text.split())
    assert right >= 90


SOME = " ".join(f"{w}{i}" for i in range(20) for w in ("river", "stone", "cloud"))
MENU = '<div class="menu"><ul><li><a href="/x">one</a></li><li><a href="/y">two</a></li></ul></div>'


@pytest.mark.parametrize("source, text", [
    (SOME, SOME),
    ("two words", "two words"),
    (f"<h1>Title</h1> {SOME}", f"Title {SOME}"),
    (f"<p>{SOME}</p> between {SOME} <p>last</p>", f"{SOME} between {SOME} last"),
    (f"<html><head><title>t</title><p>{SOME}</p><p>{SOME}</p>", f"{SOME} {SOME}"),
    (f"<html><head><title>t</title>{SOME}", SOME),
    (f'<div class="comment-on-politics"><article><h1>T</h1><p>{SOME}</p></article></div>', f"T {SOME}"),
    (f"<body>{MENU}<p>{SOME}</p></body>", SOME),
    *[(f"<body><article><p>{SOME}</p><{raw}><p>{SOME}</p></article></body>", f"{SOME} {SOME}")
      for raw in ("svg", "object", "noscript", "template", "select")],
    ('<nav><a href="/x">home</a></nav><footer>foot</footer>', "")])
def test_no_page_is_thrown_away(model, source, text):
    assert extract(source, model) == text


def test_many_unclosed_elements_take_linear_time():
    page = dom.parse("<p>x<svg>" * 100_000)
    assert len(page.tag) == 200_001


def test_words_of_attributes_are_bounded():
    assert html_extract._static.cache_info().maxsize == 50_000
