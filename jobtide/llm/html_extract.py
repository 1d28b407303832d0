"""Main-text extraction by boosted trees over DOM elements, decoded down the tree.

Every element becomes a row: its tag, the words of its class, id and role and of those above
it, its depth, place among its siblings and in the page, headings in and around it, and the length,
link share, paragraph share and tag share of the text in its subtree and in those around it. Trees boosted on these give each element's odds of being main text.

Decoding picks one state per element, the best in sum over the page: ``around`` (not main
text, but may hold it), ``text`` and ``left out``. Below ``text`` only ``text`` and ``left
out`` may follow, and below ``left out`` nothing else, so no element is kept inside one that
is thrown away, and none is main text twice over.

The model is fitted on labelled pages: up to ``sample_pages`` pages of the table, labelled
by their own structural elements where they have any, and ``made_pages`` pages made from
their words with known parts, in other tags and under other class names, and some without any
holder of the main text. Every page is used twice, once with its names and part tags made neutral,
so that the trees must tell parts by structure too. Both bounds are arguments; all pages are
extracted with it.

Defined results: a null or empty page gives an empty text. Repeated pages get equal texts;
an empty table gives an empty table. Result columns replace columns of the same names.
"""

import random
from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import boosting, dom

# Words of class names and ids, by what they usually mark.
GOOD_WORDS = frozenset("article body content entry main post story text".split())
BAD_WORDS = {
    "menu": frozenset("breadcrumb breadcrumbs menu nav navbar navigation pagination skip tabs toc".split()),
    "edge": frozenset("footer foot copyright legal header masthead topbar banner logo".split()),
    "side": frozenset("aside sidebar side widget related recommended rail teaser tags".split()),
    "ad": frozenset("ad ads advert advertisement adverts promo promotion sponsor sponsored".split()),
    "notice": frozenset("alert consent cookie cookies gdpr modal notice overlay popup warning".split()),
    "form": frozenset("form login newsletter register search signup subscribe".split()),
    "comment": frozenset("comment comments disqus replies reply respond".split()),
    "share": frozenset("share sharing social".split()),
}
GOOD_TAGS = frozenset(["article", "main"])
BAD_TAGS = {"menu": {"nav", "menu"}, "edge": {"header", "footer"}, "side": {"aside"},
            "form": {"form", "button", "label", "fieldset", "input"}}
TAG_GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"a"},
              {"div", "section"}, {"td", "th", "tr", "table"}, {"blockquote", "pre", "figure", "figcaption"},
              {"b", "i", "em", "strong", "span", "u", "small", "code", "sub", "sup"}, {"body", "html", ""}, {"#text"}]
_KINDS = list(BAD_WORDS)

AROUND, TEXT, LEFT_OUT = range(3)


_ANY_BAD = frozenset().union(*BAD_WORDS.values())
# Tags that say which part of a page an element is.
PART_TAGS = frozenset("article aside footer header main menu nav section".split())


def _marks(tag: str, names: tuple[tuple[str, ...], ...]) -> tuple[bool, list[bool]]:
    """Whether tag or names speak for main text, and for which kinds of other parts.

    A name speaks for another part if such words are at least half of it.
    """
    used = {word for name in names for word in name}
    against = {word for name in names if 2 * sum(w in _ANY_BAD for w in name) >= len(name) for word in name}
    bad = [bool(against & BAD_WORDS[k]) or tag in BAD_TAGS.get(k, ()) for k in _KINDS]
    return tag in GOOD_TAGS or (bool(used & GOOD_WORDS) and not any(bad)), bad


def masked(page: dom.Page) -> dom.Page:
    """The page with its names and the tags of its parts made neutral: only structure is left."""
    tags = ["div" if t in PART_TAGS else t for t in page.tag]
    return replace(page, tag=tags, names=[()] * len(tags))


def _structure(page: dom.Page, chars: list[int], linked: list[int]) -> list[np.ndarray]:
    """Numbers of shape and place only: no names."""
    n = len(page.tag)
    held = np.array(chars, float)
    ups = np.maximum(0, np.array(page.parent))
    whole = max(1.0, held[0])
    # text before each element, in page order
    begin, told = np.full(n, -1.0), 0.0
    filled = np.zeros(n)
    for element, _, piece in page.pieces:
        if begin[element] < 0:
            begin[element] = told
        size = len(piece.strip())
        told += size
        filled[element] += size > 0
    in_p, headed = np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if begin[i] >= 0 and (begin[up] < 0 or begin[i] < begin[up]):
            begin[up] = begin[i]
        filled[up] += filled[i]
        in_p[up] += held[i] if page.tag[i] == "p" else in_p[i]
        headed[up] = max(headed[up], headed[i], page.tag[i] == "h1")
    begin = np.where(begin < 0, 0, begin)
    share = held / whole
    # down the tree: the least part that has a heading, and the part below the body
    heading, top = np.ones(n), np.zeros(n, np.int64)
    biggest = np.zeros(n)
    np.maximum.at(biggest, ups[1:], held[1:])
    for i in range(1, n):
        up = page.parent[i]
        heading[i] = share[i] if headed[i] else heading[up]
        outer = page.tag[i] in ("", "html", "body")
        top[i] = 0 if outer else (top[up] or i)
    first = next((begin[i] for i in range(n) if page.tag[i] == "h1"), 0.0)
    some = np.maximum(1, held)
    density = np.array(linked) / some
    return [
        begin / whole, (begin + held) / whole, (begin - first) / whole, held / np.maximum(1, filled),
        in_p / some, headed, heading, density[ups], density[top], share[top], share[ups],
        held / np.maximum(1, biggest[ups]), (in_p / some)[ups], (in_p / some)[top], headed[top],
        (begin / whole)[top], np.log1p(held)[ups]]


def features(page: dom.Page) -> np.ndarray:
    """A row of numbers for each element."""
    n = len(page.tag)
    own, links, below, stops = [0] * n, [0] * n, [0] * n, [0] * n
    for element, _, piece in page.pieces:
        own[element] += len(piece.strip())
        stops[element] += piece.count(".") + piece.count(",")
    chars, linked, points = list(own), links, stops
    for i in range(n):
        if page.tag[i] == "a":
            linked[i] = -1
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if linked[i] == -1:
            linked[i] = chars[i]
        chars[up] += chars[i]
        points[up] += points[i]
        below[up] += below[i] + 1
        if linked[up] != -1:
            linked[up] += linked[i]
    order, families = [0] * n, [0] * n
    for i in range(1, n):
        order[i] = families[page.parent[i]]
        families[page.parent[i]] += 1
    near_good, near_bad = [0] * n, [0] * n
    known = [_static(page.tag[i], page.names[i]) for i in range(n)]
    for i in range(n):
        up = max(0, page.parent[i])
        _, good, bad = known[i]
        near_good[i] = 1 if good else (near_good[up] + 1 if near_good[up] else 0)
        near_bad[i] = 1 if bad else (near_bad[up] + 1 if near_bad[up] else 0)
    held = np.array(chars, float)
    ups = np.maximum(0, np.array(page.parent))
    good_at, bad_at = np.array(near_good), np.array(near_bad)
    some = np.maximum(1, held)
    return np.column_stack([
        np.array([k[0] for k in known]), good_at, bad_at,
        page.depth, order, np.array(families)[ups], families,
        np.log1p(own), np.log1p(held), held / max(1, chars[0]), held / some[ups],
        np.array(linked) / some, np.array(below) / some, np.array(points) / some,
        *_structure(page, chars, linked)])


@lru_cache(maxsize=50_000)  # names are the pages' own: keep it bounded
def _static(tag: str, names: tuple[tuple[str, ...], ...]) -> tuple[list[float], bool, bool]:
    good, bad = _marks(tag, names)
    row = [float(tag in group) for group in TAG_GROUPS] + [float(b) for b in bad] + [float(good)]
    return row, good, any(bad)


def decode(page: dom.Page, odds: np.ndarray) -> list[bool]:
    """Which elements are main text: the best states that do not contradict each other."""
    n = len(page.tag)
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    held = [0.0] * n
    for element, _, piece in page.pieces:
        held[element] += len(piece)
    weight = 0.1 + np.log1p(held)  # a word counts more than an empty shell
    best = np.stack([no * weight, yes * weight, no * weight], 1).tolist()
    for i in range(n - 1, 0, -1):
        around, text, out = best[i]
        up = best[page.parent[i]]
        up[AROUND] += max(around, text, out)
        up[TEXT] += max(text, out)
        up[LEFT_OUT] += out
    state = [AROUND] * n
    for i in range(1, n):
        around, text, out = best[i]
        above = state[page.parent[i]]
        if above == LEFT_OUT:
            state[i] = LEFT_OUT
        elif above == TEXT:
            state[i] = TEXT if text >= out else LEFT_OUT
        else:
            state[i] = AROUND if around > text and around >= out else TEXT if text >= out else LEFT_OUT
    return [s == TEXT for s in state]


def structural_labels(page: dom.Page) -> list[bool] | None:
    """Labels from a page's own article or main element; none if it has none."""
    if not GOOD_TAGS & set(page.tag):
        return None
    label = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        good, bad = _marks(page.tag[i], page.names[i])
        label[i] = not any(bad) and (page.tag[i] in GOOD_TAGS or label[page.parent[i]])
    return label


_MAIN = [("article", ""), ("main", ""), ("div", "post-content"), ("div", "article-body"), ("div", "entry"),
         ("section", "story"), ("div", "content"), ("div", "main-text"), ("article", "post"), ("div", "")]
_PARTS = [("nav", "", "menu"), ("div", "menu", "menu"), ("ul", "navbar", "menu"), ("div", "breadcrumbs", "menu"),
          ("header", "", "short"), ("div", "header", "short"), ("div", "masthead", "menu"),
          ("footer", "", "short"), ("div", "footer", "menu"), ("div", "copyright", "short"),
          ("aside", "", "menu"), ("div", "sidebar", "long"), ("div", "widget", "short"), ("div", "related", "menu"),
          ("div", "ad", "short"), ("div", "ads", "short"), ("section", "sponsored", "long"), ("div", "promo", "short"),
          ("div", "cookie-notice", "short"), ("div", "notice", "short"), ("div", "alert", "short"),
          ("div", "popup", "long"), ("form", "", "form"), ("div", "newsletter", "form"), ("div", "login", "form"),
          ("section", "comments", "long"), ("div", "comment-list", "long"), ("div", "replies", "long"),
          ("div", "share", "menu"), ("div", "social", "menu")]


def made_page(draw: random.Random, words: list[str]) -> tuple[str, str]:
    """A page with known parts, and its main text."""
    def some(low, high):
        return " ".join(draw.choice(words) for _ in range(draw.randrange(low, high)))

    def part(tag, name, kind):
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(draw.randrange(2, 9))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{some(1, 4)}</label><input name=q><button>{some(1, 2)}</button>"
        elif kind == "long":
            inner = "".join(f"<p>{some(5, 60)}.</p>" for _ in range(draw.randrange(1, 5)))
        else:
            inner = draw.choice([f"{some(2, 18)}.", f"<p>{some(2, 18)}.</p>", f'<a href="/y">{some(2, 9)}</a>'])
        mark = draw.choice([f' class="{name}"', f' id="{name}"']) if name else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    texts = []
    body = []
    title = some(2, 9)
    body.append(f"<h1>{title}</h1>")
    texts.append(title)
    for _ in range(draw.randrange(1, 14)):
        line = f"{some(3, 80)}."
        form = draw.randrange(12)
        if form == 0:
            items = [some(1, 12) for _ in range(draw.randrange(1, 5))]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            texts += items
        elif form == 1:
            body.append(f"<h2>{line}</h2>")
            texts.append(line)
        elif form == 2:
            body.append(f"<p><b>{line}<br>")
            texts.append(line)
        elif form == 3:
            other = some(1, 4)
            body.append(f'<blockquote>{line} <a href="/z">{other}</a></blockquote>')
            texts.append(f"{line} {other}")
        else:
            body.append(f"<p>{line}</p>")
            texts.append(line)
        if draw.random() < 0.06:
            body.append(part(*draw.choice(_PARTS)))
    tag, name = draw.choice(_MAIN)
    mark = f' class="{name}"' if name else ""
    main = f"<{tag}{mark}>{''.join(body)}</{tag}>"
    before = "".join(part(*draw.choice(_PARTS)) for _ in range(draw.randrange(1, 4)))
    after = "".join(part(*draw.choice(_PARTS)) for _ in range(draw.randrange(1, 4)))
    if draw.random() < 0.3:
        before, after = f'<div class="page">{before}', f"{after}</div>"
    return f"<html><head><title>{title}</title></head><body>{before}{main}{after}</body></html>", " ".join(texts)


def _made_labels(page: dom.Page) -> list[bool]:
    """Of made pages: the part after the first heading's parent, less the marked parts."""
    heading = page.tag.index("h1", 1)
    holder = page.parent[heading]
    label = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        _, bad = _marks(page.tag[i], page.names[i])
        label[i] = i == holder or (label[page.parent[i]] and not any(bad))
    return label


def _plain_page(draw: random.Random, words: list[str]) -> tuple[dom.Page, list[bool]]:
    """A page without a holder of its main text: paragraphs and bare text at the root or in the body,
    sometimes beside one other part; and which elements are main text."""
    def some():
        many = draw.randrange(1, 6) if draw.random() < 0.4 else draw.randrange(5, 120)
        return " ".join(draw.choice(words) for _ in range(many)) + draw.choice([".", ".", ""])

    form = draw.choice(["<p>{}</p>", "<p>{}</p>", "{}<br><br>", "{} ", "<div>{}</div>"])
    told = "".join(draw.choice([form, "<p>{}</p>"]).format(some()) for _ in range(draw.randrange(1, 12)))
    told = draw.choice(["", f"<h1>{draw.choice(words)}</h1>"]) + told
    tag, name, _ = draw.choice([p for p in _PARTS if p[2] == "menu"])
    links = "".join(f'<li><a href="/x">{draw.choice(words)}</a></li>' for _ in range(draw.randrange(2, 9)))
    menu = f'<{tag} class="{name}"><ul>{links}</ul></{tag}>' if draw.random() < 0.4 else ""
    before, after = (menu, "") if draw.random() < 0.5 else ("", menu)
    whole = before + told + after
    page = dom.parse(draw.choice([whole, f"<html><body>{whole}</body></html>",
                                  f"<head><title>{draw.choice(words)}</title>{whole}"]))
    label, other = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        outer = page.tag[i] in ("html", "body", "head", "title")
        other[i] = other[page.parent[i]] or any(_marks(page.tag[i], page.names[i])[1])
        label[i] = not outer and not other[i]
    return page, label


def fit_model(sources: list[str], made_pages: int = 300, seed: int = 11) -> boosting.Forest:
    """The model of a bounded list of pages and of pages made from their words."""
    draw = random.Random(seed)
    rows, labels = [], []
    words: list[str] = []
    for source in sources:
        page = dom.parse(source or "")
        if len(words) < 20_000:
            words += [w for _, _, piece in page.pieces for w in piece.split()][:400]
        found = structural_labels(page)
        if found is not None:
            rows += [features(page), features(masked(page))]
            labels += found + found
    words = words or "lorem ipsum dolor sit amet a et in ut".split()
    for _ in range(made_pages):
        source, _ = made_page(draw, words)
        if "<h1" not in source:
            continue
        page = dom.parse(source)
        found = _made_labels(page)
        rows += [features(page), features(masked(page))]
        labels += found + found
    for _ in range(made_pages // 3):
        page, found = _plain_page(draw, words)
        rows += [features(page), features(masked(page))]
        labels += found + found
    table = np.concatenate(rows)
    return boosting.fit(table, np.array(labels, float), np.ones(len(table)))


def main_text(page: dom.Page, odds: np.ndarray) -> str:
    """The text of the elements decoded as main text.

    Where there is none, all that lies in no part marked as another one is main text: a page
    is not thrown away because it looks like no page the model was fitted on.
    """
    found = dom.joined(page, decode(page, odds))
    if found or not page.pieces:
        return found
    kept = [True] * len(page.tag)
    for i in range(1, len(page.tag)):
        kept[i] = kept[page.parent[i]] and not any(_marks(page.tag[i], page.names[i])[1])
    return dom.joined(page, kept)


def extract(source: str, model: boosting.Forest) -> str:
    page = dom.parse(source)
    return main_text(page, model.log_odds(features(page)))


def _extract(batches: Iterator[pa.RecordBatch], html: str, model: boosting.Forest):
    for batch in batches:
        names = [n for n in batch.schema.names if n != html]
        for begin in range(0, batch.num_rows, 64):  # pages whose elements are scored together
            part = batch.slice(begin, 64)
            pages = [dom.parse(s.as_py() or "") for s in part.column(html)]
            odds = model.log_odds(np.concatenate([features(p) for p in pages]))
            ends = np.cumsum([len(p.tag) for p in pages])
            found = [main_text(p, odds[end - len(p.tag):end])
                     for p, end in zip(pages, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], [*names, "text", "n_chars"])


def extract_text(
    pages: DataFrame, html: str = "html", sample_pages: int = 200, made_pages: int = 300,
) -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars``."""
    # the pages of least hash: the same ones however the table is laid out, equal ones once.
    # Tasks send hashes to the driver; only the chosen pages go there whole
    hashed = pages.select(F.col(html).alias("h")).filter(F.col("h").isNotNull()).withColumn("at", F.xxhash64("h"))
    least = hashed.select("at").distinct().orderBy("at").limit(sample_pages).collect()
    some = (hashed.filter(F.col("at") <= (least[-1].at if least else None))
            .dropDuplicates(["at"]).orderBy("at").collect())
    model = pages.sparkSession.sparkContext.broadcast(fit_model([r.h for r in some], made_pages))
    own = pages.drop("n_chars", *(["text"] if html != "text" else []))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != html]
    return own.mapInArrow(lambda batches: _extract(batches, html, model.value),
                          ", ".join([*kept, "text string", "n_chars long"]))
