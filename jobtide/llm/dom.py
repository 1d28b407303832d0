"""A tolerant reader of HTML: elements in page order, and the text pieces they hold.

Unclosed and stray tags are accepted; a paragraph, list item, cell or option ends where the
next one of its kind begins, and a paragraph also where a block begins. The head ends at the
first element that cannot be in it, and at the first text if it has no end tag. Text outside any element is an element of its own.
A tag cut off at the end of the page is dropped. Scripts, styles and the like are elements
without text; one without an end tag takes the rest of the page only if its content is plain
text by definition, as that of scripts is.
"""

import html as _html
import re
from dataclasses import dataclass, field

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select object".split())
PLAIN = frozenset("script style textarea title".split())
HEAD = frozenset("base head html link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = frozenset("ul ol dl table body html article div section".split())


@dataclass
class Page:
    """Elements by number, a parent before its children; number 0 is the page itself."""

    tag: list[str] = field(default_factory=lambda: [""])
    names: list[tuple[tuple[str, ...], ...]] = field(default_factory=lambda: [()])  # each as its words
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def _names(attributes: str) -> tuple[tuple[str, ...], ...]:
    found = []
    for match in ATTRIBUTE.finditer(attributes):
        for name in (match[2] or match[3] or match[4] or "").lower().split():
            found.append(tuple(WORDS.findall(name)))
    return tuple(found)


def parse(source: str) -> Page:
    page = Page()
    stack, block, at, size = [0], 0, 0, len(source)
    in_head = head_ends = False
    endless: set[str] = set()

    def add(name: str, names=()) -> None:
        page.tag.append(name)
        page.names.append(names)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))

    def text(raw: str) -> None:
        nonlocal in_head
        if in_head and not head_ends and not raw.isspace():
            in_head = not raw
        if not raw or in_head:
            return
        if len(stack) == 1 and not raw.isspace():
            if not (len(page.tag) > 1 and page.tag[-1] == "#text" and page.parent[-1] == 0):
                add("#text")
            page.pieces.append((len(page.tag) - 1, block, _html.unescape(raw)))
        else:
            page.pieces.append((stack[-1], block, _html.unescape(raw)))

    def close(names, fence=frozenset()) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if page.tag[stack[i]] in names:
                del stack[i:]
                return True
            if page.tag[stack[i]] in fence:
                return False
        return False

    while at < size:
        mark = source.find("<", at)
        if mark < 0:
            text(source[at:])
            break
        after = source[mark + 1:mark + 2]
        if after == "!" or after == "?":
            text(source[at:mark])
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", mark)
                at = size if end < 0 else end + 1
            continue
        match = TAG.match(source, mark) or LOOSE.match(source, mark)
        if not match:
            if after.isalpha() or after == "/":  # a tag without an end: the page stops in it
                text(source[at:mark])
                if source.find(">", mark) < 0:
                    break
                at = source.find(">", mark) + 1
            else:
                text(source[at:mark + 1])
                at = mark + 1
            continue
        text(source[at:mark])
        at = match.end()
        name = match[2].lower()
        if match[1]:
            if name == "head":
                in_head = False
            if name in BLOCK:
                block += 1
            close({name})
            continue
        if name == "br":
            text(" ")
            continue
        if name == "head":
            in_head = True
            head_ends = "</head" in source[at:].lower()
        elif name not in HEAD:
            in_head = False
        if name in BLOCK:
            block += 1
            if not in_head:
                close({"p"}, FENCES)
            if name in CLOSES:
                close(CLOSES[name], FENCES)
        if name in RAW:
            add(name)
            if not match[3].endswith("/"):
                end = None
                if name not in endless:
                    end = re.compile(f"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(source, at)
                if end:
                    at = end.end()
                elif name in PLAIN:
                    at = size
                else:
                    endless.add(name)
            continue
        add(name, _names(match[3]) if "=" in match[3] else ())
        if name not in VOID and not match[3].endswith("/"):
            stack.append(len(page.tag) - 1)
    return page


def joined(page: Page, kept: list[bool]) -> str:
    """The text of the kept elements: white space made single, blocks joined by a space."""
    blocks: dict[int, list[str]] = {}
    for element, block, piece in page.pieces:
        if kept[element]:
            blocks.setdefault(block, []).append(piece)
    return " ".join(" ".join("".join(parts).split()) for parts in blocks.values() if any(
        not p.isspace() and p for p in parts))
