"""Main text of web pages by tree scoring.

Blocks of text pass points to the element around them and, halved at each step, to all elements around that: one for being
a block, one for each comma and one for each hundred characters. An element's points are discounted by the share of its
text that stands in links. From the element with the most, the main container is the outermost article or main element
around it or, outside of those, the lowest one that holds all elements with text of their own of more than a short line,
however much more the best one has. All of it is kept but lists of links that stand apart from text, and of its siblings
those that score well, are long paragraphs with few links or headings before it; outside of article and main elements all
siblings with few links. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left
out before any scoring, by their element's name or the words of its class, id and role. What only its words tell against
stays if it holds half the page's text, few of it in links (a wrapper of the article), and so does a form; a word of NEVER
doesn't count behind no-, has- and the like, and is no more than one against next to a class of article text (but for comments);
a word of PERHAPS not inside an article or main element unless most of the text is links. Work and memory grow with the page,
not with how deep its elements stand in each other.

Edge cases: null or empty html, or html without text outside those parts, gives an empty text; unclosed elements end
where their parent does or where the next block of their kind begins; a stray end tag is ignored; a "<" that starts no
tag is text; repeated rows are extracted each; other columns but page_id and url are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from geoframe.llm.text import small_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "math", "mi", "mn", "mo", "mrow", "mtext", "mfrac", "msub", "msup", "msubsup", "msqrt", "object"}
LEFT_OUT = {"nav", "footer", "aside", "button", "select", "option", "fieldset", "dialog", "menu", "head"} | RAW
#: Elements that stand in a head; any other ends it.
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
#: Words of class, id and role of what goes whatever it holds; of what goes unless it holds half the text; of what may be part of an article.
NEVER = {"ad", "ads", "advert", "advertisement", "adverts", "comment", "comments", "consent", "cookie", "cookies", "disqus", "newsletter", "notice", "promo", "promoted", "replies", "reply", "sponsor", "sponsored"}
COMMENTS = {"comment", "comments", "disqus", "replies", "reply"}
SELDOM = {"form", "banner", "breadcrumb", "breadcrumbs", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "pager", "pagination", "popup", "share", "sharing", "sidebar", "signup", "social", "subscribe", "toolbar", "widget", "contentinfo", "complementary", "search"}
PERHAPS = {"related", "warning"}
#: Classes of an article's own text.
TEXT = {"post", "article", "entry", "content", "story", "body", "page", "main"}
#: Before or behind a word in one name, these make it say something about what is around.
ABOUT = {"no", "non", "not", "has", "with", "without", "hide", "hidden", "enabled", "disabled", "free", "open", "closed"}
#: An element of the key's kind ends an open one of the value's kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Points of an element's own blocks from which it holds text: more than a short line gives.
LEAST = 1.5


class Element:
    """An element of the page. Sums are first of its own blocks alone; summed() adds those of all in it."""

    __slots__ = ("name", "parent", "points", "own", "chars", "linked", "out", "words", "main", "first", "holds", "inline_open", "never")

    def __init__(self, name: str, parent: Element | None, out: bool, words: set[str] = frozenset()):
        self.name, self.parent, self.out, self.words = name, parent, out, words
        self.main = name in ("article", "main") or bool(parent and parent.main)
        self.points, self.own, self.chars, self.linked, self.first, self.holds = 0.0, 0.0, 0, 0, -1, False
        #: Names of the inline elements that are open in this block.
        self.inline_open: Counter[str] = Counter()
        self.never = bool(parent and parent.never) or bool(words & NEVER)

    def score(self) -> float:
        return (self.points + (5 if self.name in ("article", "main") else 0)) * (1 - self.linked / max(self.chars, 1))

    def has_text(self) -> bool:
        return self.own * (1 - self.linked / max(self.chars, 1)) >= LEAST

    def around(self) -> Element:
        """The element that gets the points of this block."""
        return self.parent if self.name in PARAGRAPHS and self.parent is not None else self

    def lineage(self) -> list[Element]:
        """The element and all around it, innermost first."""
        found, e = [], self
        while e is not None:
            found.append(e)
            e = e.parent
        return found


def words_against(name: str, attributes: str) -> set[str]:
    """Words of the element's class, id and role that tell against it; a form has its name as one.

    Next to a word for an article's own text, those of adverts and notices only say what it may hold, so they count as seldom.
    """
    own = {"form"} if name == "form" else set()
    if name in ("html", "body", "article", "main") or "=" not in attributes:
        return own
    names = [WORD.findall(n) for m in NAMES.finditer(attributes) for n in m[1].lower().strip("\"'").split()]
    found = own | {w for ws in names if not ABOUT.intersection(ws) for w in ws}
    if any(len(ws) == 1 and ws[0] in TEXT for ws in names) and found & NEVER and not found & COMMENTS:
        found = found - NEVER | {"form"}
    return found & (NEVER | SELDOM | PERHAPS)


def wanted_only(elements: list[Element], found: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """The blocks, without those in elements that their words and their share of text and links tell against."""
    chars: dict[Element, list[int]] = {e: [0, 0] for e in elements}
    for block, text, linked in found:
        sums = chars[block]
        sums[0], sums[1] = sums[0] + len(text), sums[1] + linked
    # Elements are in the order in which they begin: from the last to the first, all in an element come before it.
    for e in reversed(elements):
        if e.parent is not None:
            sums, own = chars[e.parent], chars[e]
            sums[0], sums[1] = sums[0] + own[0], sums[1] + own[1]
    total = sum(len(text) for block, text, _ in found if not block.never)

    def goes(e: Element) -> bool:
        if not e.words:
            return False
        n, linked = chars[e]
        if e.words & NEVER or 2 * linked >= n:
            return True
        return 2 * n < total if e.words & SELDOM or not (e.parent and e.parent.main) else False

    gone: dict[Element | None, bool] = {None: False}
    for e in elements:
        gone[e] = gone[e.parent] or goes(e)
    return [b for b in found if not gone[b[0]]]


def blocks_of(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """All elements in the order in which they begin, and the blocks of text that may be wanted, in page order: innermost block
    element, text, characters in links. What is done for a tag doesn't grow with the number of open elements."""
    top = Element("", None, False)
    elements, stack, found, parts, linked = [top], [top], [], [], []
    #: Places in the stack of the open blocks, and how many elements of each name are open.
    places, open_ = [0], Counter()
    at, block = 0, top

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((block, text, min(len(text), sum(map(len, linked)))))
        linked.clear()

    def add(text: str) -> None:
        if text and not block.out and not stack[-1].out:
            parts.append(text)
            if open_["a"]:
                linked.append(" ".join(unescape(text).split()))

    def push(e: Element) -> None:
        elements.append(e)
        open_[e.name] += 1
        if e.name in INLINE:
            stack[places[-1]].inline_open[e.name] += 1
        else:
            places.append(len(stack))
        stack.append(e)

    def cut(depth: int) -> None:
        """Close all elements from that place in the stack on."""
        while len(stack) > depth:
            e = stack.pop()
            open_[e.name] -= 1
            if places[-1] == len(stack):
                places.pop()
            else:
                stack[places[-1]].inline_open[e.name] -= 1

    def close(name: str) -> None:
        if name in INLINE:
            # An inline element's end doesn't reach beyond the block it is in.
            if not stack[places[-1]].inline_open[name]:
                return
        elif not open_[name]:
            return
        depth = len(stack) - 1
        while stack[depth].name != name:
            depth -= 1
        cut(depth)

    def close_before(name: str) -> None:
        """Close what an opening block of the name ends."""
        ends = CLOSES.get(name, set()) | {"p"}
        if not any(open_[n] for n in ends):
            return
        for place in reversed(places[1:]) if name in CLOSES else places[-1:]:
            other = stack[place].name
            if other in ends:
                cut(place)
                return
            if other not in PARAGRAPHS:
                return

    while tag := TAG.search(html, at):
        add(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in RAW and not closing:
            # Of these only svg can end itself; browsers take no notice of the slash in others.
            if not (name == "svg" and attributes.rstrip().endswith("/")):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                add(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if closing:
            close(name)
        else:
            if name not in IN_HEAD and stack[-1].name == "head":
                cut(len(stack) - 1)
            if not inline:
                close_before(name)
            out = stack[-1].out or name in LEFT_OUT or (name == "header" and not stack[-1].main)
            push(Element(name, stack[-1], out, words_against(name, attributes)))
        block = stack[places[-1]]
    add(html[at:])
    flush()
    return elements, found


def summed(elements: list[Element], found: list[tuple[Element, str, int]]) -> list[Element]:
    """Give all elements their points, characters and first block; return those that get points, inner ones before outer ones."""
    for i, (block, text, linked) in enumerate(found):
        around = block.around()
        points = (1 + text.count(",") + len(text) / 100) * (0.2 if block.name in HEADINGS else 1)
        around.own += points
        around.points += points
        around.holds = True
        block.chars, block.linked = block.chars + len(text), block.linked + linked
        block.first = i if block.first < 0 else block.first
    for e in reversed(elements):
        up = e.parent
        if up is not None:
            up.points, up.holds = up.points + e.points / 2, up.holds or e.holds
            up.chars, up.linked = up.chars + e.chars, up.linked + e.linked
            if e.first >= 0:
                up.first = e.first if up.first < 0 else min(up.first, e.first)
    return [e for e in reversed(elements) if e.holds]


def main_text(html: str | None) -> str:
    """The wanted blocks, joined by a blank line."""
    elements, found = blocks_of(html or "")
    found = wanted_only(elements, found)
    if not found:
        return ""
    holders = summed(elements, found)
    best = max(holders, key=lambda e: (e.score(), -e.first))
    while best.name in PARAGRAPHS and best.parent is not None:
        best = best.parent
    line = best.lineage()
    meets: dict[Element, int] = {e: n for n, e in enumerate(line)}
    for e in elements:
        if e not in meets:
            meets[e] = meets[e.parent]
    top = max((n for n, e in enumerate(line) if e.main), default=0)
    # Beside an article or main element, only text in another one counts.
    top = max([top, *(meets[e] for e in holders if e.has_text() and (e.main or not best.main))])
    main = line[top]
    # For each element, the first of itself and those around it that is the best one, the main one or a sibling of that.
    inside: dict[Element | None, Element | None] = {None: None}
    for e in elements:
        inside[e] = e if e is best or e is main or e.parent is main.parent else inside[e.parent]
    out = []
    for block, text, _ in found:
        around, at = block.around(), inside[block]
        if at is best:
            wanted = True
        elif at is main:
            wanted = around.linked < 0.5 * around.chars or bool(around.parent and around.parent.has_text())
        elif at is not None:
            few_links = at.linked < 0.25 * at.chars
            wanted = (few_links and not main.main) or (at.holds and at.score() >= 3) or (at.name == "p" and few_links and at.chars > 80) or (at.name in HEADINGS and few_links and at.first < main.first)
        else:
            wanted = False
        if wanted:
            out.append(text)
    return "\n\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""

    def rows(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
