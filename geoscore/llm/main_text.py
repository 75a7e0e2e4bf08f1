"""Main text of web pages by scoring the tree of a page.

Every block of text gives points to the containers above it, more for its length and its commas, less the farther up.
A container's points are discounted by the share of its characters that are links. The best container and the siblings
that look like it hold the article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from geoscore.llm.common import by_batch

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
PARTS = re.compile(r"[a-z0-9]+")
FARTHEST = 1 << 40  # share of a block's points, one in so many, below which no ancestor gets any
PROSE = 0.25  # share of link characters under which a part reads as prose

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption button object template".split())
# What an opening tag closes when it is still open, and the tags that such a search does not leave.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset(
    "nav footer aside form search dialog menu button select datalist input object applet embed canvas audio video map "
    "head".split()
)
# Words of a class, id or role that name a part which is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar "
    "sidenav aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist disqus "
    "reply replies respond share sharing social related recommended recommendations widget login signup search "
    "pagination pager toolbar complementary contentinfo".split()
)
# What follows such a word in the name of a part: "cookie-banner" is no article, "ad-hoc" may be.
KINDS = frozenset(
    "area bar block body bottom box button buttons container content form frame group header icons inner item items label left "
    "link links list menu message outer panel right row section slot tab text title top unit widget wrap wrapper".split()
)
PARAGRAPH = frozenset("p pre li td th dd dt blockquote figcaption caption summary".split()) | HEADING


def _names_other(name: str, in_article: bool) -> bool:
    """A class, id or role says that a part is not the article: by itself, by its last word, or by its first and a kind."""
    words = PARTS.findall(name)
    if not words:
        return False
    if words == ["header"] or words[-1] == "header" and words[0] in ("site", "page"):
        return not in_article
    return words[-1] in NOT_ARTICLE or (words[0] in NOT_ARTICLE and words[-1] in KINDS)


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        named = tag == "article" and "comment" in attributes.lower()
        if not named:
            return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id", "role"):
            if any(_names_other(x, in_article) for x in value.split()):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Page:
    """The containers of a page and its blocks of text, without what is never part of an article."""

    def __init__(self, html: str):
        self.tags, self.parents = ["#page"], [0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self.stack, self.dropped, self.articles = [0], [False], [0]
        # At which depths of the stack each tag, and any block, is open: so no search walks down a deep stack.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks = [0]
        self.text: list[str] = []
        self.link_chars, self.links = 0, 0
        self._read(html)
        self._end_block()

    def _end_block(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                owner = self.stack[self.open_blocks[-1]]
                self.blocks.append((owner, text, min(self.link_chars, len(text))))
        self.text, self.link_chars = [], 0

    def _add(self, text: str) -> None:
        if text and not self.dropped[-1]:
            self.text.append(text)
            if self.links:
                self.link_chars += len(text.strip())

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((at[-1] for at in map(self.open.get, tags) if at), default=0)

    def _pop_to(self, depth: int) -> None:
        if self.open_blocks[-1] >= depth:
            self._end_block()
        for i in self.stack[depth:]:
            self.open[self.tags[i]].pop()
            self.links -= self.tags[i] == "a"
        while self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        del self.stack[depth:], self.dropped[depth:], self.articles[depth:]

    def _close_open(self, tags: Iterable[str], border: Iterable[str]) -> None:
        depth = self._deepest(tags)
        if depth and depth >= self._deepest(border):
            self._pop_to(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._end_block()
            self._close_open(("p",), SCOPE)
        if tag in CLOSES:
            self._close_open(*CLOSES[tag])
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            return
        inside = self.articles[-1]
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.open[tag].append(len(self.stack))
        if tag in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        self.dropped.append(self.dropped[-1] or _unwanted(tag, attributes, inside > 0))
        self.articles.append(inside + (tag in ("article", "main")))
        self.links += tag == "a"

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag == "p" and not self.open["p"]:
            self._end_block()
        depth = self._deepest(HEADING if tag in HEADING else (tag,))
        # A closing tag of running text does not end the block around it.
        if depth and (tag in BLOCK or depth > self.open_blocks[-1]):
            self._pop_to(depth)

    def _read(self, html: str) -> None:
        """One pass: every search begins where the last one ended, and what a search did not find is not sought again."""
        at, size = 0, len(html)
        gone: set[str] = set()  # marks that the rest of the page does not have

        def find(mark: str, begin: int) -> int:
            found = -1 if mark in gone else html.find(mark, begin)
            if found < 0:
                gone.add(mark)
            return found

        def tag_end(begin: int) -> int:
            """Just after the ``>`` that ends a tag, outside quotes if the quotes of the page close; 0 if there is none."""
            here = begin
            while "quotes" not in gone:
                m = TAG_MARK.search(html, here)
                if m and m[0] == ">":
                    return m.end()
                # A quote opens a value after an equals sign only; elsewhere it is a letter like others.
                here = m.end() if m else 0
                if m and html[max(begin, m.start() - 99) : m.start()].rstrip().endswith("="):
                    here = find(m[0], here) + 1
                if not here:
                    gone.add("quotes")
            return find(">", begin) + 1

        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                self._add(html[at:])
                break
            self._add(html[at:begin])
            if html.startswith("<!--", begin):
                end = find("-->", begin + 4)
                at = end + 3 if end >= 0 else size
                continue
            if html.startswith("<![CDATA[", begin):
                end = find("]]>", begin + 9)
                self._add(html[begin + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
                continue
            if html[begin + 1 : begin + 2] in ("!", "?"):
                at = find(">", begin) + 1 or size
                continue
            closing = html.startswith("</", begin)
            name = NAME.match(html, begin + 1 + closing)
            if not name:
                self._add("<")
                at = begin + 1
                continue
            at = tag_end(name.end())
            if not at:
                break  # a tag cut off by the end of the page is markup, not text
            tag, attributes = name[0].lower(), html[name.end() : at - 1]
            if closing:
                self._close(tag)
            elif tag in RAW:
                if tag in ("svg", "math") and attributes.endswith("/"):
                    continue
                end = None if "</" + tag in gone else re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
                if not end:
                    gone.add("</" + tag)
                at = end.end() if end else size
            else:
                self._open(tag, attributes)


def _scores(page: _Page) -> tuple[list[float], list[int], list[int]]:
    n = len(page.tags)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for owner, text, linked in page.blocks:
        given = (1 + text.count(",") + len(text) / 100) * (1 - linked / len(text))
        node = page.parents[owner] if page.tags[owner] in PARAGRAPH else owner
        share = 1
        while True:
            points[node] += given / share
            if node == 0 or share > FARTHEST:
                break
            node, share = page.parents[node], share * 2 if share < 2 else share * 3
        chars[owner] += len(text)
        links[owner] += linked
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += links[i]
    # An element that says it is the article starts with a few points.
    start = [5.0 if tag in ("article", "main") else 0.0 for tag in page.tags]
    return [(s + p) * (1 - k / c) if c else 0.0 for s, p, c, k in zip(start, points, chars, links)], chars, links


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in page order, two line feeds between; empty if there is none."""
    page = _Page(html or "")
    if not page.blocks:
        return ""
    scores, chars, links = _scores(page)
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    # An element that says it is the article holds all of it, also parts that score low.
    node = best
    while node and page.tags[node] not in ("article", "main"):
        node = page.parents[node]
    root = node or best
    kept = {root}
    if root:
        children: dict[int, list[int]] = {}
        for i in range(1, len(page.tags)):
            if chars[i]:
                children.setdefault(page.parents[i], []).append(i)

        def prose(above: int, but: int) -> list[int]:
            return [i for i in children[above] if i != but and links[i] < PROSE * chars[i]]

        # Without an element that says where the article ends, it goes on as long as all that stands beside it is prose.
        while not node and root:
            above = page.parents[root]
            if len(prose(above, root)) + 1 < len(children[above]):
                break
            root = above
        kept = {root}
        if root and not node:
            kept.update(prose(page.parents[root], root))
        elif root:
            floor = max(scores[root] * 0.2, 3.0)
            kept.update(i for i in prose(page.parents[root], root) if scores[i] >= floor or (page.tags[i] == "p" and chars[i] > 80))
    inside = [False] * len(page.tags)
    for i in range(len(page.tags)):
        inside[i] = i in kept or (i > 0 and inside[page.parents[i]])
    return "\n\n".join(text for owner, text, _ in page.blocks if inside[owner])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and its length ``n_chars`` (code points), one row per page.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows each give a row. Nothing of
    the article is cut, whatever its length.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    source = pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", f"`{html}` AS html")
    return by_batch(source, run, "page_id long, url string, text string, n_chars long")
