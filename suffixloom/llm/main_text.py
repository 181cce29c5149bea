"""Main text of web pages by composite text density.

A page is cut into tags and texts and built into a tree with HTML's implied end tags.
Parts that name themselves as menus, headers, footers, sidebars, notices, adverts, forms
or comments are taken out first.  Every node of the rest gets its characters per tag,
adjusted by the characters and tags of its links; the container whose blocks' densities
have the largest sum is the content (inline elements count as tags only), and with it the
whole rest of the article, main or content element around it: headline, short sections
and bare text, unless that element holds a second article.  The least density on the path from it to the body
is the threshold at which subtrees beside that path count as content too; where no such element is on the path,
headings and passages beside it do so at any length, unless half of them is links.  The header of an article
belongs to it, and a name such as "related" takes a part out only if the words beside it say nothing else.

Row-wise and without exchange; a page never leaves its row, and the work is linear in it.

Defined cases: a null, empty or tagless page has the text that stands in it outside of
tags, or none; unclosed comments, scripts and styles reach to the end of the page; a
repeated row is extracted again; further columns pass through, those named as an added
column give way.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame, types as T

from .arrow import add_columns

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.DOTALL)
NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?:\s|^)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

# Fixed values of HTML: elements without content, with raw text, that start a block, that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table caption thead tbody "
    "tfoot tr ul".split())
#: Blocks that hold running text: they have a density but are never the whole content.
PASSAGES = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd caption figcaption summary tr address".split())
CONTAINERS = BLOCKS - PASSAGES | {"#page"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS_P = BLOCKS - {"body", "html", "caption", "thead", "tbody", "tfoot", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"}
# Elements and names of parts that are no article.
ASIDE_TAGS = frozenset("nav header footer aside form menu button select dialog head search label".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar header footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login share sharing social comment comments reply replies respond disqus related "
    "recommended pagination pager widget toolbar copyright complementary contentinfo search".split())
#: Of these names, the ones that wrappers of a whole page bear as well ("has-sidebar").
WRAPPER_NAMES = frozenset("nav navbar menu sidebar header footer masthead banner widget toolbar search overlay".split())
#: Of these names, the ones that are words of running text as well, and the words that may stand beside them in the
#: name of such a part ("related-posts", but not "related-work").
WORDS_TOO = frozenset(
    "social related recommended notice notices copyright share sharing promotion reply replies respond comment "
    "login subscribe".split())
BESIDE = frozenset(
    "a area article articles bar block body bottom box btn button buttons card cards center col column container content "
    "count cta desktop div entries entry feed fixed float follow form global grid group head heading holder icon icons image inner "
    "input item items large left link links list lists main media mobile module more news outer page panel pages plugin post "
    "posts primary right row section secondary site slot small sm md lg sticky stories story tag tags text thread title top "
    "us video videos view wrap wrapper wp js".split())
#: The words that make the name of an article's own header.
OWN_HEADER = frozenset("article entry post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of elements that hold the content.
CONTENT_NAMES = frozenset("article content entry main post story".split())
NO, BY_TAG, BY_NAME, BY_CLEAR_NAME = range(4)
#: These may bear such a name and still hold the page.
NEVER_ASIDE = frozenset(("html", "body", "main", "article"))


class Page:
    """The tree of a page: nodes in page order, each with its parent, and the texts."""

    def __init__(self, html: str):
        self.parent, self.tag = [-1], ["#page"]
        self._holds = [False]  # whether a node names itself as what holds the content
        self._out = [NO]  # why a node is no article by itself
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self._open = [0]
        self._block = 0
        at, end = 0, len(html)
        while at < end:
            token = TOKEN.search(html, at)
            self._text(html[at:token.start() if token else end])
            if token is None:
                break
            at = token.end()
            name = (token[2] or token[5] or "").lower()
            if not name:
                continue
            if token[1] or token[4]:
                self._close(name)
            else:
                self._start(name, token[3] or "")
                if name in RAW:
                    done = re.compile(f"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(html, at)
                    at = done.end() if done else end if name in ("script", "style") else at
        self.aside = self._asides()

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            self.texts.append((self._open[-1], self._block, text))
        elif text:
            self.texts.append((self._open[-1], self._block, " "))

    def _pop_to(self, names, stops) -> None:
        """Close the innermost open element of ``names``, unless one of ``stops`` lies above it."""
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[i]]
            if tag in names:
                del self._open[i:]
                return
            if tag in stops:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self._pop_to({"p"}, BLOCKS - {"p"})
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        if name in BLOCKS:
            self._block += 1
        elif name in ("br", "td", "th"):
            self.texts.append((self._open[-1], self._block, " "))
        above = self._open[-1]
        in_article = any(self.tag[i] == "article" for i in self._open)
        out = BY_TAG if name in RAW or name in ASIDE_TAGS and not (name == "header" and in_article) else NO
        if out == NO and attributes and name not in NEVER_ASIDE:
            out = _by_name(attributes, in_article)
        self.parent.append(above)
        self.tag.append(name)
        self._holds.append(name in ("article", "main") or name in CONTAINERS and name not in ("html", "body")
                           and bool(attributes) and not _name_parts(attributes).isdisjoint(CONTENT_NAMES))
        self._out.append(out)
        if name not in VOID and name not in RAW:
            self._open.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._block += 1
        if any(self.tag[i] == name for i in reversed(self._open[1:])):
            self._pop_to({name}, ())

    def _asides(self) -> list[bool]:
        """Whether a node lies in a part that is no article.  A wrapper's name does not count
        where it would take nearly all of the page's text, or most of it and its title."""
        n = len(self.tag)
        if BY_NAME in self._out:
            gone, chars, title = [False] * n, [0] * n, [t in ("h1", "article", "main") for t in self.tag]
            for i in range(1, n):
                gone[i] = gone[self.parent[i]] or self._out[i] in (BY_TAG, BY_CLEAR_NAME)
            for node, _, text in self.texts:
                if not gone[node]:
                    chars[node] += len(text.strip())
            for i in range(n - 1, 0, -1):
                chars[self.parent[i]] += chars[i]
                title[self.parent[i]] |= title[i]
            self._out = [NO if o == BY_NAME and 10 * c > chars[0] * (5 if t else 9) else o
                         for o, c, t in zip(self._out, chars, title)]
        out = [False] * n
        for i in range(1, n):
            out[i] = out[self.parent[i]] or self._out[i] != NO
        return out

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and the sum over its children."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, _, text in self.texts:
            if not self.aside[node]:
                size = len(text.strip())
                chars[node] += size
                links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.aside[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.aside[i]:
                c, lc, t, lt = chars[i], max(links[i], 1), max(tags[i], 1), max(link_tags[i], 1)
                base = log(c / max(c - links[i], 1) * links[i] + share * c + e)
                density[i] = c / t * max(log(c / lc * t / lt), 0.0) / max(log(base), 1.0)
                if self.tag[i] in BLOCKS:
                    total[self.parent[i]] += density[i]
        return density, total

    def content(self) -> list[int]:
        """The roots of the content, in page order."""
        density, total = self.densities()
        best = max((i for i in range(len(total)) if self.tag[i] in CONTAINERS), key=lambda i: (total[i], density[i]))
        path, node = [], best
        while node > 0:
            path.append(node)
            node = self.parent[node]
        articles = [0] * len(total)  # outermost ones with text
        for i in range(len(total) - 1, 0, -1):
            articles[i] = 1 if self.tag[i] == "article" and density[i] else articles[i]
            articles[self.parent[i]] += articles[i]
        whole = [i for i in path if self._holds[i] and not self.aside[i] and articles[i] < 2]
        threshold = min((density[i] for i in path), default=0.0)
        on_path = {0, *path}
        besides = [i for i in range(1, len(total)) if self.parent[i] in on_path and i not in on_path
                   and self.parent[i] != best and self.tag[i] in BLOCKS and density[i]]
        passages = set() if whole else self._passages()
        beside = [i for i in besides if density[i] >= threshold or i in passages]
        return sorted({best, *beside, *whole[-1:]})

    def _passages(self) -> set[int]:
        """Headings, and nodes with a paragraph, of which less than half is links."""
        n = len(self.tag)
        chars, links, found = [0] * n, [0] * n, [t == "p" or t in HEADINGS for t in self.tag]
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, _, text in self.texts:
            if not self.aside[node]:
                chars[node] += len(text.strip())
                links[node] += len(text.strip()) * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.aside[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                links[up] += links[i]
                found[up] |= found[i]
        return {i for i in range(1, n) if found[i] and 2 * links[i] < chars[i]}

    def main_text(self) -> str:
        keep = [False] * len(self.tag)
        for root in self.content():
            keep[root] = True
        for i in range(1, len(keep)):
            keep[i] = not self.aside[i] and (keep[i] or keep[self.parent[i]])
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            if keep[node]:
                blocks.setdefault(block, []).append(unescape(text) if "&" in text else text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def _name_parts(attributes: str) -> set[str]:
    """The words of class, id and role."""
    return {p for value in NAMES.findall(attributes) for p in NAME_PARTS.findall(CAMEL.sub(" ", value).lower())}


def _tokens(attributes: str) -> list[set[str]]:
    """The words of each single name in class, id and role."""
    return [set(NAME_PARTS.findall(CAMEL.sub(" ", token).lower()))
            for value in NAMES.findall(attributes) for token in value.strip("\"'").split()]


def _by_name(attributes: str, in_article: bool = False) -> int:
    """Whether the attributes name a part that is no article."""
    if HIDDEN.search(attributes):
        return BY_CLEAR_NAME
    parts = _name_parts(attributes)
    if parts & ASIDE_NAMES - WRAPPER_NAMES - WORDS_TOO:
        return BY_CLEAR_NAME
    if parts & WORDS_TOO and any(t & WORDS_TOO and t <= ASIDE_NAMES | BESIDE for t in _tokens(attributes)):
        return BY_CLEAR_NAME
    found = parts & WRAPPER_NAMES - WORDS_TOO
    if in_article and found == {"header"} and (parts & OWN_HEADER or parts == {"header"}):
        return NO
    return BY_NAME if found else NO


def extract(html: str | None) -> str:
    """The main text of a page."""
    return Page(html).main_text() if html else ""


SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (of it the columns ``keep``, if given) with ``text``, the main text of ``html``, and ``n_chars``, its code points."""

    def make():
        def work(htmls: list) -> dict:
            texts = [extract(h) for h in htmls]
            return {"text": texts, "n_chars": [len(t) for t in texts]}
        return work

    return add_columns(pages, SCHEMA, make, "html", keep)
