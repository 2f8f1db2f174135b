"""Main text of web pages by tree scoring.

Blocks of text pass points for their length and commas to their ancestors, less with each
step up; an element's points are discounted by the share of its text that is links. The best
element is kept with the headings and the text of few links beside it and its ancestors. An
article or main element says itself where the article ends: beside it only headings, others of
its kind and what scores well or reads like paragraphs are kept. What is never article (menus,
forms, notices, adverts, reader comments and the like) is left out beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: What starts markup; the rest of a tag, with quoted values after equals signs only; a comment's end. None goes back over what it has read.
_MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_COMMENT = re.compile(r"--!?>")
_ENDS: dict[str, re.Pattern] = {}
#: Decimal references too long for any character.
_LONG = re.compile(r"&#0*+[0-9]{8,}+;?")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements by kind.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "template", "svg", "math", "canvas", "object", "audio", "video", "map", "datalist"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words of classes, ids and roles that say what isn't article.
OTHER = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "widget",
}
ARTICLE, HEADINGS = ("article", "main"), ("h1", "h2", "h3", "h4", "h5", "h6")
_ROOTS = {"body", "html", *ARTICLE}
#: Share of links from which text beside the article isn't part of it.
LINKED = 0.25


def _excluded(tag: str, attributes: str, article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not article:
        return True
    if not attributes or tag in _ROOTS:
        return False
    for m in _MARK.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        words = _TOKEN.findall(_CAMEL.sub(" ", value).lower())
        if name != "hidden" and not OTHER.isdisjoint(words) or name in ("class", "id") and not article and words == ["header"]:
            return True
    return False


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = _LONG.sub(lambda m: "\ufffd" if len(m[0].strip("&#;").lstrip("0")) > 7 else f"&#{m[0].strip('&#;').lstrip('0')};", text)
    return unescape(text)


class Page:
    """A page's elements as parallel lists, and its blocks of text.

    Time is linear in the page: nothing walks up the tree for each block, and no text is scanned
    for an end that isn't there more than once.
    """

    def __init__(self, html: str):
        self.parents, self.tags = [-1], ["#root"]
        self.holders = [0]  # of each element, the innermost one around its text that isn't inline
        self._depths: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        self._parts: list[str] = []
        self._links = 0
        self._stack = [0]  # open elements
        self._out = 0  # open elements that are left out
        self._within = [(False, False, False)]  # per open element: left out itself, in an article, in a link
        self._read(html)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(_unescaped("".join(self._parts)).split())
            if text:
                self.blocks.append((self.holders[self._stack[-1]], text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, text: str) -> None:
        if not self._out and text:
            self._parts.append(text)
            if self._within[-1][2]:
                self._links += len(text)

    def _close(self, depth: int) -> None:
        """Closes open elements until so many are left."""
        while len(self._stack) > depth:
            if self.tags[self._stack[-1]] not in INLINE and not self._out:
                self._flush()
            self._depths[self.tags[self._stack.pop()]].pop()
            self._out -= self._within.pop()[0]

    def _find(self, tags: set[str], scope: set[str]) -> int:
        """Depth of the innermost open element of these tags, or 0 if one of scope comes first."""
        innermost = lambda names: max((at[-1] for t in names if (at := self._depths.get(t))), default=0)
        d = innermost(tags)
        return d if d > innermost(scope) else 0

    def _open(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            if not self._out:
                self._flush()
            if d := self._find({"p"}, {"button", "table", "object", "article", "section", "div", "body"} if tag != "p" else {"button", "table", "object", "article", "body"}):
                self._close(d)
            if tag in CLOSES and (d := self._find(CLOSES[tag], SCOPE[tag])):
                self._close(d)
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        _, article, link = self._within[-1]
        out = _excluded(tag, attributes, article)
        self.parents.append(self._stack[-1])
        self.tags.append(tag)
        self.holders.append(self.holders[self._stack[-1]] if inline else len(self.holders))
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tags) - 1)
        self._within.append((out, article or tag in ARTICLE, link or tag == "a"))
        self._out += out

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        quotes = True  # until a tag's quotes swallow the rest of the page
        while at < n:
            m = _MARKUP.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m[4] is None:
                self._text(html[at : m.start()])
                end = _COMMENT.search(html, m.end()) if m[1] else None
                at = (end.end() if end else n) if m[1] else html.find(">", m.end()) + 1 or n
                continue
            rest = _REST.match(html, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else html.find(">", m.end()) + 1
            if not end:  # no tag ends any more
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at, tag = end, m[4].lower()
            if m[3]:
                if d := self._find({tag}, {"table", "button"} if tag in INLINE else set()):
                    self._close(d)
                elif tag == "p":
                    self._flush()
                elif tag == "br":
                    self._text(" ")
            else:
                self._open(tag, html[m.end() : end - 1])
                if tag in RAW:
                    if tag not in _ENDS:
                        _ENDS[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)
                    close = _ENDS[tag].search(html, at)
                    at = html.find(">", close.end()) + 1 or n if close else n
                    self._close(len(self._stack) - 1)
        self._close(1)
        self._flush()

    def main_text(self) -> str:
        """The blocks of the best element and what is kept beside it and its ancestors, in page order, one a line."""
        if not self.blocks:
            return ""
        size = len(self.tags)
        points, chars, links = [0.0] * size, [0] * size, [0] * size
        for at, text, linked in self.blocks:
            points[at if self.tags[at] not in ("p", "pre", "blockquote", "td", "li", *HEADINGS) else self.parents[at]] += 1 + text.count(",") + min(len(text) / 100, 3)
            chars[at] += len(text)
            links[at] += linked
        # children come after their parents, which get half of their points
        for i in range(size - 1, 0, -1):
            up = self.parents[i]
            points[up] += points[i] / 2
            chars[up] += chars[i]
            links[up] += links[i]
        points[0] = 0.0
        score = [p * (1 - k / c) if c else 0.0 for p, c, k in zip(points, chars, links, strict=True)]
        for i, tag in enumerate(self.tags):
            if tag in ARTICLE and score[i] > 0:
                score[i] = score[i] * 2 + 10  # says itself that it is the article
        best = max(range(size), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            best = 0
        # from the best element up to the page, or to what says itself that it is the article
        path = [best] if best else []
        while path and self.tags[path[-1]] not in ARTICLE and self.parents[path[-1]] > 0:
            path.append(self.parents[path[-1]])
        on = {self.parents[i]: i for i in path}
        keep = {best}
        for i in range(1, size):
            beside = on.get(self.parents[i])
            if beside in (None, i) or not chars[i]:
                continue
            light = links[i] / chars[i] < LINKED
            if self.tags[beside] in ARTICLE:
                light = self.tags[i] in ARTICLE or light and (self.tags[i] == "p" and chars[i] > 80 or score[i] >= max(10, 0.2 * score[beside]))
            if light or self.tags[i] in HEADINGS:
                keep.add(i)
        loose = {p for p, i in on.items() if self.tags[i] not in ARTICLE}  # elements whose own text is beside the path
        inside = [False] * size
        for i in range(size):
            inside[i] = i in keep or i > 0 and inside[self.parents[i]]
        return "\n".join(text for at, text, linked in self.blocks if inside[at] or at in loose and linked / len(text) < LINKED)


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract_text(pages: DataFrame, *, html: str = "html", to: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns but html, if None), the main text, and n_chars, its code points.

    Blocks are joined by one \\n; white space inside one is one space; character references are
    decoded. A page that is null, empty or has no text gives an empty text. Broken markup is read
    as a browser would as far as blocks go, but a tag or quote that never ends swallows no text.
    Time and memory are linear in a page's size, however long, deep or broken it is. Repeated
    rows are kept; columns named as a result are replaced; an empty table gives an empty result.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html, to, "n_chars")]
    source = pages.select(*[pages[c] for c in keep], pages[html].alias("__html"))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rasterloom.llm._text import batches

        for batch in stream:
            for rows, _, _ in batches(batch, "__html", 8_000_000):
                texts = [main_text(x) for x in rows.column(rows.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, to, "n_chars"])

    kept = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{kept}`{to}` string, n_chars long")
