"""The two Arrow UDFs that read HTML: page text with title, and links of saved result pages.

Both walk the events of the standard library's HTML parser with lenient nesting: an end tag closes
the nearest open element of its name and all inside it, a stray end tag means nothing, void elements
never nest, nothing is closed implicitly.
"""

import functools
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

# What is thrown away, what never holds text, and what counts as the main part.
DROPPED = frozenset(["script", "style", "nav", "header", "footer", "aside", "iframe"])
MUTED = frozenset(["template", "rt", "rp"])
VOID = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
     "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"]
)
MAIN_CLASS = re.compile("content|main|article", re.IGNORECASE)
MAX_CONTAINERS = 10
# Where result pages keep their results, best first.
CONTAINERS = ["div.result", ".result", 'div[class*="result"]', ".web-result", ".result__body"]
TITLES = ["a.result__a", ".result__a", 'a[class*="result"]', "h2 a", "h3 a", "a"]
SNIPPETS = ["a.result__snippet", ".result__snippet", ".snippet"]
HEADINGS = ["h3", ".LC20lb"]


class _Events(HTMLParser):
    """Turns parser events into balanced ``opened``/``closed`` calls and whole text nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[str] = []
        self._text: list[str] = []

    def updatepos(self, i, j):
        # Line numbers are not wanted, and counting them takes a tenth of the time.
        return j

    def opened(self, tag, attrs): ...
    def closed(self, tag): ...
    def text(self, data): ...

    def read(self, markup: str):
        self.feed(markup)
        self.close()
        self._flush()
        while self.stack:
            self._pop()
        return self

    def _flush(self):
        if self._text:
            self.text("".join(self._text))
            self._text.clear()

    def _pop(self):
        self.closed(self.stack.pop())

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.stack.append(tag)
        self.opened(tag, attrs)
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self.stack.append(tag)
        self.opened(tag, attrs)
        self._pop()

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.stack:
            while self.stack[-1] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self._text.append(data)

    def handle_charref(self, name):
        self._text.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self._text.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.text(data[len("CDATA["):])


class _PageText(_Events):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.title: str | None = None
        self.spans: dict[str, list[int]] = {}
        self._open_spans: list[tuple[int, str]] = []
        self._dropped_at = self._muted_at = self._title_at = 0

    def opened(self, tag, attrs):
        depth = len(self.stack)
        if tag == "title" and self.title is None:
            self.title, self._title_at = "", depth
        if self._dropped_at:
            return
        if tag in DROPPED:
            self._dropped_at = depth
        elif tag in MUTED and not self._muted_at:
            self._muted_at = depth
        elif tag in ("main", "article", "body"):
            self._start(tag, depth)
        elif tag == "div" and "div" not in self.spans and MAIN_CLASS.search(dict(attrs).get("class") or ""):
            self._start(tag, depth)

    def _start(self, tag, depth):
        if tag not in self.spans:
            self.spans[tag] = [len(self.parts), -1]
            self._open_spans.append((depth, tag))

    def closed(self, tag):
        depth = len(self.stack) + 1
        if self._open_spans and self._open_spans[-1][0] == depth:
            self.spans[self._open_spans.pop()[1]][1] = len(self.parts)
        if self._dropped_at == depth:
            self._dropped_at = 0
        if self._muted_at == depth:
            self._muted_at = 0
        if self._title_at == depth:
            self._title_at = 0

    def text(self, data):
        if self._title_at:
            self.title += data
        if not (self._dropped_at or self._muted_at):
            data = data.strip()
            if data:
                self.parts.append(data)

    def content(self) -> str:
        for part in ("main", "article", "div", "body"):
            if part in self.spans:
                start, end = self.spans[part]
                return " ".join(self.parts[start:end])
        return " ".join(self.parts)


def read_page(markup: str | None) -> tuple[str, str | None]:
    """(text, title) of one page; the text of a page that cannot be read is empty."""
    page = _PageText()
    try:
        page.read(markup or "")
        return page.content(), page.title
    except Exception:  # noqa: BLE001 - one bad page must not fail the task
        return "", page.title


_PAGE = T.StructType([T.StructField(name, T.StringType()) for name in ("text", "title")])
_LINK = T.StructType(
    [T.StructField("dom_order", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in ("title", "url", "snippet")]
)


@F.pandas_udf(_PAGE)
def page_text(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(m) for m in markup], columns=["text", "title"], dtype=object)


@functools.cache
def _selector(selector: str) -> tuple[str, str, str | None, str]:
    """(outer element, element, kind of class test, class) of one of the few selectors used here."""
    outer, _, last = selector.rpartition(" ")
    return outer, *re.fullmatch(r"(\w*)(\.|\[class\*=)?([^\]]*)\]?", last).groups()


class _Node:
    __slots__ = ("attrs", "name", "parent", "parts")

    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.parts = name, attrs, parent, []

    def inside(self):
        """All texts and nodes below, in document order; pages may be nested to any depth."""
        waiting = list(reversed(self.parts))
        while waiting:
            part = waiting.pop()
            yield part
            if isinstance(part, _Node):
                waiting.extend(reversed(part.parts))

    def strings(self):
        return (part for part in self.inside() if isinstance(part, str))

    def below(self):
        return (part for part in self.inside() if isinstance(part, _Node))

    def above(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def matches(self, selector: str) -> bool:
        outer, name, mark, wanted = _selector(selector)
        if name and self.name != name or outer and not any(node.name == outer for node in self.above()):
            return False
        classes = self.attrs.get("class") or ""
        return mark is None or (wanted in classes.split() if mark == "." else wanted.strip('"') in classes)

    def select(self, selector):
        return (node for node in self.below() if node.matches(selector))


class _Tree(_Events):
    def __init__(self):
        super().__init__()
        self.root = self.at = _Node("", {}, None)
        self.muted = 0

    def opened(self, tag, attrs):
        self.muted += tag in MUTED or tag in ("script", "style")
        node = _Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        self.at = node

    def closed(self, tag):
        self.muted -= tag in MUTED or tag in ("script", "style")
        self.at = self.at.parent

    def text(self, data):
        if not self.muted:
            self.at.parts.append(data)


def _first(node: _Node, selectors: list[str]) -> list[_Node]:
    """All matches of the first selector that matches anything."""
    for selector in selectors:
        found = list(node.select(selector))
        if found:
            return found
    return []


def _tight(node: _Node) -> str:
    return "".join(s.strip() for s in node.strings())


def links_of_engine_a(markup: str) -> list[dict]:
    links = []
    for i, container in enumerate(_first(_Tree().read(markup).root, CONTAINERS)[:MAX_CONTAINERS]):
        titles, snippets = _first(container, TITLES)[:1], _first(container, SNIPPETS)[:1]
        if titles:
            links.append(
                {"dom_order": i, "title": _tight(titles[0]), "url": titles[0].attrs.get("href") or "",
                 "snippet": _tight(snippets[0]) if snippets else None}
            )
    return links


def links_of_engine_b(markup: str) -> list[dict]:
    links = []
    for i, heading in enumerate(_first(_Tree().read(markup).root, HEADINGS)[:MAX_CONTAINERS]):
        above = list(heading.above())
        link = next((n for n in above if n.name == "a"), None)
        if link is None:
            # Furthest ancestor last: its children come first in the document only if they precede.
            near = {id(n): n for a in above[:3] for n in a.parts if isinstance(n, _Node) and n.name == "a"}
            root = above[min(2, len(above) - 1)]
            link = next((n for n in root.below() if id(n) in near), None)
        if link is not None:
            links.append(
                {"dom_order": i, "title": " ".join("".join(heading.strings()).split()),
                 "url": link.attrs.get("href") or "", "snippet": None}
            )
    return links


_READERS = {"a": links_of_engine_a, "b": links_of_engine_b}


@F.pandas_udf(T.ArrayType(_LINK))
def result_links(markup: pd.Series, engine: pd.Series) -> pd.Series:
    def read(text, name):
        try:
            return _READERS[name](text or "")
        except Exception:  # noqa: BLE001 - one bad page must not fail the task
            return []

    return pd.Series([read(m, e) for m, e in zip(markup, engine)], index=markup.index)
