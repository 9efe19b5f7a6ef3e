"""HTML trees: clutter, content, Markdown. One parse per page, in Arrow batches.

The tree comes from the standard library's tokenizer with the usual repairs
(void elements, implied ends, raw text). The choice of the main content is our
own scoring and makes no claim to equal any other extractor's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from tidewell.functions.batches import small_batches
from tidewell.functions.urls import BLOCKED, canonical_url

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What is taken out of a page, in this order.
CLUTTER = ("nav", "header", "footer", "script", "style", "iframe", "svg", "noscript", "template", "form", "button", "input", "@skip")
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ENDS = {"li": {"li"}, "p": BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def content(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag == "#text":
                out.append(n.text)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def within(self, root: Node) -> bool:
        n = self
        while n.parent is not None:
            n = n.parent
        return n is root

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.tag in _ENDS and tag in _ENDS[n.tag]:
            self.at = n.parent or self.root
            n = self.at
        if tag == "p":  # an open paragraph ends even with inline elements open in it
            m = self.at
            while m is not self.root and m.tag not in BLOCK:
                m = m.parent
            if m.tag == "p":
                self.at = m.parent or self.root
        node = self.at.add(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "circle", "rect"):
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent or self.root

    def handle_data(self, data):
        self.at.add(Node("#text", text=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def collapse(text: str) -> str:
    return " ".join(text.split())


def text_content(node: Node) -> str:
    """Texts of the parts that have any, joined by blanks."""
    if not node.children:
        return node.text
    return collapse(" ".join(t for c in node.children if (t := text_content(c)).strip()))


# ---- Markdown


_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_BLANKS = re.compile(r"[ \t\r\n]+")
_SIGNS = re.compile(r"([\\*_`\[\]])")
_OPENING = re.compile(r"^(#{1,6} |[-+>]|=+|~~~)")
_NUMBER = re.compile(r"^(\d+)\. ")


def _level(node: Node) -> int:
    return min((_HEADINGS[n.tag] for n in node.walk() if n.tag in _HEADINGS), default=0)


def _escape(text: str) -> str:
    return _NUMBER.sub(r"\1\\. ", _OPENING.sub(r"\\\1", _SIGNS.sub(r"\\\1", text)))


def _table(node: Node, inner: str) -> str:
    rows: list[Node] = []

    def collect(n: Node) -> None:
        for c in n.children:
            if c.tag == "tr":
                rows.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                collect(c)

    collect(node)
    out, headed = [], False
    for i, row in enumerate(rows):
        cells = [c for c in row.children if c.tag in ("td", "th")]
        if not cells:
            continue
        out.append("| " + " | ".join(text_content(c).replace("|", "\\|").replace("\n", " ").strip() for c in cells) + " |")
        if not headed and (i == 0 or any(c.tag == "th" for c in cells)):
            out.append("| " + " | ".join(["---"] * len(cells)) + " |")
            headed = True
    return "\n\n" + "\n".join(out) + "\n\n" if out else inner


def _render(node: Node, pre: bool = False) -> str:
    tag = node.tag
    if tag == "#text":
        return node.text if pre else _escape(_BLANKS.sub(" ", node.text))
    if tag == "pre":
        code = node.content().rstrip("\n")
        kind = next((m[1] for n in node.walk() if (m := re.search(r"language-(\S+)", n.attrs.get("class", "")))), "")
        return f"\n\n```{kind}\n{code}\n```\n\n"
    if tag == "code":
        code = node.content().replace("\n", " ")
        ticks = "`" * (max((len(x) for x in re.findall("`+", code)), default=0) + 1)
        gap = " " if code.startswith("`") or code.endswith("`") else ""
        return f"{ticks}{gap}{code}{gap}{ticks}" if code else ""
    inner = _join([_render(c, pre) for c in node.children])
    if tag == "a":
        href = node.attrs.get("href")
        text = collapse(text_content(node) or inner)
        if not href:
            return text
        link = f"[{text}]({href})"
        return f"{'#' * n} {link}\n" if (n := _level(node)) else link
    if tag == "table":
        return _table(node, inner)
    if tag in ("del", "s"):
        return f"~~{inner}~~"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "img":
        src, alt = node.attrs.get("src", ""), collapse(node.attrs.get("alt", ""))
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"![{alt}]({src}{title})" if src else ""
    if not inner.strip() and tag not in ("#document", "html", "body"):
        return "\n\n" if tag in BLOCK else (" " if inner else "")
    if tag in _HEADINGS:
        return f"\n\n{'#' * _HEADINGS[tag]} {collapse(inner)}\n\n"
    if tag in ("em", "i", "strong", "b"):
        sign = "_" if tag in ("em", "i") else "**"
        lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{lead}{sign}{inner.strip()}{sign}{trail}"
    if tag == "blockquote":
        return "\n\n" + re.sub(r"(?m)^", "> ", inner.strip("\n")) + "\n\n"
    if tag == "li":
        mark = "-   "
        if node.parent is not None and node.parent.tag == "ol":
            items = [c for c in node.parent.children if c.tag == "li"]
            first = node.parent.attrs.get("start", "1")
            mark = f"{(int(first) if first.isdigit() else 1) + next(k for k, c in enumerate(items) if c is node)}.  "
        return mark + re.sub(r"\n", "\n    ", inner.strip("\n").rstrip()).lstrip() + "\n"
    if tag in ("ul", "ol"):
        nested = node.parent is not None and node.parent.tag == "li"
        return ("\n" if nested else "\n\n") + inner.strip("\n") + ("\n" if nested else "\n\n")
    return f"\n\n{inner}\n\n" if tag in BLOCK else inner


def _join(parts: list[str]) -> str:
    """Parts with at most one blank line, and one blank, between them."""
    out = ""
    for p in parts:
        left, right = out.rstrip("\n"), p.lstrip("\n")
        gap = max(len(out) - len(left), len(p) - len(right))
        if gap and right.startswith(" "):
            right = right.lstrip(" ")
        out = left + "\n" * min(gap, 2) + right if gap else out + (p[1:] if out.endswith((" ", "\n")) and p.startswith(" ") else p)
    return out


def to_markdown(node: Node) -> str:
    text = re.sub(r"[ \t]+\n(?=\n)", "\n", _join([_render(node)]))
    return re.sub(r"\n{3,}", "\n\n", text).strip("\t\r\n ")


# ---- content


def strip_clutter(root: Node) -> tuple[Node, str]:
    """The main (else body) element after removals, and a list of the texts removed."""
    items, found = [], {kind: [] for kind in CLUTTER}
    for n in root.walk():
        if n.tag in found:
            found[n.tag].append(n)
        if n.attrs.get("aria-label") == "skip to content":
            found["@skip"].append(n)
    for kind in CLUTTER:
        for n in [x for x in found[kind] if x.within(root)]:
            if t := n.content().strip():
                items.append(f"<li>{t}</li>")
            n.remove()
    main = root.find("main") or root.find("body") or root
    return main, f"<ul>{''.join(items)}</ul>" if items else ""


def _article(root: Node) -> Node | None:
    """The element whose own paragraphs hold most text, less its links."""
    scores: dict[int, tuple[float, Node]] = {}
    for n in root.walk():
        if n.tag not in ("p", "pre", "td", "li", "blockquote"):
            continue
        text = collapse(n.content())
        if len(text) < 25:
            continue
        linked = sum(len(collapse(a.content())) for a in n.walk() if a.tag == "a")
        gain = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / max(len(text), 1))
        up, share = n.parent, 1.0
        for _ in range(3):
            if up is None or up.tag == "#document":
                break
            scores[id(up)] = (scores.get(id(up), (0.0, up))[0] + gain * share, up)
            up, share = up.parent, share / 2
    best = max(scores.values(), key=lambda s: s[0], default=None)
    return best[1] if best and len(collapse(best[1].content())) >= 500 else None


def extract(html: str, url: str, fetched_at: str, origin: str | None = None, scope: str = "/") -> dict:
    """One page: links, markdown, clutter_markdown, llms_markdown, llms_full_markdown, title."""
    root = parse(html)
    links = tree_links(root, url, origin or _origin(url), scope)
    full = to_markdown(root)
    name = root.find("title")
    title = collapse(name.content()) if name is not None else ""
    main, clutter = strip_clutter(root)  # all that needs the whole tree is done
    body = _article(main) or main
    text = to_markdown(body)
    head = f"---\nSource: {url}\nFetched: {fetched_at}\n---\n\n# {title}\n"
    document = f"{head}{text}\n"
    return {"links": links, "title": title, "markdown": document, "clutter_markdown": to_markdown(parse(clutter)) if clutter else "", "llms_markdown": document, "llms_full_markdown": f"{head}{full}\n"}


def _origin(url: str) -> str:
    return re.match(r"[a-z]+://[^/?#]*", url)[0]


def tree_links(root: Node, url: str, origin: str, scope: str) -> list[str]:
    """Pages that the anchors of a tree lead to, in order, each once."""
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None)
    base = (canonical_url(base, url) or url) if base else url
    bare = scope.removesuffix("/")
    out = []
    for n in root.walk():
        if n.tag == "a" and n.attrs.get("href"):
            full = canonical_url(n.attrs["href"], base)
            m = re.match(r"([a-z]+://[^/?#]*)([^?#]*)", full) if full else None
            if m and m[1] == origin and (scope == "/" or m[2] == bare or m[2].startswith(bare + "/")) and not re.search(rf"(?i)\.({BLOCKED})\Z", m[2]):
                out.append(m[0])
    return list(dict.fromkeys(out))


_OUT = "links array<string>, title string, markdown string, clutter_markdown string, llms_markdown string, llms_full_markdown string"


def extract_content(html: Column, url: Column, fetched_at: Column, scope: Column | None = None) -> Column:
    """struct of everything that one parse of a page gives; null pages give null."""

    @pandas_udf(_OUT)
    def of(h: pd.Series, u: pd.Series, t: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = [extract(a or "", b, c, None, d) for a, b, c, d in zip(h, u, t, s, strict=True)]
        return pd.DataFrame(rows, columns=["links", "title", "markdown", "clutter_markdown", "llms_markdown", "llms_full_markdown"])

    small_batches()
    return of(html, url, fetched_at, F.lit("/") if scope is None else scope)


def content_links(html: Column, url: Column, scope: Column | None = None) -> Column:
    """The links of ``extract_content`` alone, without any document made; null pages give none.

    Declared not deterministic, as a filter on it would otherwise be moved
    below it and have every page parsed a second time, in a second worker.
    """

    @pandas_udf("array<string>")
    def of(h: pd.Series, u: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([tree_links(parse(a or ""), b, _origin(b), c) for a, b, c in zip(h, u, s, strict=True)], dtype=object)

    small_batches()
    return of.asNondeterministic()(html, url, F.lit("/") if scope is None else scope)


@pandas_udf(StringType())
def _markdown_of(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else to_markdown(parse(h)) for h in html], dtype=object)


def html_to_markdown(html: Column | str) -> Column:
    small_batches()
    return _markdown_of(html)


@pandas_udf(StructType([StructField("main", StringType()), StructField("clutter", StringType())]))
def _clutter_of(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        main, clutter = strip_clutter(parse(h or ""))
        rows.append((collapse(main.content()), clutter))
    return pd.DataFrame(rows, columns=["main", "clutter"])


def clutter_of(html: Column | str) -> Column:
    """struct main, clutter: the texts that are left of a page, and a list of those removed."""
    small_batches()
    return _clutter_of(html)
