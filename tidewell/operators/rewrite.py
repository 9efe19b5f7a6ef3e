"""Link rewriting against the set of known pages.

Markdown has to be read with offsets (code spans, tags, link ranges), which
regular expressions of the engine cannot express, so documents are rewritten
in Arrow batches. Which targets exist is decided before that, by a join: each
document comes with the map from its references to relative paths, so no set
of all pages is ever sent to a task.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from tidewell.functions.batches import small_batches
from tidewell.functions.urls import BLOCKED, canonical_url, href_target

#: The shapes of links that are rewritten, and the sign of those that lead away.
_INLINE = re.compile(r"(!?)\[([^\]]+)\]\(([^)]+)\)")
_REFERENCE = re.compile(r"(^[ \t]*\[[^\]]+\]:\s*)(\S+)(.*)$", re.M)
_REFERENCE_LINE = re.compile(r"[ \t]*\[[^\]]+\]:\s*\S+")
_AUTO = re.compile(r"<\s*(https?://[^>\s]+)\s*>")
_BARE = re.compile(r"\bhttps?://[^\s<>\"'()]+")
_ATTRIBUTE = re.compile(r"(\bhref\s*=\s*)(?:\"([^\"]+)\"|'([^']+)'|\{([^}]+)\})")
_BRACED = re.compile(r"\s*(['\"])(.+)\1\s*")
_FENCE = re.compile(r"\s*(```|~~~)")
_FRONT = re.compile(r"(---\s*\n.*?\n---\s*\n)(.*)", re.S)
_SOURCE = re.compile(r"Source:\s*(.+?)\s*$", re.I)
_BLOCKED = re.compile(rf"\.({BLOCKED})\Z", re.I)
MARK = "↗"

Resolve = Callable[[str], str | None]


def split_front(md: str) -> tuple[str, str]:
    m = _FRONT.fullmatch(md)
    return (m[1], m[2]) if m else ("", md)


def parse_href(raw: str) -> tuple[str, str, bool]:
    parts = re.match(r"(\S*)(.*)", raw.strip(), re.S)
    href, suffix = parts[1], parts[2]
    wrapped = href.startswith("<") and href.endswith(">")
    return (href[1:-1] if wrapped else href), suffix, wrapped


def attribute_href(m: re.Match) -> tuple[str, str, str] | None:
    """What an ``href=`` match points to, and the signs before and after it."""
    if m[2] is not None:
        return m[2], '"', '"'
    if m[3] is not None:
        return m[3], "'", "'"
    b = _BRACED.fullmatch(m[4])
    return (b[2], "{" + b[1], b[1] + "}") if b else None


def unfenced(md: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether bare URLs in them count."""
    fence = ""
    for line in md.split("\n"):
        m = _FENCE.match(line)
        if m:
            fence = m[1] if not fence else "" if m[1] == fence else fence
        yield line, not m and not fence and not _REFERENCE_LINE.match(line)


def _code_ranges(line: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while (at := line.find("`", at)) >= 0:
        ticks = len(line[at:]) - len(line[at:].lstrip("`"))
        end = line.find("`" * ticks, at + ticks)
        if end < 0:
            break
        out.append((at, end + ticks))
        at = end + ticks
    return out


def bare_urls(line: str) -> list[tuple[int, int, str]]:
    """(start, end, url) of the bare URLs of a line; the URL ends before punctuation."""
    taken = _code_ranges(line) + [m.span() for m in _INLINE.finditer(line)]
    out = []
    for m in _BARE.finditer(line):
        at = m.start()
        if any(s <= at < e for s, e in taken) or line[:at].rstrip().endswith("](") or line[at - 1 : at] == "<":
            continue
        if line.rfind("<", 0, at + 1) > line.rfind(">", 0, at + 1) and line.find(">", at) >= 0:
            continue
        out.append((at, m.end(), m[0].rstrip(".,!?;:")))
    return out


def in_scope(path: str, scope: str) -> bool:
    bare = scope.removesuffix("/")
    return scope == "/" or path == bare or path.startswith(bare + "/")


def scoped(href: str, target: str, scope: str | None) -> str:
    """Root-relative references out of the scope are moved below it."""
    u = urlsplit(target)
    if not scope or scope == "/" or not href.startswith("/") or in_scope(u.path, scope):
        return target
    return f"{u.scheme}://{u.netloc}{scope.removesuffix('/')}{u.path}"


def references(md: str) -> list[str]:
    """All references of a document in the order of the five channels, with repeats."""
    text = split_front(md)[1]
    out = [parse_href(m[3])[0] for m in _INLINE.finditer(text) if not m[1]]
    out += [parse_href(m[2])[0] for m in _REFERENCE.finditer(text)]
    out += [a[0] for m in _ATTRIBUTE.finditer(text) if (a := attribute_href(m))]
    out += [m[1] for m in _AUTO.finditer(text)]
    out += [u for line, ok in unfenced(text) if ok for _, _, u in bare_urls(line)]
    return [x for x in out if x]


def page_links(md: str, base: str, origin: str, scope: str) -> list[str]:
    """Pages that a Markdown document links to within an origin and scope."""
    out = []
    for href in references(md):
        target = href_target(href, base)
        if target:
            target = scoped(href, target, scope)
            u = urlsplit(target)
            if f"{u.scheme}://{u.netloc}" == origin and in_scope(u.path, scope) and not _BLOCKED.search(u.path):
                out.append(target)
    return list(dict.fromkeys(out))


def _external(href: str, current: str, base: str | None) -> bool:
    target = href_target(href, current, base)
    if not target:
        return False
    a, b = urlsplit(target), urlsplit(current)
    return (a.scheme, a.netloc) != (b.scheme, b.netloc)


def _label(text: str, external: bool) -> str:
    if external:
        return text if text.rstrip().endswith(MARK) else f"{text} {MARK}"
    return re.sub(rf"\s*{MARK}\s*$", "", text).rstrip()


def plain_source(value: str) -> str | None:
    v = re.sub(rf"\s*{MARK}\s*$", "", value).strip()
    if m := re.fullmatch(r"\[(.+?)\]\((.+?)\)", v):
        label, href = m[1].strip(), m[2].strip()
        for x in (label, href):
            if re.match(r"https?://", x, re.I):
                return x
        return label or href or None
    if m := re.fullmatch(r"<(.+)>", v):
        return m[1].strip() or None
    return v or None


def normalize_front(front: str) -> str:
    lines, changed = re.split(r"\r?\n", front), False
    for i, line in enumerate(lines):
        m = _SOURCE.match(line)
        if m and (value := plain_source(m[1].strip())):
            lines[i], changed = f"Source: {value}", True
    return "\n".join(lines) if changed else front


def rewrite_document(md: str, current: str, resolve: Resolve, base: str | None = None) -> str:
    """Links to known pages become relative paths, others keep their target.

    Inline links outside the origin get a marker once, all others lose it.
    """
    front, text = split_front(md)

    def inline(m: re.Match) -> str:
        if m[1]:
            return m[0]
        href, suffix, wrapped = parse_href(m[3])
        new = resolve(href) if href else None
        if new:
            return f"[{_label(m[2], False)}]({f'<{new}>' if wrapped else new}{suffix})"
        return f"[{_label(m[2], bool(href) and _external(href, current, base))}]({m[3]})"

    def reference(m: re.Match) -> str:
        href, _, wrapped = parse_href(m[2])
        new = resolve(href) if href else None
        return f"{m[1]}{f'<{new}>' if wrapped else new}{m[3]}" if new else m[0]

    def attribute(m: re.Match) -> str:
        a = attribute_href(m)
        new = resolve(a[0]) if a else None
        return f"{m[1]}{a[1]}{new}{a[2]}" if new else m[0]

    text = _ATTRIBUTE.sub(attribute, _REFERENCE.sub(reference, _INLINE.sub(inline, text)))
    lines = []
    for line, ok in unfenced(text):
        if ok:
            for start, end, url in reversed(bare_urls(line)):
                if new := resolve(url):
                    line = f"{line[:start]}[{url}]({new}){line[start + len(url) : end]}{line[end:]}"
        lines.append(line)
    return normalize_front(front) + "\n".join(lines)


def snake(segment: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^A-Za-z0-9]+", "_", segment)).lower() or "index"


def page_path(url: str) -> str:
    u = urlsplit(url)
    return "/".join([snake(u.hostname or ""), *([snake(p) for p in u.path.split("/") if p] or ["root"]), "page.md"])


def resolver(current: str, known: Callable[[str], bool], base: str | None = None, scope: str | None = None) -> Resolve:
    """Function reference -> relative path of the saved page, or None."""
    here = posixpath.dirname(page_path(current))

    def resolve(href: str) -> str | None:
        target = href_target(href, current, base)
        if not target:
            return None
        target = scoped(href, target, scope)
        if not known(target):
            return None
        full = canonical_url(href, base or current) or ""
        anchor = "#" + full.split("#", 1)[1] if "#" in full else ""
        return posixpath.relpath(page_path(target), here) + anchor

    return resolve


# ---- as columns and tables


def markdown_links(md: Column, base: Column, origin: Column, scope: Column) -> Column:
    """array<string> of the pages that a document links to."""

    @pandas_udf("array<string>")
    def links(m: pd.Series, b: pd.Series, o: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([page_links(x or "", *y) for x, *y in zip(m, b, o, s, strict=True)], dtype=object)

    small_batches()
    return links(md, base, origin, scope)


@pandas_udf(ArrayType(StringType()))
def _targets(md: pd.Series, current: pd.Series, base: pd.Series, scope: pd.Series) -> pd.Series:
    def of(m, c, b, s):
        found = ((h, href_target(h, c, b)) for h in references(m or ""))
        return sorted({scoped(h, t, s) for h, t in found if t})

    return pd.Series([of(*x) for x in zip(md, current, base, scope, strict=True)], dtype=object)


@pandas_udf(StringType())
def _rewrite(md: pd.Series, current: pd.Series, base: pd.Series, scope: pd.Series, known: pd.Series) -> pd.Series:
    def of(m, c, b, s, k):
        return None if m is None else rewrite_document(m, c, resolver(c, set(k if k is not None else ()).__contains__, b, s), b)

    return pd.Series([of(*x) for x in zip(md, current, base, scope, known, strict=True)], dtype=object)


def rewrite(docs: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (url, ``columns`` and optionally base_url and scope) with links rewritten.

    ``known`` has the normalised URLs of all saved pages in ``url``. The
    targets of all columns of a document are joined to it once, so only its
    own known targets come with a document. Documents meet their targets by a
    128-bit hash of their url and columns, so equal rows count as one. Null
    documents stay null. Without ``columns`` it is markdown that is rewritten.
    """
    small_batches()
    columns = columns or ("markdown",)
    base = F.col("base_url") if "base_url" in docs.columns else F.lit(None).cast("string")
    scope = F.col("scope") if "scope" in docs.columns else F.lit("/")
    row = ["__row1", "__row2"]
    keyed = docs.withColumns({"__row1": F.xxhash64("url", *columns), "__row2": F.xxhash64(F.lit(1), *reversed(columns), "url"), "__base": base, "__scope": scope})
    at = (F.col("url"), F.col("__base"), F.col("__scope"))
    every = F.array_distinct(F.flatten(F.array(*(_targets(F.col(c), *at) for c in columns))))
    targets = keyed.select(*row, F.explode(every).alias("target")).distinct()
    mine = targets.join(known.select(F.col("url").alias("target")).distinct(), "target", "left_semi").groupBy(*row).agg(F.collect_set("target").alias("__known"))
    new = {c: _rewrite(F.col(c), *at, F.col("__known")) for c in columns}
    return keyed.join(mine, row, "left").withColumns(new).drop(*row, "__known", "__base", "__scope")
