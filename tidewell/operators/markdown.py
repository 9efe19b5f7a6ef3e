"""Markdown documents: frontmatter, titles, source lines, links, fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import urls

#: Shapes of frontmatter and headings.
FRONT = r"\A(---\s*\n(?s:.*?)\n---\s*\n)((?s:.*))\z"
HEADING = r"(?m)^#{1,6}\s+(.+?)\s*$"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frontmatter(md) -> Column:
    return F.regexp_extract(_col(md), FRONT, 1)


def body(md) -> Column:
    m = _col(md)
    return F.when(m.rlike(FRONT), F.regexp_extract(m, FRONT, 2)).otherwise(m)


def title(md) -> Column:
    """The first heading anywhere, null without one."""
    return F.nullif(F.regexp_extract(_col(md), HEADING, 1), F.lit(""))


def has_leading_heading(md) -> Column:
    """Whether the first non-blank line is a heading."""
    return _col(md).rlike(r"\A\s*#{1,6}\s+\S")


def build_frontmatter(url, fetched_at) -> Column:
    return F.concat(F.lit("---\nSource: "), _col(url), F.lit("\nFetched: "), _col(fetched_at), F.lit("\n---\n"))


def extract_markdown(md, url, fetched_at) -> Column:
    """A fetched Markdown source as a document, with a title line if it has none."""
    text = F.regexp_replace(F.regexp_replace(_col(md), r"\A\s+", ""), r"\s+\z", "")
    head = build_frontmatter(url, fetched_at)
    named = F.concat(F.lit("# "), F.coalesce(title(text), _col(url)), F.lit("\n\n"), text)
    return F.concat(head, F.when(has_leading_heading(text), text).otherwise(named))


def source_url(md) -> Column:
    """The URL of a saved document's Source line, null without one."""
    raw = F.regexp_extract(frontmatter(md), r"(?im)^Source:\s*(.+?)\s*$", 1)
    return F.when(raw != "", urls.normalize_source_value(raw))


def inline_links(md) -> Column:
    """array<struct<label, raw>> of links, without images."""
    every = F.regexp_extract_all(_col(md), F.lit(r"(!?\[[^\]]+\]\([^)]+\))"), F.lit(1))
    links = F.filter(every, lambda x: ~x.startswith("!["))
    return F.transform(links, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]\(", 1).alias("label"), F.regexp_extract(x, r"\]\(([^)]+)\)$", 1).alias("raw")))


def parse_href(raw) -> Column:
    """struct href, suffix (title and what else follows), wrapped in ``<>``."""
    t = F.trim(_col(raw))
    first = F.regexp_extract(t, r"^(\S*)", 1)
    wrapped = first.startswith("<") & first.endswith(">")
    return F.struct(F.when(wrapped, F.regexp_replace(first, r"^<|>$", "")).otherwise(first).alias("href"), F.regexp_extract(t, r"^\S*(\s[\s\S]*)?$", 1).alias("suffix"), wrapped.alias("wrapped"))


def reference_targets(md) -> Column:
    return F.regexp_extract_all(_col(md), F.lit(r"(?m)^[ \t]*\[[^\]]+\]:\s*(\S+).*$"), F.lit(1))


def autolinks(md) -> Column:
    return F.regexp_extract_all(_col(md), F.lit(r"<\s*(https?://[^>\s]+)\s*>"), F.lit(1))


def split_trailing_punctuation(url) -> Column:
    u = _col(url)
    return F.struct(F.regexp_replace(u, r"[.,!?;:]+$", "").alias("url"), F.regexp_extract(u, r"([.,!?;:]+)$", 1).alias("trailing"))


def fences(lines) -> Column:
    """array<struct<a, b>>: first and last line of every fenced block; an open one lasts to the end.

    Only the lines with a mark are folded over; a block ends at its own mark.
    """
    every = _col(lines)
    marked = F.filter(F.transform(every, lambda line, i: F.struct(i.alias("i"), F.regexp_extract(line, r"^\s*(```|~~~)", 1).alias("mark"))), lambda m: m["mark"] != "")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(s, m):
        closes = s["open"] == m["mark"]
        now = F.when(s["open"] == "", m["mark"]).when(closes, F.lit("")).otherwise(s["open"])
        begin = F.when(s["open"] == "", m["i"]).otherwise(s["begin"])
        done = F.when(closes, F.concat(s["done"], F.array(F.struct(s["begin"].alias("a"), m["i"].alias("b"))))).otherwise(s["done"])
        return F.struct(now.alias("open"), begin.alias("begin"), done.alias("done"))

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("begin"), none.alias("done"))
    last = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["begin"].alias("a"), (F.size(every) - 1).alias("b")))))
    return F.aggregate(marked, start, step, last)


def fence_states(md) -> Column:
    """array<boolean>: for each line, whether it is a fence or inside one."""
    lines = F.split(_col(md), "\n")
    # the blocks are a one-element array here, so that they are made once and not for every line
    of = F.transform(F.array(fences(lines)), lambda found: F.concat(F.flatten(F.transform(found, lambda s, k: _block(found, s, k))), F.array_repeat(F.lit(False), F.size(lines) - 1 - F.coalesce(F.try_element_at(found, F.lit(-1))["b"], F.lit(-1)))))
    return F.get(of, F.lit(0))


def _block(found: Column, s: Column, k: Column) -> Column:
    """States of the lines between the block before and this one, and of its own."""
    before = F.coalesce(F.get(found, k - 1)["b"], F.lit(-1))
    return F.concat(F.array_repeat(F.lit(False), s["a"] - before - 1), F.array_repeat(F.lit(True), s["b"] - s["a"] + 1))


def simple_bare_urls(md) -> Column:
    """Bare URLs outside fences, reference lines, tags, links and code spans.

    Links, code spans and tags are blanked first, so this stays in generated
    code; ``rewrite.markdown_links`` has the offset-exact form.
    """
    lines = F.arrays_zip(F.split(_col(md), "\n").alias("l"), fence_states(md).alias("s"))
    kept = F.filter(lines, lambda z: ~z["s"] & ~z["l"].rlike(r"^[ \t]*\[[^\]]+\]:\s*\S+"))
    blank = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(`+)[^`]*\1", " "), r"!?\[[^\]]+\]\([^)]+\)", " "), r"<[^>]*>", " ")
    found = F.flatten(F.transform(kept, lambda z: F.regexp_extract_all(blank(z["l"]), F.lit(r"\b(https?://[^\s<>\"'()]+)"), F.lit(1))))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,!?;:]+$", ""))


def with_external_marker(text) -> Column:
    t = _col(text)
    return F.when(F.rtrim(t).endswith("↗"), t).otherwise(F.concat(t, F.lit(" ↗")))


def without_external_marker(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), r"\s*↗\s*$", ""), r"\s+$", "")
