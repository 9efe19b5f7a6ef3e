"""Fetching pages: from a snapshot table, or over HTTP from the executors.

Sources are tried in order of cost, and each next one only for the rows that
the one before had nothing for: Markdown, then HTML, then rendered HTML.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import urls

#: Fixed value: what a request for a Markdown source asks for.
MARKDOWN_ACCEPT = "text/markdown,text/plain;q=0.9,*/*;q=0.8"


def from_snapshot(frontier: DataFrame, pages: DataFrame, markdown: DataFrame | None = None, rendered: DataFrame | None = None, render: bool = True, least_text: int = 200) -> DataFrame:
    """(url) -> url, source, content: markdown, html, rendered or missing.

    ``pages`` and ``rendered`` have url and html, ``markdown`` url and text.
    Script and style files are never fetched. A page without enough text is
    rendered if ``render`` holds; a failed or insufficient render falls back
    to the raw page.
    """
    todo = frontier.where(~urls.is_blocked_download(urls.pathname("url")))
    out = todo.join(pages.select("url", "html"), "url", "left")
    if markdown is not None:
        sources = markdown.where(~is_blank("text")).groupBy(F.col("url").alias("candidate")).agg(F.min("text").alias("md"))
        out = out.withColumn("candidate", urls.markdown_candidate("url")).join(sources, "candidate", "left").drop("candidate")
    else:
        out = out.withColumn("md", F.lit(None).cast("string"))
    out = out.join(rendered.select("url", F.col("html").alias("live")), "url", "left") if rendered is not None else out.withColumn("live", F.lit(None).cast("string"))
    enough = F.coalesce(tx.has_meaningful_text("html", least_text), F.lit(False))
    live = F.coalesce(tx.has_meaningful_text("live", least_text), F.lit(False)) & F.lit(render)
    source = F.when(F.col("md").isNotNull(), "markdown").when(~enough & live, "rendered").when(F.col("html").isNotNull(), "html").otherwise("missing")
    return out.withColumn("source", source).select("url", "source", F.expr("case source when 'markdown' then md when 'rendered' then live else html end").alias("content"))


def is_blank(markdown) -> Column:
    """Whether a Markdown source counts as unavailable."""
    return F.coalesce(F.trim(F.regexp_replace(markdown, r"\s+", " ")), F.lit("")) == ""


def needs_render(html, markdown, render: bool = True, least: int = 200) -> Column:
    """Whether a page is to be rendered: it, or the Markdown made of it, has not enough text."""
    thin = ~F.coalesce(tx.has_meaningful_text(html, least), F.lit(False)) | F.coalesce(tx.is_markdown_too_short(markdown, least), F.lit(True))
    return F.lit(render) & thin


class StatusError(OSError):
    """The server answered, and not with success."""


def http_get(url: str, timeout_ms: int, user_agent: str, accept: str | None = None) -> str:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    headers = {"User-Agent": user_agent} | ({"Accept": accept} if accept else {})
    try:
        with urlopen(Request(url, headers=headers), timeout=timeout_ms / 1000) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        raise StatusError(f"HTTP {e.code} {e.reason}") from e


def with_retries(get: Callable[[], str], retries: int) -> tuple[str | None, str | None]:
    """(content, None), or (None, the last error) after retries + 1 attempts."""
    error = None
    for _ in range(retries + 1):
        try:
            return get(), None
        except Exception as e:  # any failure counts as one attempt
            error = str(e) or type(e).__name__
    return None, error


def over_http(frontier: DataFrame, timeout_ms: int = 15_000, retries: int = 2, user_agent: str = "tidewell", get: Callable[[str], str] | None = None) -> DataFrame:
    """(url) -> url, content, error. ``get`` replaces the network, for one."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                one = (lambda u=url: get(u)) if get else (lambda u=url: http_get(u, timeout_ms, user_agent))
                rows.append(with_retries(one, retries))
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["url", "content", "error"])

    plain = frontier.where(~urls.is_blocked_download(urls.pathname("url"))).select("url")
    return plain.mapInArrow(fetch, "url string, content string, error string")


def live(frontier: DataFrame, timeout_ms: int = 15_000, retries: int = 2, user_agent: str = "tidewell", get: Callable[[str, str | None], str] | None = None) -> DataFrame:
    """(url, delay_ms) -> url, source, content, error over HTTP, the Markdown source first.

    A Markdown source that the server refuses, or that is blank, gives way to
    the page at once; failures of the network are tried again. Requests to an
    origin are at least its delay apart, each attempt at a source counts as
    one; so an origin is asked by one task, others side by side. Script and
    style files are never fetched. ``get`` (url, accept) replaces the network.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}
        ask = get or (lambda url, accept: http_get(url, timeout_ms, user_agent, accept))

        def attempt(one: Callable[[], str | None], origin: str, delay_ms: int) -> tuple[str | None, str | None]:
            time.sleep(max(0.0, free.get(origin, 0.0) - time.monotonic()))
            free[origin] = time.monotonic() + max(delay_ms or 0, 0) / 1000
            return with_retries(one, retries)

        def markdown(url: str) -> str | None:
            try:
                return ask(url, MARKDOWN_ACCEPT)
            except StatusError:
                return None

        for b in batches:
            rows = []
            for url, candidate, origin, delay in zip(*(b.column(c).to_pylist() for c in ("url", "candidate", "origin", "delay_ms")), strict=True):
                md, _ = attempt(lambda u=candidate: markdown(u), origin, delay)
                if (md or "").strip():
                    rows.append((url, "markdown", md, None))
                    continue
                page, error = attempt(lambda u=url: ask(u, None), origin, delay)
                rows.append((url, "missing" if page is None else "html", page, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["url", "source", "content", "error"])

    todo = frontier.where(~urls.is_blocked_download(urls.pathname("url"))).select("url", F.col("delay_ms").cast("long").alias("delay_ms"), urls.markdown_candidate("url").alias("candidate"), urls.origin("url").alias("origin"))
    return todo.repartition("origin").sortWithinPartitions("origin", "url").mapInArrow(fetch, "url string, source string, content string, error string")


def rendered(fetched: DataFrame, renderer: Callable[[str], str], least_text: int = 200) -> DataFrame:
    """``live``'s rows, pages without enough text as ``renderer`` (url -> html) gives them.

    A render that fails or has not enough text either leaves the page as it was.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [with_retries(lambda u=u: renderer(u), 0)[0] for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "shown"])

    bare = F.coalesce((F.col("source") == "html") & ~tx.has_meaningful_text("content", least_text), F.lit(False))
    tried = fetched.where(bare).mapInArrow(render, "url string, source string, content string, error string, shown string")
    better = F.coalesce(tx.has_meaningful_text("shown", least_text), F.lit(False))
    shown = tried.select("url", F.when(better, "rendered").otherwise(F.col("source")).alias("source"), F.when(better, F.col("shown")).otherwise(F.col("content")).alias("content"), "error")
    return fetched.where(~bare).unionByName(shown)
