"""Links of HTML pages, and joins of links to known pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls

ANCHOR = r"<a\s[^>]*?href=\"([^\"]*)\""


def base_url(html, url) -> Column:
    """The page's ``base`` element resolved, else its own URL (plain references)."""
    raw = F.regexp_extract(html, r"(?i)<base\s[^>]*?href=[\"']([^\"']*)[\"']", 1)
    return F.when(raw == "", url).otherwise(F.coalesce(urls.resolve_plain(raw, url), url))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, html) -> url, pos, href, target: links within the page's origin.

    Native form for double-quoted plain references; pages, fragments and
    queries are normalised away, paths percent-encoded and files that hold no
    page left out.
    """
    found = pages.select("url", "html", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "href")).where("href <> ''")
    target = urls.percent_encoded(urls.normalize_for_queue(urls.resolve_plain(F.col("href"), F.col("url"))))
    out = found.select("url", "pos", "href", target.alias("target"))
    return out.where((urls.origin("target") == urls.origin("url")) & urls.is_html_candidate(urls.pathname("target")))


def distinct_links(links: DataFrame) -> DataFrame:
    """url, target, first place of each link of a page."""
    return links.groupBy("url", "target").agg(F.min("pos").alias("pos"))


def existing(links: DataFrame, known: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``links`` plus found: whether the target is known or hinted."""
    keys = known.select(F.col("url").alias("target"))
    if hints is not None:
        keys = keys.union(hints.select(F.col("url").alias("target")))
    return links.join(keys.distinct().withColumn("found", F.lit(True)), "target", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def known_only(links: DataFrame, known: DataFrame) -> DataFrame:
    return links.join(known.select(F.col("url").alias("target")), "target", "left_semi")


def new_only(links: DataFrame, known: DataFrame) -> DataFrame:
    return links.join(known.select(F.col("url").alias("target")), "target", "left_anti")
