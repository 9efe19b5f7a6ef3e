"""What the commands do, as DataFrame plans."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import fields
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import crawl, html, linkcheck, markdown, rewrite, robots, schedule, search
from tidewell.options import CrawlOptions
from tidewell.sources import corpus, fetch


def scrape(frontier: DataFrame, fetched: DataFrame, fetched_at: str, scope: str = "/") -> DataFrame:
    """url and (url, source, content) -> url and the four documents, links not rewritten."""
    got = frontier.join(fetched, "url").where("content is not null and source <> 'missing'")
    at = F.lit(fetched_at)
    md = markdown.extract_markdown("content", "url", at)
    from_md = got.where("source = 'markdown'").select("url", md.alias("markdown"), F.lit("").alias("clutter_markdown"), md.alias("llms_markdown"), md.alias("llms_full_markdown"))
    parsed = got.where("source <> 'markdown'").select("url", html.extract_content(F.col("content"), F.col("url"), at, F.lit(scope)).alias("d"))
    return from_md.unionByName(parsed.select("url", "d.markdown", "d.clutter_markdown", "d.llms_markdown", "d.llms_full_markdown"))


def crawl_site(pages: DataFrame, start: str, fetched_at: str, max_depth: int = 4, max_pages: int = 6000, robots_txt: DataFrame | None = None, user_agent: str = "*", render: bool = True, markdown_sources: DataFrame | None = None, seeds: str | None = None) -> DataFrame:
    """Breadth-first crawl of a snapshot from ``start``, which also is its scope; links to saved pages relative.

    ``seeds`` is where it begins if that is not ``start``.
    """
    spark = pages.sparkSession
    begin = spark.createDataFrame([(urls.canonical_url(start),)], "url string")
    scope = begin.select(urls.pathname(urls.normalize_for_queue("url"))).first()[0]
    origin = begin.select(urls.origin("url")).first()[0]
    known = pages.withColumn("url", urls.normalize_for_queue("url")).groupBy("url").agg(F.min("html").alias("html")).where((urls.origin("url") == origin) & urls.is_path_in_scope(urls.pathname("url"), F.lit(scope)))
    if robots_txt is not None:
        rules = robots.rules_for(robots.parse(robots_txt), user_agent)
        known = robots.allowed(known.withColumns({"origin": urls.origin("url"), "path": urls.pathname("url")}), rules).where("allowed").drop("origin", "path", "allowed")
    fetched = crawl.staged(fetch.from_snapshot(known.select("url"), known, markdown_sources, render=render))
    docs = crawl.staged(scrape(known.select("url"), fetched, fetched_at, scope))
    links = crawl.staged(_links(fetched, origin, scope))
    first = begin if seeds is None else spark.createDataFrame([(urls.canonical_url(seeds),)], "url string")
    saved = crawl.bfs(first.select(urls.normalize_for_queue("url").alias("url")), links, max_depth, max_pages, docs)
    return _relinked(docs, saved, scope)


def _links(fetched: DataFrame, origin: str, scope: str) -> DataFrame:
    """(url, target) links of fetched pages within an origin and scope."""
    from_html = fetched.where("source in ('html', 'rendered')").select("url", html.content_links(F.col("content"), F.col("url"), F.lit(scope)).alias("links"))
    from_md = fetched.where("source = 'markdown'").select("url", rewrite.markdown_links(F.col("content"), F.col("url"), F.lit(origin), F.lit(scope)).alias("links"))
    return from_html.unionByName(from_md).select("url", F.explode("links").alias("target"))


def _relinked(docs: DataFrame, saved: DataFrame, scope: str) -> DataFrame:
    """The saved documents, with links to one another relative."""
    out = docs.join(saved, "url").withColumn("scope", F.lit(scope))
    out = rewrite.rewrite(out, saved, "markdown", "clutter_markdown", "llms_full_markdown")
    return out.withColumn("llms_markdown", F.col("markdown"))


def crawl_live(spark: SparkSession, start: str, fetched_at: str, options: CrawlOptions, get: Callable[[str, str | None], str] | None = None, renderer: Callable[[str], str] | None = None) -> DataFrame:
    """``crawl_site`` over HTTP: a level is fetched, written out, and its links make the next one.

    Pages that cannot be fetched use no budget: while some is left, more of
    the level's pages take their place. Without a readable robots.txt all
    pages are allowed.
    """
    how = {"timeout_ms": options.timeout_ms, "retries": options.retries, "user_agent": options.user_agent, "get": get}
    first = urls.canonical_url(start)
    begin = spark.createDataFrame([(first,)], "url string").select(urls.normalize_for_queue("url").alias("url"), urls.origin("url").alias("origin"), urls.pathname(urls.normalize_for_queue("url")).alias("scope"))
    origin, scope = begin.select("origin", "scope").first()
    rules, delay = None, options.delay_ms
    if options.respect_robots:
        plain = None if get is None else (lambda url: get(url, None))
        txt = fetch.over_http(begin.select(F.concat("origin", F.lit("/robots.txt")).alias("url")), **how | {"get": plain}).where("content is not null")
        parsed = crawl.staged(robots.parse(txt.select(F.lit(origin).alias("origin"), F.col("content").alias("text"))))
        rules = robots.rules_for(parsed, options.user_agent)
        asked = robots.select_agent(parsed, options.user_agent)
        own = begin.join(asked, "origin", "left").select(schedule.effective_delay(F.lit(float(options.delay_ms)), F.col("crawl_delay_ms")))
        delay = int(own.first()[0])

    pending = seen = crawl.staged(begin.select("url"))
    levels, saved, depth = None, 0, 0
    while True:
        left = pending
        if rules is not None:
            left = crawl.staged(robots.allowed(left.withColumns({"origin": urls.origin("url"), "path": urls.pathname("url")}), rules).where("allowed").select("url"))
        level = None
        while (room := options.max_pages - saved) > 0:
            asked = left.orderBy("url").limit(room).withColumn("delay_ms", F.lit(delay))
            got = fetch.live(asked, **how)
            got = crawl.staged((fetch.rendered(got, renderer) if options.render and renderer else got).withColumn("depth", F.lit(depth)))
            level = got if level is None else level.unionByName(got)
            n, fine = got.agg(F.count("*"), F.count_if(F.col("source") != "missing")).first()
            saved += fine
            if n < room:
                break
            left = crawl.staged(left.join(got.select("url"), "url", "left_anti"))
        if level is None:
            break
        levels = level if levels is None else levels.unionByName(level)
        if depth == options.max_depth or saved >= options.max_pages:
            break
        fresh = _links(level, origin, scope).select(F.col("target").alias("url")).distinct()
        pending = crawl.staged(fresh.join(seen, "url", "left_anti"))
        if pending.isEmpty():
            break
        seen = seen.unionByName(pending)
        depth += 1
    kept = levels.where("source <> 'missing'")
    docs = crawl.staged(scrape(kept.select("url"), kept, fetched_at, scope))
    return _relinked(docs, kept.select("url", "depth"), scope)


def _wanted(wanted: DataFrame) -> DataFrame:
    return wanted.select(urls.normalize_for_queue(urls.canonical("url", F.lit(None).cast("string"))).alias("url")).where("url is not null").distinct()


def scrape_urls(pages: DataFrame, wanted: DataFrame, fetched_at: str) -> DataFrame:
    """Documents of a list of URLs, without robots or expansion; invalid URLs are left out."""
    todo = _wanted(wanted)
    known = pages.withColumn("url", urls.normalize_for_queue("url")).groupBy("url").agg(F.min("html").alias("html"))
    return rewrite.rewrite(scrape(todo, fetch.from_snapshot(todo, known), fetched_at), todo)


def scrape_one(pages: DataFrame, url: str, fetched_at: str, markdown_sources: DataFrame | None = None, render: bool = True) -> DataFrame:
    """One page's documents as they are fetched, and links: the pages it leads to below its own path."""
    todo = _wanted(pages.sparkSession.createDataFrame([(url,)], "url string"))
    at = urlsplit(urls.canonical_url(url) or "")
    known = pages.withColumn("url", urls.normalize_for_queue("url")).groupBy("url").agg(F.min("html").alias("html"))
    fetched = fetch.from_snapshot(todo, known, markdown_sources, render=render)
    docs = scrape(todo, fetched, fetched_at, at.path)
    links = _links(fetched, f"{at.scheme}://{at.netloc}", at.path).groupBy("url").agg(F.array_sort(F.collect_set("target")).alias("links"))
    return docs.join(links, "url", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def scrape_live(wanted: DataFrame, fetched_at: str, options: CrawlOptions, get: Callable[[str, str | None], str] | None = None) -> DataFrame:
    """``scrape_urls`` over HTTP."""
    todo = _wanted(wanted)
    got = crawl.staged(fetch.live(todo.withColumn("delay_ms", F.lit(options.delay_ms)), options.timeout_ms, options.retries, options.user_agent, get))
    return rewrite.rewrite(scrape(todo, got, fetched_at), todo)


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(args: argparse.Namespace) -> int:
    spark = _session()
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    if args.command in ("find", "link-check"):
        if not os.path.isdir(args.directory):
            print(f"no such folder: {args.directory}", file=sys.stderr)
            return 1
        files = corpus.read_tree(spark, args.directory, for_links=args.command == "link-check")
        if args.command == "find":
            hits = search.find(files, args.query, args.limit, args.context_lines, args.files_only, args.content_only).collect()
            for r in hits:
                print(f"{r['score']:g}\t{r['match_type']}\t{r['path']}")
            if not hits:
                print("nothing found")
            return 0
        checked = linkcheck.link_check(files.withColumnRenamed("path", "file_path"))
        changed = checked.where("changed").select(F.concat(F.lit(args.directory.rstrip("/") + "/"), "file_path").alias("path"), "content")
        print(f"updated {corpus.write_files(changed).count()} files")
        return 0
    options = CrawlOptions(**{f.name: getattr(args, f.name) for f in fields(CrawlOptions) if hasattr(args, f.name)})
    pages = spark.read.parquet(args.snapshot) if args.snapshot else None
    if args.command == "crawl":
        if pages is None:
            docs = crawl_live(spark, args.crawl_start, now, options)
        else:
            docs = crawl_site(pages, args.crawl_start, now, args.max_depth, args.max_pages, render=args.render)
    else:
        wanted = spark.createDataFrame([(args.url,)], "url string") if args.command == "url" else corpus.read_url_file(spark, args.urls_file, args.url)
        docs = scrape_live(wanted, now, options) if pages is None else scrape_urls(pages, wanted, now)
    written = corpus.write_files(corpus.page_files(docs, args.out_dir, args.clutter, args.overwrite_llms))
    print(f"wrote {written.count()} files")
    return 0
