"""Queries of single rewriting steps, render decisions, saved folders, and a crawl of recorded responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import crawl, html, markdown, rewrite, schedule
from tidewell.operators import links as lk
from tidewell.plans import commands
from tidewell.plans.catalog import query, table
from tidewell.plans.q_documents import md
from tidewell.plans.q_html import _BODY, _HEAD, _MARKDOWN, _PAGE, FETCHED
from tidewell.plans.q_schedule import _JOBS, jobs
from tidewell.plans.q_urls import s_dir, s_norm, s_text_length
from tidewell.sources import corpus, fetch

_NL = "chr(10)"

# ---- the steps of rewriting, each on its own kind of link: to the next page, to an unknown one, to another site

_NEXT = f"""p AS (SELECT page_id, {s_norm('url')} AS url FROM pages), n AS (SELECT p.page_id, p.url, q.url AS nxt FROM p LEFT JOIN p q ON q.page_id = p.page_id + 1),
    d AS (SELECT *, string_split({s_dir('url')}, '/') AS a, string_split({s_dir("coalesce(nxt, 'https://none.example.org/none')")} || '/page.md', '/') AS b FROM n),
    c AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) AS k FROM d),
    r AS (SELECT page_id, url, coalesce(nxt, 'https://none.example.org/none') AS nxt, nxt IS NOT NULL AS known, repeat('../', CAST(len(a) - k AS INTEGER)) || array_to_string(b[k + 1:], '/') AS rel FROM c)"""


def linked_pages(spark, sf_dir):
    """page_id, url, nxt: every page with the one of the next number, an unknown one for the last."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.normalize_for_queue("url").alias("url"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("nxt"))
    return p.join(after, "page_id", "left").withColumn("nxt", F.coalesce("nxt", F.lit("https://none.example.org/none")))


def _number():
    return F.col("page_id").cast("string")


def _rewritten(spark, sf_dir, *parts):
    pages = linked_pages(spark, sf_dir)
    docs = pages.withColumn("markdown", F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)))
    return rewrite.rewrite(docs, pages.select("url")).select("page_id", "markdown")


@query(
    f"""WITH {_NEXT} SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[a ' || page_id || CASE WHEN known THEN '](' || rel || '#x "t")' ELSE ' ↗](' || nxt || '#x "t")' END WHEN 1 THEN '[b' || CASE WHEN known THEN '](<' || rel || '>)' ELSE ' ↗](<' || nxt || '>)' END
    WHEN 2 THEN '![i](' || nxt || ') [c ↗](https://away.example.org/' || page_id || ')' ELSE '[d](#top) [e](mailto:x@y.zz) [f ↗](//else.example.org/)' END || ' end' AS markdown FROM r"""
)
def rewrite_inline_links(spark, sf_dir):
    k = F.col("page_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("[a "), _number(), F.lit(" ↗]("), "nxt", F.lit('#x "t")')))
        .when(k == 1, F.concat(F.lit("[b](<"), "nxt", F.lit(">)")))
        .when(k == 2, F.concat(F.lit("![i]("), "nxt", F.lit(") [c](https://away.example.org/"), _number(), F.lit(")")))
        .otherwise(F.lit("[d ↗ ](#top) [e](mailto:x@y.zz) [f ↗](//else.example.org/)"))
    )
    return _rewritten(spark, sf_dir, text, " end")


@query(f"WITH {_NEXT} SELECT page_id, '[n]: ' || CASE WHEN known THEN rel ELSE nxt END || ' \"title ' || page_id || '\"' || {_NL} || '  [w]: <' || CASE WHEN known THEN rel || '#s' ELSE nxt || '#s' END || '>' || {_NL} || '[o]: https://away.example.org/' || page_id AS markdown FROM r")
def rewrite_reference_links(spark, sf_dir):
    return _rewritten(spark, sf_dir, "[n]: ", F.col("nxt"), ' "title ', _number(), '"\n  [w]: <', F.col("nxt"), "#s>\n[o]: https://away.example.org/", _number())


@query(
    f"""WITH {_NEXT}, t AS (SELECT *, CASE WHEN known THEN rel ELSE nxt END AS x FROM r)
    SELECT page_id, '<Card href="' || x || '"> <a href=''' || x || '''> <L href={{"' || x || '"}}> <L href={{go}}> <a href="https://away.example.org/' || page_id || '">' AS markdown FROM t"""
)
def rewrite_attribute_links(spark, sf_dir):
    n = F.col("nxt")
    return _rewritten(spark, sf_dir, '<Card href="', n, "\"> <a href='", n, "'> <L href={\"", n, '"}> <L href={go}> <a href="https://away.example.org/', _number(), '">')


@query(
    f"""WITH {_NEXT}, t AS (SELECT *, CASE WHEN known THEN '[' || nxt || '](' || rel || ')' ELSE nxt END AS x FROM r)
    SELECT page_id, 'see ' || x || ', (' || x || ') `' || nxt || '` <' || nxt || '> https://away.example.org/' || page_id || '.' || {_NL} || '~~~' || {_NL} || nxt || {_NL} || '```' || {_NL} || nxt || {_NL} || '~~~' || {_NL} || x || '!' AS markdown FROM t"""
)
def rewrite_bare_links(spark, sf_dir):
    n = F.col("nxt")
    return _rewritten(spark, sf_dir, "see ", n, ", (", n, ") `", n, "` <", n, "> https://away.example.org/", _number(), ".\n~~~\n", n, "\n```\n", n, "\n~~~\n", n, "!")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN regexp_extract('---' || {_NL} || 'Source: https://h.com/' || doc_id || {_NL} || 'Fetched: x' || {_NL} || '---' || {_NL} || {_NL} || text, '^(---\\s*\\n(?s:.*?)\\n---\\s*\\n)', 1) ELSE '' END AS front FROM documents"""
)
def rewrite_frontmatter(spark, sf_dir):
    docs = md(spark, sf_dir).select("doc_id", F.concat(F.lit("https://h.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("m").alias("markdown"))
    return rewrite.rewrite(docs, docs.select("url").where("false")).select("doc_id", markdown.frontmatter("markdown").alias("front"))


# ---- sources

#: The whole page as Markdown, its frontmatter, and how short it may be.
_THIN = 1500


@query(f"WITH {_PAGE}, m AS (SELECT page_id, html, {_MARKDOWN} AS md FROM page) SELECT page_id, {s_text_length('html')} <= {_THIN} OR length(md) < {_THIN} AS needs_render FROM m")
def render_decision(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    made = F.concat(F.lit("---\nSource: x\n---\n\n"), html.html_to_markdown("html"), F.lit("\n"))
    return p.select("page_id", fetch.needs_render(F.col("html"), made, True, _THIN).alias("needs_render"))


@query("SELECT doc_id, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(10) || chr(9) ELSE '' END, '\\s+', ' ', 'g')) = '' AS unavailable FROM documents")
def markdown_unavailable(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.col("text")).when(k == 1, F.lit(" \n\t")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", fetch.is_blank(text).alias("unavailable"))


def _saved(spark, sf_dir):
    """Pages written as files below a new shared folder, the least page of each path; its name."""
    p = table(spark, sf_dir, "pages")
    text = lambda kind: F.concat(F.lit(kind + " "), "url")
    docs = p.select("url", text("page").alias("markdown"), text("clutter").alias("clutter_markdown"), text("llms").alias("llms_markdown"), text("llms_full").alias("llms_full_markdown"))
    at = f"{crawl.shared_dir(spark).removeprefix('file:')}/saved-{uuid.uuid4().hex}"
    corpus.write_files(corpus.page_files(docs, at, clutter=True, overwrite_llms=True)).count()
    return at


_FILES = f"r AS (SELECT min(url) AS url, {s_dir('url')} AS dir FROM pages GROUP BY 2)"


@query(f"WITH {_FILES} SELECT dir || '/' || file AS path, kind || ' ' || url AS content FROM r, (VALUES ('page', 'page.md'), ('llms', '.llms.md'), ('llms_full', 'llms-full.md')) k(kind, file)")
def saved_files_for_find(spark, sf_dir):
    return corpus.read_tree(spark, _saved(spark, sf_dir))


@query(f"WITH {_FILES} SELECT dir || '/' || file AS path, kind || ' ' || url AS content FROM r, (VALUES ('page', 'page.md'), ('clutter', '.clutter.md'), ('llms', '.llms.md'), ('llms_full', 'llms-full.md')) k(kind, file)")
def saved_files_for_links(spark, sf_dir):
    return corpus.read_tree(spark, _saved(spark, sf_dir), for_links=True)


@query(
    f"""WITH least AS (SELECT min(page_id) AS page_id, {s_norm('url')} AS url, min(html) AS html FROM pages GROUP BY 2), {_PAGE.replace('FROM pages)', 'FROM least)')}
    SELECT url, {_HEAD} || {_BODY} AS markdown FROM page"""
)
def scrape_list(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    wanted = p.select("url").unionByName(spark.createDataFrame([("not a url",), ("https://missing.example.org/x",), ("ftp://x/y.css",)], "url string"))
    return commands.scrape_urls(p, wanted, FETCHED).select("url", "markdown")


# ---- a crawl of recorded responses: pages of one site that link to one another, some as Markdown, some forbidden

_SITE = "https://site.example.com"
_DEPTH, _MOST = 4, 60
_AT = "'" + _SITE + "/d' || ({0} % 7) || '/p' || {0}"
_RECORDED = f"""n AS (SELECT count(*) AS n FROM pages), i AS (SELECT page_id AS i, n FROM pages, n), e AS (SELECT i AS u, unnest([(i * 2 + 1) % n, (i * 3 + 2) % n, (i + 7) % n]) AS v FROM i), ok AS (SELECT i FROM i WHERE i % 7 <> 3),
    b(i, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.v, b.depth + 1 FROM b JOIN e ON e.u = b.i JOIN ok ON ok.i = e.v WHERE b.depth < {_DEPTH}), f AS (SELECT i, min(depth) AS depth, {_AT.format('i')} AS url FROM b GROUP BY i),
    saved AS (SELECT * FROM f ORDER BY depth, url LIMIT {_MOST})"""


def recorded(spark, sf_dir):
    """(url, html) responses and (url, text) Markdown sources of a site of as many pages as there are."""
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.count()
    at = lambda i: F.concat(F.lit("/d"), (i % 7).cast("string"), F.lit("/p"), i.cast("string"))
    i = F.col("page_id")
    to = [at((i * 2 + 1) % n), at((i * 3 + 2) % n), at((i + 7) % n)]
    page = F.concat(F.lit("<html><head><title>T</title></head><body><main><p>"), F.repeat(F.lit("words "), F.lit(50)), F.lit("</p><p>"), *(F.concat(F.lit('<a href="'), t, F.lit('">n</a> ')) for t in to), F.lit('<a href="/logo.png">x</a></p></main></body></html>'))
    text = F.concat(F.lit("# T\n\n"), *(F.concat(F.lit("[n]("), t, F.lit(") ")) for t in to))
    site = p.select("page_id", F.concat(F.lit(_SITE), at(i)).alias("url"), page.alias("html"), text.alias("text"))
    return site.select("url", "html"), site.where("page_id % 3 = 0").select(urls.markdown_candidate("url").alias("url"), "text")


@query(f"WITH RECURSIVE {_RECORDED} SELECT url, (SELECT count(*) FROM e JOIN saved t ON t.i = e.v WHERE e.u = saved.i) AS n_relative FROM saved")
def crawl_recorded_site(spark, sf_dir):
    pages, sources = recorded(spark, sf_dir)
    robots = spark.createDataFrame([(_SITE, "User-agent: *\nDisallow: /d3\n")], "origin string, text string")
    docs = commands.crawl_site(pages, f"{_SITE}/", "x", _DEPTH, _MOST, robots, markdown_sources=sources, seeds=f"{_SITE}/d0/p0")
    return docs.select("url", F.regexp_count("markdown", F.lit(r"\]\([^)]*page\.md\)")).cast("bigint").alias("n_relative"))


# ---- scheduling


@query(
    f"""WITH {_JOBS}, t AS (SELECT job_id, arg_min(outcome, seq) FILTER (worker_type = 'markdown') AS md, arg_min(outcome, seq) FILTER (worker_type = 'hybrid') AS html, count(*) AS attempts FROM jobs GROUP BY job_id)
    SELECT job_id, CASE WHEN md = 'markdownUnavailable' THEN 'hybrid' ELSE 'markdown' END AS stage, coalesce(CASE WHEN md = 'markdownUnavailable' THEN html ELSE md END, 'pending') AS outcome, attempts FROM t"""
)
def two_stage_queue(spark, sf_dir):
    return schedule.stage_hops(jobs(spark, sf_dir))


@query(f"WITH {_JOBS}, m AS (SELECT max(now_ms) AS now FROM jobs) SELECT job_id AS worker, max(now_ms) AS last_ms, max(m.now) - max(now_ms) >= 45000 AS exits FROM jobs, m GROUP BY job_id")
def idle_workers(spark, sf_dir):
    e = jobs(spark, sf_dir)
    now = e.agg(F.max("now_ms")).first()[0] or 0
    return schedule.idle_workers(e.select(F.col("job_id").alias("worker"), "now_ms"), now)


@query(
    f"""WITH {_JOBS}, f AS (SELECT outcome AS error, origin || '/' || seq AS url FROM jobs WHERE outcome <> 'completed'), u AS (SELECT error, url, row_number() OVER (PARTITION BY error ORDER BY url) AS k FROM (SELECT DISTINCT error, url FROM f)),
    n AS (SELECT error, count(*) AS n FROM f GROUP BY error) SELECT error, n, string_agg(url, ' ' ORDER BY url) AS urls FROM n JOIN u USING (error) WHERE k <= 3 GROUP BY error, n"""
)
def failure_summary(spark, sf_dir):
    rows = jobs(spark, sf_dir).select(F.concat("origin", F.lit("/"), F.col("seq").cast("string")).alias("url"), F.when(F.col("outcome") != "completed", F.col("outcome")).alias("error"))
    return schedule.failure_summary(rows).withColumn("urls", F.array_join("urls", " "))


@query(f"WITH {_JOBS} SELECT seq, coalesce(sum(CASE WHEN outcome = 'completed' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 100 AS stops FROM jobs")
def graceful_stop(spark, sf_dir):
    return schedule.stopped(jobs(spark, sf_dir).select("seq", "outcome"), 100).select("seq", "stops")


# ---- bases, Source values, rule paths, and look-ups at dispatch


@query(
    f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/deep/' WHEN 1 THEN 'https://b.example.org/x/' WHEN 2 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//c.example.org/y'
    WHEN 3 THEN 'https://d.example.org/' ELSE url END AS base FROM pages"""
)
def document_bases(spark, sf_dir):
    k = F.col("page_id") % 5
    tag = F.when(k == 0, F.lit('<base href="/deep/">')).when(k == 1, F.lit("<BASE target=x href='https://b.example.org/x/'><base href=\"/no/\">")).when(k == 2, F.lit('<base href="//c.example.org/y">')).when(k == 3, F.lit('<base id="i" href="https://d.example.org">')).otherwise(F.lit("<p>"))
    return table(spark, sf_dir, "pages").select("page_id", lk.base_url(F.concat(tag, "html"), F.col("url")).alias("base"))


@query(
    """WITH v AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '<' || url || '> ↗' WHEN 2 THEN '[' || url || '](page.md)' WHEN 3 THEN '[label](' || url || ') ↗ ' WHEN 4 THEN '[label ' || page_id || '](page.md)' ELSE '  ↗' END AS raw FROM pages)
    SELECT page_id, raw, CASE WHEN contains(raw, url) THEN url WHEN page_id % 6 = 4 THEN 'label ' || page_id END AS value FROM v"""
)
def source_values(spark, sf_dir):
    k, u = F.col("page_id") % 6, F.col("url")
    raw = (
        F.when(k == 0, u)
        .when(k == 1, F.concat(F.lit("<"), u, F.lit("> ↗")))
        .when(k == 2, F.concat(F.lit("["), u, F.lit("](page.md)")))
        .when(k == 3, F.concat(F.lit("[label]("), u, F.lit(") ↗ ")))
        .when(k == 4, F.concat(F.lit("[label "), _number(), F.lit("](page.md)")))
        .otherwise(F.lit("  ↗"))
    )
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), urls.normalize_source_value(raw).alias("value"))


@query("SELECT page_id, regexp_replace(CASE WHEN page_id % 2 = 0 THEN url ELSE '/' || url END, '^/?', '/') AS rule FROM pages")
def robots_rule_paths(spark, sf_dir):
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/"), "url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_rule_path(raw).alias("rule"))


@query(f"WITH {_JOBS} SELECT seq, origin FROM jobs WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE outcome = 'failed' AND links_discovered IS NOT NULL)")
def dispatch_unvisited(spark, sf_dir):
    e = jobs(spark, sf_dir)
    visited = e.where("outcome = 'failed' and links_discovered is not null").select(F.col("job_id").alias("url")).distinct()
    return lk.new_only(e.withColumn("target", F.col("job_id")), visited).select("seq", "origin")


@query(f"WITH {_JOBS}, j AS (SELECT DISTINCT job_id, origin FROM jobs WHERE job_id % 3 = 0) SELECT seq, job_id, type, j.origin AS job_origin FROM jobs JOIN j USING (job_id)")
def job_lookup(spark, sf_dir):
    e = jobs(spark, sf_dir)
    known = e.where("job_id % 3 = 0").select("job_id", F.col("origin").alias("job_origin"))
    return schedule.with_job(e.select("seq", "job_id", "type"), known)
