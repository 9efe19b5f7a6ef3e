"""Queries of links, joins against known pages, robots rules and saved files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import html, linkcheck, rewrite, robots
from tidewell.operators import links as lk
from tidewell.plans.catalog import query, sql_text, table
from tidewell.plans.q_urls import s_dir, s_encoded, s_norm, s_origin, s_path
from tidewell.sources import corpus, fetch

_RESOLVED = f"""CASE WHEN regexp_matches(href, '^https?://[^/?#]+$') THEN href || '/' WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href
    WHEN href LIKE '/%' THEN {s_origin('url')} || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href WHEN href LIKE '?%' THEN {s_origin('url')} || {s_path('url')} || href END"""
_LINKS = f"""a AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages), h AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM a),
    r AS (SELECT page_id, url, pos, href, {s_encoded(s_norm(f'({_RESOLVED})'))} AS target FROM h WHERE href <> ''),
    links AS (SELECT * FROM r WHERE {s_origin('target')} = {s_origin('url')} AND NOT regexp_matches(lower({s_path('target')}), '\\.({urls.BLOCKED})$'))"""


def links_of(spark, sf_dir):
    return lk.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH {_LINKS} SELECT url, CAST(pos AS BIGINT) AS pos, href, target FROM links")
def page_links(spark, sf_dir):
    return links_of(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {_LINKS} SELECT url, target, CAST(min(pos) AS BIGINT) AS pos FROM links GROUP BY url, target")
def page_links_distinct(spark, sf_dir):
    return lk.distinct_links(links_of(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {_LINKS} SELECT target, count(DISTINCT url) AS n_pages, count(*) AS n_links FROM links GROUP BY target")
def inlink_counts(spark, sf_dir):
    per = links_of(spark, sf_dir).groupBy("target", "url").agg(F.count("*").alias("n"))
    return per.groupBy("target").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_links"))


@query(f"WITH {_LINKS} SELECT {s_origin('url')} AS origin, count(DISTINCT target) AS n_targets, count(*) AS n_links FROM links GROUP BY 1")
def links_per_host(spark, sf_dir):
    return links_of(spark, sf_dir).groupBy(urls.origin("url").alias("origin")).agg(F.count_distinct("target").alias("n_targets"), F.count("*").alias("n_links"))


_KNOWN = "known AS (SELECT DISTINCT target AS u FROM links WHERE length(target) % 2 = 0)"


def _known(links):
    return links.where(F.length("target") % 2 == 0).select(F.col("target").alias("url")).distinct()


@query(f"WITH {_LINKS}, {_KNOWN} SELECT url, CAST(pos AS BIGINT) AS pos, target FROM links WHERE target IN (SELECT u FROM known)")
def known_semi_join(spark, sf_dir):
    links = links_of(spark, sf_dir)
    return lk.known_only(links, _known(links)).select("url", F.col("pos").cast("bigint").alias("pos"), "target")


@query(f"WITH {_LINKS}, {_KNOWN} SELECT url, CAST(pos AS BIGINT) AS pos, target FROM links WHERE target NOT IN (SELECT u FROM known)")
def new_links_anti_join(spark, sf_dir):
    links = links_of(spark, sf_dir)
    return lk.new_only(links, _known(links)).select("url", F.col("pos").cast("bigint").alias("pos"), "target")


@query(f"WITH {_LINKS}, {_KNOWN}, hints AS (SELECT DISTINCT target AS u FROM links WHERE pos = 0) SELECT url, CAST(pos AS BIGINT) AS pos, target, target IN (SELECT u FROM known) OR target IN (SELECT u FROM hints) AS found FROM links")
def link_existence(spark, sf_dir):
    links = links_of(spark, sf_dir)
    hints = links.where("pos = 0").select(F.col("target").alias("url"))
    return lk.existing(links, _known(links), hints).select("url", F.col("pos").cast("bigint").alias("pos"), "target", "found")


# ---- robots

ROBOTS = "# rules\nDisallow: /early\nUser-agent: *\nDisallow: /fr\nAllow: /fr/8 # but these\nCrawl-delay: 2\nUser-agent: other\nUser-agent: MyBot\nDisallow: en/1\nDisallow:\nAllow: /en/1\nDisallow: /de/3:x\nCrawl-delay: x\nCrawl-delay: 0.5s\n"
_ROBOTS = f"""texts AS (SELECT DISTINCT {s_origin('url')} AS origin, replace({sql_text(ROBOTS).replace(chr(10), '|')}, '|', chr(10)) AS text FROM pages),
    l AS (SELECT origin, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts),
    d AS (SELECT origin, pos, lower(trim(string_split(trim(regexp_replace(raw, '#.*$', '')), ':')[1])) AS dir, trim(coalesce(string_split(trim(regexp_replace(raw, '#.*$', '')), ':')[2], '')) AS val FROM l),
    f AS (SELECT *, coalesce(last_value(CASE WHEN dir = 'user-agent' THEN lower(val) END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY pos ROWS UNBOUNDED PRECEDING), '*') AS agent FROM d WHERE dir IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
    parsed AS (SELECT origin, pos, agent, CASE dir WHEN 'user-agent' THEN 'agent' WHEN 'crawl-delay' THEN 'delay' ELSE dir END AS kind, CASE WHEN dir = 'user-agent' THEN lower(val) WHEN dir IN ('allow', 'disallow') AND val NOT LIKE '/%' THEN '/' || val ELSE val END AS value FROM f WHERE dir = 'user-agent' OR val <> '')"""
_PICKED = """delays AS (SELECT *, CASE WHEN kind = 'delay' THEN TRY_CAST(nullif(regexp_extract(value, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE) * 1000 END AS ms FROM parsed),
    per AS (SELECT origin, agent, min(pos) AS pos, arg_max(ms, pos) FILTER (ms IS NOT NULL) AS delay, CASE WHEN agent = 'mybot/2.0' THEN 0 WHEN agent <> '*' AND contains('mybot/2.0', agent) THEN 1 WHEN agent = '*' THEN 2 END AS rank FROM delays GROUP BY origin, agent),
    picked AS (SELECT origin, agent, delay AS crawl_delay_ms FROM per WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY origin ORDER BY rank, pos) = 1)"""


def robots_of(spark, sf_dir):
    return robots.parse(table(spark, sf_dir, "pages").select(urls.origin("url").alias("origin")).distinct().withColumn("text", F.lit(ROBOTS)))


@query(f"WITH {_ROBOTS} SELECT origin, CAST(pos AS BIGINT) AS pos, agent, kind, value FROM parsed")
def robots_parse(spark, sf_dir):
    return robots_of(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {_ROBOTS}, {_PICKED} SELECT * FROM picked")
def robots_agent_select(spark, sf_dir):
    return robots.select_agent(robots_of(spark, sf_dir), "MyBot/2.0")


@query(
    f"""WITH {_ROBOTS}, {_PICKED}, rules AS (SELECT p.origin, p.kind, p.value AS rule FROM parsed p JOIN picked USING (origin, agent) WHERE p.kind IN ('allow', 'disallow')),
    best AS (SELECT page_id, max(length(rule)) FILTER (kind = 'allow') AS a, max(length(rule)) FILTER (kind = 'disallow') AS d FROM pages JOIN rules ON rules.origin = {s_origin('url')} AND starts_with({s_path('url')}, rule) GROUP BY page_id)
    SELECT page_id, {s_path('url')} AS path, coalesce(a, 0) >= coalesce(d, 0) AS allowed FROM pages LEFT JOIN best USING (page_id)"""
)
def robots_allowed(spark, sf_dir):
    rules = robots.rules_for(robots_of(spark, sf_dir), "MyBot/2.0")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.origin("url").alias("origin"), urls.pathname("url").alias("path"))
    return robots.allowed(pages, rules).select("page_id", "path", "allowed")


# ---- fetching, saving, checking

_LONG = "page_id % 3 = 0"


@query(
    f"""WITH t AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', '', 'g')) AS n FROM (SELECT {s_norm('url')} AS url, min(html) AS html, min(page_id) AS page_id FROM pages GROUP BY 1))
    SELECT url, CASE WHEN {_LONG} THEN 'markdown' WHEN n <= 1500 AND page_id % 2 = 0 THEN 'rendered' ELSE 'html' END AS source, CAST(CASE WHEN {_LONG} THEN 10 WHEN n <= 1500 AND page_id % 2 = 0 THEN 2000 ELSE length(html) END AS BIGINT) AS n_chars FROM t"""
)
def snapshot_fetch(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("url", urls.normalize_for_queue("url")).groupBy("url").agg(F.min("html").alias("html"), F.min("page_id").alias("page_id"))
    md = pages.where(_LONG).select(urls.markdown_candidate("url").alias("url"), F.lit("# Markdown").alias("text"))
    live = pages.where("page_id % 2 = 0").select("url", F.repeat(F.lit("x"), F.lit(2000)).alias("html"))
    got = fetch.from_snapshot(pages.select("url"), pages, md, live, least_text=1500)
    return got.select("url", "source", F.length("content").cast("bigint").alias("n_chars"))


@query(
    f"""WITH k(kind, file) AS (VALUES ('page', 'page.md'), ('clutter', '.clutter.md'), ('llms', '.llms.md'), ('llms_full', 'llms-full.md')),
    r AS (SELECT url, kind, '.docs/' || {s_dir('url')} || '/' || file AS path, kind || ' ' || url AS content FROM pages, k WHERE kind <> 'clutter' OR page_id % 2 = 0)
    SELECT arg_min(kind, url) AS kind, path, arg_min(content, url) AS content FROM r GROUP BY path"""
)
def unpivot_outputs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = lambda kind: F.concat(F.lit(kind + " "), "url")
    docs = p.select("url", text("page").alias("markdown"), F.when(F.col("page_id") % 2 == 0, text("clutter")).alias("clutter_markdown"), text("llms").alias("llms_markdown"), text("llms_full").alias("llms_full_markdown"))
    return corpus.page_files(docs, clutter=True, overwrite_llms=True)


@query(
    f"""WITH p AS (SELECT {s_origin('url')} AS origin, list_filter(string_split({s_path('url')}, '/'), lambda x: x <> '') AS s FROM pages),
    g AS (SELECT origin, min(s) AS lo, max(s) AS hi, count(*) AS n_paths FROM p GROUP BY origin),
    c AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(lo), len(hi))), lambda i: lo[i + 1] <> hi[i + 1])), least(len(lo), len(hi))) AS k FROM g)
    SELECT origin, '/' || array_to_string(lo[1:CASE WHEN n_paths = 1 THEN least(1, len(lo)) ELSE k END], '/') AS scope, n_paths FROM c"""
)
def scope_prefix_per_origin(spark, sf_dir):
    return linkcheck.scope_prefixes(table(spark, sf_dir, "pages").select(urls.origin("url").alias("origin"), urls.pathname("url").alias("pathname")))


def saved_docs(spark, sf_dir):
    """Pages as saved documents: each links to the page of the next number and to an unknown one, every third to none."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.normalize_for_queue("url").alias("url"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    text = F.concat(F.lit("---\nSource: "), "url", F.lit("\nFetched: x\n---\n\n# Page\n[next]("), F.coalesce("next", F.lit("/none")), F.lit("#part) and [away](https://away.example.org/x)\n"))
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("---\nSource: "), "url", F.lit("\nFetched: x\n---\n\n# Page\nno links\n"))).otherwise(text)
    return p.join(after, "page_id", "left").select(F.format_string("p%06d.md", "page_id").alias("file_path"), "url", text.alias("content"))


_RELINKED = f"""WITH p AS (SELECT page_id, {s_norm('url')} AS url FROM pages), n AS (SELECT p.page_id, p.url, q.url AS nxt FROM p LEFT JOIN p q ON q.page_id = p.page_id + 1),
    d AS (SELECT *, string_split({s_dir('url')}, '/') AS a, string_split({s_dir('nxt')} || '/page.md', '/') AS b FROM n),
    c AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) AS k FROM d),
    done AS (SELECT page_id, url, '---' || chr(10) || 'Source: ' || url || chr(10) || 'Fetched: x' || chr(10) || '---' || chr(10) || chr(10) || '# Page' || chr(10) || CASE WHEN page_id % 3 = 0 THEN 'no links' || chr(10) ELSE '[next](' ||
    CASE WHEN nxt IS NULL THEN '/none' ELSE repeat('../', CAST(len(a) - k AS INTEGER)) || array_to_string(b[k + 1:], '/') || '#part' END || CASE WHEN nxt IS NULL THEN '#part' ELSE '' END || ') and [away ↗](https://away.example.org/x)' || chr(10) END AS content FROM c)"""


@query(f"{_RELINKED} SELECT printf('p%06d.md', page_id) AS file_path, content, page_id % 3 <> 0 AS changed FROM done")
def link_check(spark, sf_dir):
    return linkcheck.link_check(saved_docs(spark, sf_dir).select("file_path", "content"))


@query("SELECT count(*) FILTER (page_id % 3 <> 0) AS updated, count(*) FILTER (page_id % 3 = 0) AS unchanged FROM pages")
def link_check_summary(spark, sf_dir):
    return linkcheck.summary(linkcheck.link_check(saved_docs(spark, sf_dir).select("file_path", "content")))


@query(f"{_RELINKED} SELECT url, content AS markdown FROM done")
def rewrite_markdown(spark, sf_dir):
    docs = saved_docs(spark, sf_dir).withColumnRenamed("content", "markdown")
    return rewrite.rewrite(docs, docs.select("url")).select("url", "markdown")


@query(
    f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)
    SELECT page_id, {s_origin('url')} || '/a' || page_id || ',' || {s_origin('url')} || '/ref,' || {s_origin('url')} || '/card,' || {s_origin('url')} || '/auto,' || {s_origin('url')} || '/bare' AS links FROM p"""
)
def markdown_page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("o", urls.origin("url"))
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("[x](/a"), n, F.lit(" 'title') ![i](/i.png) [z](/skip.css)\n\n[r]: /ref\n<Card href=\"/card\">\n<"), "o", F.lit("/auto>\nsee "), "o", F.lit("/bare. `"), "o", F.lit("/code`\n```\n"), "o", F.lit("/fenced\n```\n"))
    return p.select("page_id", F.array_join(rewrite.markdown_links(text, F.col("url"), F.col("o"), F.lit("/")), ",").alias("links"))


@query(f"WITH {_LINKS} SELECT page_id, CAST(count(DISTINCT target) AS BIGINT) AS n_links FROM links GROUP BY page_id")
def tree_link_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(html.content_links(F.col("html"), F.col("url"))).cast("bigint").alias("n_links")).where("n_links > 0")
