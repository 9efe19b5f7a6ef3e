"""Queries of the URL functions and predicates, over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import urls
from tidewell.operators import links as lk
from tidewell.plans.catalog import query, table
from tidewell.sources import corpus

URL = r"^([a-z][a-z0-9+.-]*)://([^/?#:]*)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"
EXTENSIONS = ("", ".png", ".JPG", ".html", ".woff2", ".js", ".css", ".pdf2", ".tar")
SCOPES = ("/", "/fr", "/fr/", "/en", "/de/8")


def s_host(u: str) -> str:
    return f"regexp_extract({u}, '{URL}', 2)"


def s_origin(u: str) -> str:
    return f"regexp_extract({u}, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)"


def s_path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '{URL}', 4), ''), '/')"


def s_norm(u: str) -> str:
    return f"regexp_replace({u}, '[?#].*$', '')"


def s_encoded(u: str) -> str:
    safe = urls.PATH_SAFE.replace("'", "''")
    return f"array_to_string(list_transform(regexp_extract_all({u}, '[{safe}]+|[^{safe}]+'), lambda p: CASE WHEN regexp_matches(p, '^[{safe}]') THEN p ELSE url_encode(p) END), '')"


def s_snake(x: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'index')"


def s_dir(u: str) -> str:
    parts = f"list_transform(list_filter(string_split({s_path(u)}, '/'), lambda x: x <> ''), lambda x: {s_snake('x')})"
    return f"{s_snake(s_host(u))} || '/' || coalesce(nullif(array_to_string({parts}, '/'), ''), 'root')"


def s_text_length(h: str) -> str:
    no_script = f"regexp_replace({h}, '(?is)<script.*?</script>', '', 'g')"
    no_style = f"regexp_replace({no_script}, '(?is)<style.*?</style>', '', 'g')"
    no_tags = f"regexp_replace({no_style}, '(?s)<[^>]*>', ' ', 'g')"
    return f"length(regexp_replace({no_tags}, '\\s+', '', 'g'))"


def s_scope(p: str, s: str) -> str:
    bare = f"regexp_replace({s}, '/$', '')"
    return f"({s} = '/' OR {p} = {bare} OR starts_with({p}, {bare} || '/'))"


def s_values(name: str, items) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))
    return f"(VALUES {rows}) AS {name}(i, {name})"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(
    f"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {s_norm('url')} AS norm_url,
    {s_dir('url')} || '/page.md' AS page_path, {s_text_length('html')} > 200 AS meaningful,
    CAST(len(list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), lambda x: x <> '')) AS BIGINT) AS n_links
    FROM pages"""
)
def page_overview(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        urls.normalize_for_queue("url").alias("norm_url"),
        F.concat(urls.output_dir("url"), F.lit("/page.md")).alias("page_path"),
        tx.has_meaningful_text("html").alias("meaningful"),
        F.size(F.filter(F.regexp_extract_all("html", F.lit(lk.ANCHOR), F.lit(1)), lambda x: x != "")).cast("bigint").alias("n_links"),
    )


@query(f"SELECT page_id, regexp_extract(url, '{URL}', 1) AS scheme, {s_host('url')} AS host, {s_path('url')} AS path, {s_origin('url')} AS origin, {s_snake(s_host('url'))} AS domain FROM pages")
def url_origin_split(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.scheme("url").alias("scheme"), urls.hostname("url").alias("host"), urls.pathname("url").alias("path"), urls.origin("url").alias("origin"), urls.snake_domain(urls.hostname("url")).alias("domain"))


@query(f"SELECT page_id, {s_norm('url')} AS norm_url, regexp_extract(url || '#part-' || page_id, '(#.+)$', 1) AS anchor FROM pages")
def url_normalize(spark, sf_dir):
    marked = F.concat("url", F.lit("#part-"), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", urls.normalize_for_queue(marked).alias("norm_url"), urls.anchor_of(marked).alias("anchor"))


@query(f"SELECT page_id, '.docs/' || {s_dir('url')} AS dir, '.docs/' || {s_dir('url')} || '/page.md' AS page_path, '.docs/' || {s_dir('url')} || '/.clutter.md' AS clutter_path, '.docs/' || {s_dir('url')} || '/.llms.md' AS llms_path, '.docs/' || {s_dir('url')} || '/llms-full.md' AS llms_full_path FROM pages")
def output_paths(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.output_paths("url").alias("p")).select("page_id", "p.*")


_CANDIDATE = f"""WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN {s_origin('url')} || '/' WHEN 1 THEN {s_origin('url')} || {s_path('url')} || '/?q=1' WHEN 2 THEN {s_norm('url')} || '.MD/' WHEN 3 THEN {s_norm('url')} || '.txt#x' ELSE url END AS u FROM pages),
    w AS (SELECT *, {s_path('u')} AS p, regexp_replace({s_path('u')}, '/+$', '') AS bare, regexp_extract(regexp_replace(u, '#.*$', ''), '(\\?.*)$', 1) AS q FROM v)
    SELECT page_id, u, {s_origin('u')} || CASE WHEN lower(p) LIKE '%.md' OR lower(p) LIKE '%.txt' THEN p WHEN p = '/' OR bare = '' THEN '/llms.txt' WHEN p LIKE '%/' AND lower(bare) LIKE '%.md' THEN bare ELSE bare || '.md' END || q AS candidate FROM w"""


@query(_CANDIDATE)
def markdown_candidate(spark, sf_dir):
    base, path = urls.origin("url"), urls.pathname("url")
    norm = urls.normalize_for_queue("url")
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.concat(base, F.lit("/"))).when(k == 1, F.concat(base, path, F.lit("/?q=1"))).when(k == 2, F.concat(norm, F.lit(".MD/"))).when(k == 3, F.concat(norm, F.lit(".txt#x"))).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", u.alias("u")).select("page_id", "u", urls.markdown_candidate("u").alias("candidate"))


@query(
    f"""SELECT page_id, CASE WHEN length(url) <= 24 THEN url WHEN length({s_path('url')} || coalesce(regexp_extract(url, '{URL}', 5), '')) > 21 THEN '...' || right({s_path('url')} || regexp_extract(url, '{URL}', 5), 21)
    ELSE left({s_host('url')} || {s_path('url')} || regexp_extract(url, '{URL}', 5), 21) || '...' END AS shown FROM pages"""
)
def truncated_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.truncate_url("url", 24).alias("shown"))


@query(
    f"""SELECT page_id, i AS variant, {s_path('url')} || ext AS path, NOT regexp_matches(lower({s_path('url')} || ext), '\\.({urls.BLOCKED})$') AS candidate,
    regexp_matches(lower({s_path('url')} || ext), '\\.(css|js)$') AS blocked FROM pages, {s_values('ext', EXTENSIONS)}"""
)
def html_candidate_filter(spark, sf_dir):
    kinds = F.posexplode(F.array(*map(F.lit, EXTENSIONS))).alias("variant", "ext")
    each = pages(spark, sf_dir).select("page_id", "url", kinds).select("page_id", "variant", F.concat(urls.pathname("url"), "ext").alias("path"))
    return each.withColumns({"candidate": urls.is_html_candidate("path"), "blocked": urls.is_blocked_download("path")})


@query(f"SELECT page_id, scope, {s_path('url')} AS path FROM pages, {s_values('scope', SCOPES)} WHERE {s_scope(s_path('url'), 'scope')}")
def scope_filter(spark, sf_dir):
    each = pages(spark, sf_dir).select("page_id", urls.pathname("url").alias("path"), F.explode(F.array(*map(F.lit, SCOPES))).alias("scope"))
    return each.where(urls.is_path_in_scope("path", "scope")).select("page_id", "scope", "path")


@query(f"SELECT page_id, CAST({s_text_length('html')} AS BIGINT) AS n_text, {s_text_length('html')} > 200 AS meaningful, NOT ({s_text_length('html')} > 1500) AS needs_render FROM pages")
def meaningful_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.text_length("html").cast("bigint").alias("n_text"), tx.has_meaningful_text("html").alias("meaningful"), (~tx.has_meaningful_text("html", 1500)).alias("needs_render"))


_SAVED = "'---' || chr(10) || 'Source: x' || chr(10) || '---' || chr(10) || chr(10) || text"


@query(f"SELECT doc_id, length(trim(regexp_replace({_SAVED}, '^---(?s:.*?)---\\s*', ''), ' ' || chr(9) || chr(10) || chr(13))) < 1500 AS too_short FROM documents")
def markdown_too_short(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_markdown_too_short(F.concat(F.lit("---\nSource: x\n---\n\n"), "text"), 1500).alias("too_short"))


_DELTA = "CASE page_id % 4 WHEN 0 THEN '/guide' WHEN 1 THEN '/de/' || page_id WHEN 2 THEN 'guide' ELSE '/docs/x' END"
_TARGET = f"{s_origin('url')} || CASE page_id % 4 WHEN 0 THEN '/guide' WHEN 1 THEN '/de/' || page_id WHEN 2 THEN '/guide' ELSE '/docs/x' END"


@query(
    f"""WITH v AS (SELECT page_id, url, {_DELTA} AS href, {_TARGET} AS target FROM pages)
    SELECT page_id, href, CASE WHEN starts_with(href, '/') AND NOT {s_scope(s_path('target'), "'/docs/'")} THEN {s_origin('target')} || '/docs' || {s_path('target')} ELSE target END AS scoped FROM v"""
)
def scope_prefixed_links(spark, sf_dir):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    href = F.when(k == 0, F.lit("/guide")).when(k == 1, F.concat(F.lit("/de/"), n)).when(k == 2, F.lit("guide")).otherwise(F.lit("/docs/x"))
    v = pages(spark, sf_dir).select("page_id", "url", href.alias("href")).withColumn("target", F.concat(urls.origin("url"), F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), "href"))))
    return v.select("page_id", "href", urls.apply_scope("href", "target", F.lit("/docs/")).alias("scoped"))


@query(
    f"""WITH o AS (SELECT min(url) AS u FROM pages), v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '#top' WHEN 1 THEN 'mailto:a@b.c' WHEN 2 THEN 'tel:1' ELSE pages.url END AS href, pages.url AS target, o.u AS cur FROM pages, o)
    SELECT page_id, href, href NOT LIKE '#%' AND href NOT LIKE 'mailto:%' AND href NOT LIKE 'tel:%' AND {s_origin('target')} <> {s_origin('cur')} AS external FROM v"""
)
def external_links(spark, sf_dir):
    p = pages(spark, sf_dir)
    current = p.agg(F.min("url").alias("cur"))
    k = F.col("page_id") % 5
    href = F.when(k == 0, F.lit("#top")).when(k == 1, F.lit("mailto:a@b.c")).when(k == 2, F.lit("tel:1")).otherwise(F.col("url"))
    # one row, a minimum over all pages
    return p.crossJoin(F.broadcast(current)).select("page_id", href.alias("href"), urls.is_external(href, "url", "cur").alias("external"))


@query(
    f"""WITH d AS (SELECT page_id, '.docs/' || {s_dir('url')} AS here, '.docs/' || {s_dir("'https://ththre.example.com/fr/guide'")} || '/page.md' AS there FROM pages),
    p AS (SELECT *, string_split(here, '/') AS a, string_split(there, '/') AS b FROM d),
    c AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) AS k FROM p)
    SELECT page_id, repeat('../', CAST(len(a) - k AS INTEGER)) || array_to_string(b[k + 1:], '/') AS relative FROM c"""
)
def relative_path(spark, sf_dir):
    there = urls.output_paths(F.lit("https://ththre.example.com/fr/guide"))["page_path"]
    return pages(spark, sf_dir).select("page_id", urls.relative_path(urls.output_paths("url")["dir"], there).alias("relative"))


LIST = ["# list", "", "https://a.com/x", "  https://b.com/y  ", "https://a.com/x", "#https://c.com", "https://a.com/x/", "https://d.com"]


@query(
    "WITH l(pos, value) AS (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LIST))
    + ", (-1, 'https://d.com')) SELECT CAST(min(pos) AS BIGINT) AS pos, trim(value) AS url FROM l WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%' GROUP BY trim(value)"
)
def urls_file_load(spark, sf_dir):
    return corpus.url_list(spark.createDataFrame(list(enumerate(LIST)), "pos long, value string"), "https://d.com")


@query(
    """WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-' || event_id WHEN 4 THEN 'x' || event_id ELSE NULL END AS raw FROM events)
    SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(raw, '^\\s*([+-]?[0-9]{1,15})', 1) AS BIGINT) > 0 THEN CAST(regexp_extract(raw, '^\\s*([+-]?[0-9]{1,15})', 1) AS BIGINT) ELSE 4 END AS n FROM v"""
)
def positive_ints(spark, sf_dir):
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("abc"))).when(k == 2, F.lit("0")).when(k == 3, F.concat(F.lit("-"), n)).when(k == 4, F.concat(F.lit("x"), n))
    return table(spark, sf_dir, "events").select("event_id", tx.parse_positive_int(raw, 4).cast("bigint").alias("n"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS shown,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', CAST(floor(extract('microseconds' FROM ts) / 1000) AS BIGINT) % 1000) || 'Z' AS at FROM (SELECT event_id, ts, CAST(greatest(1, floor(event_id * 137 / 1000.0 + 0.5)) AS BIGINT) AS s FROM events)"""
)
def durations_and_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.format_duration(F.col("event_id") * 137).alias("shown"), tx.iso_millis("ts").alias("at"))


_BLOOM_BITS, _BLOOM_K = tx.bloom_bits(1000)


def _s_hash(seed: int) -> str:
    return f"list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST({seed} AS BIGINT))"


@query(
    f"""WITH h AS (SELECT page_id, {_s_hash(tx.SEEDS[0])} AS a, {_s_hash(tx.SEEDS[1])} AS b FROM pages)
    SELECT page_id, a, b, array_to_string(list_transform(range(0, {_BLOOM_K}), lambda i: CAST((a + i * b) % {_BLOOM_BITS} AS VARCHAR)), ',') AS positions FROM h"""
)
def bloom_parity(spark, sf_dir):
    bits = F.array_join(F.transform(tx.bloom_positions("url", 1000), lambda x: x.cast("string")), ",")
    return pages(spark, sf_dir).select("page_id", tx.rolling_hash("url", tx.SEEDS[0]).alias("a"), tx.rolling_hash("url", tx.SEEDS[1]).alias("b"), bits.alias("positions"))
