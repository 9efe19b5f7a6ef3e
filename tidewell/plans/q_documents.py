"""Queries of Markdown documents and of searching them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import urls
from tidewell.operators import markdown, search
from tidewell.plans.catalog import query, table
from tidewell.plans.q_urls import s_dir

FETCHED = "2024-01-01T00:00:00.000Z"
_NL = "chr(10)"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# ---- Markdown documents: text of every kind, made of documents and pages

_MD = f"""md AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '## Part ' || doc_id || {_NL} || {_NL} || text WHEN 2 THEN 'intro' || {_NL} || {_NL} || '# Late ' || doc_id || '  ' || {_NL} || text
    ELSE '---' || {_NL} || 'Source: ' || CASE doc_id % 3 WHEN 0 THEN '[https://h.com/' || doc_id || '](page.md)' WHEN 1 THEN '<https://h.com/' || doc_id || '>' ELSE 'https://h.com/' || doc_id || ' ↗' END || {_NL} || 'Fetched: x' || {_NL} || '---' || {_NL} || {_NL} || text END AS m FROM documents)"""


def md(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    k, j = F.col("doc_id") % 4, F.col("doc_id") % 3
    source = F.when(j == 0, F.concat(F.lit("[https://h.com/"), n, F.lit("](page.md)"))).when(j == 1, F.concat(F.lit("<https://h.com/"), n, F.lit(">"))).otherwise(F.concat(F.lit("https://h.com/"), n, F.lit(" ↗")))
    text = (
        F.when(k == 0, F.col("text"))
        .when(k == 1, F.concat(F.lit("## Part "), n, F.lit("\n\n"), "text"))
        .when(k == 2, F.concat(F.lit("intro\n\n# Late "), n, F.lit("  \n"), "text"))
        .otherwise(F.concat(F.lit("---\nSource: "), source, F.lit("\nFetched: x\n---\n\n"), "text"))
    )
    return documents(spark, sf_dir).select("doc_id", text.alias("m"))


@query(f"WITH {_MD} SELECT doc_id, regexp_extract(m, '^(---\\s*\\n(?s:.*?)\\n---\\s*\\n)((?s:.*))$', 1) AS front, md5(CASE WHEN doc_id % 4 = 3 THEN regexp_extract(m, '^(---\\s*\\n(?s:.*?)\\n---\\s*\\n)((?s:.*))$', 2) ELSE m END) AS body_md5 FROM md")
def md_frontmatter_split(spark, sf_dir):
    return md(spark, sf_dir).select("doc_id", markdown.frontmatter("m").alias("front"), F.md5(markdown.body("m")).alias("body_md5"))


@query(f"WITH {_MD} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'https://h.com/' || doc_id END AS source FROM md")
def md_source_url(spark, sf_dir):
    return md(spark, sf_dir).select("doc_id", markdown.source_url("m").alias("source"))


@query(f"WITH {_MD} SELECT doc_id, nullif(regexp_extract(m, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1), '') AS title, doc_id % 4 = 1 AS leading FROM md")
def md_title(spark, sf_dir):
    return md(spark, sf_dir).select("doc_id", markdown.title("m").alias("title"), markdown.has_leading_heading("m").alias("leading"))


@query(
    f"""WITH {_MD}, t AS (SELECT doc_id, trim(m, ' ' || chr(9) || chr(10) || chr(13)) AS x, 'https://h.com/' || doc_id AS u FROM md)
    SELECT doc_id, md5('---' || {_NL} || 'Source: ' || u || {_NL} || 'Fetched: {FETCHED}' || {_NL} || '---' || {_NL} || CASE WHEN doc_id % 4 = 1 THEN x ELSE '# ' || coalesce(nullif(regexp_extract(x, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1), ''), u) || {_NL} || {_NL} || x END) AS document FROM t"""
)
def md_extract(spark, sf_dir):
    url = F.concat(F.lit("https://h.com/"), F.col("doc_id").cast("string"))
    return md(spark, sf_dir).select("doc_id", F.md5(markdown.extract_markdown("m", url, F.lit(FETCHED))).alias("document"))


_LINKED = f"""SELECT page_id, 'see [one](/a/' || page_id || ' "t") and ![pic](/p.png) or [two](<https://o.com/x>).' || {_NL} || '[ref]: https://r.com/' || page_id || ' "title"' || {_NL} || 'auto <https://auto.com/' || page_id || '> bare ' || url || '. `https://code.com`' || {_NL} || '```' || {_NL} || 'https://fenced.com' || {_NL} || '~~~' || {_NL} || '```' || {_NL} || 'last https://end.com/a,' AS m, url FROM pages"""


def linked(spark, sf_dir):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("see [one](/a/"), n, F.lit(' "t") and ![pic](/p.png) or [two](<https://o.com/x>).\n[ref]: https://r.com/'), n, F.lit(' "title"\nauto <https://auto.com/'), n, F.lit("> bare "), "url", F.lit(". `https://code.com`\n```\nhttps://fenced.com\n~~~\n```\nlast https://end.com/a,"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("m"), "url")


#: Whole documents in which some words are links, images and links with a title.
_WORDY = """w AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: CASE WHEN (i + doc_id) % 5 = 0 THEN '[' || w || '](/' || i || ')' WHEN (i + doc_id) % 7 = 0 THEN '![' || w || '](i.png)' WHEN (i + doc_id) % 11 = 0 THEN '[x ' || i || '](<https://o.com/' || i || '> "t")' ELSE w END), ' ') AS m FROM documents),
    l AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(m, '!?\\[[^\\]]+\\]\\([^)]+\\)'), lambda x: NOT starts_with(x, '!')), lambda x: {'label': regexp_extract(x, '^\\[([^\\]]+)\\]', 1), 'raw': regexp_extract(x, '\\]\\(([^)]+)\\)$', 1)}) AS l FROM w)"""


@query(
    f"""WITH {_WORDY} SELECT doc_id, md5(array_to_string(list_transform(l, lambda x: x.label || '=' || regexp_replace(regexp_extract(trim(x.raw), '^\\S*'), '^<(.*)>$', '\\1')), '; ')) AS links, len(list_filter(l, lambda x: regexp_matches(trim(x.raw), '\\s'))) AS n_titled FROM l"""
)
def md_inline_links(spark, sf_dir):
    k = lambda i: i + 1 + F.col("doc_id")
    n = lambda i: (i + 1).cast("string")
    word = lambda w, i: (
        F.when(k(i) % 5 == 0, F.concat(F.lit("["), w, F.lit("](/"), n(i), F.lit(")")))
        .when(k(i) % 7 == 0, F.concat(F.lit("!["), w, F.lit("](i.png)")))
        .when(k(i) % 11 == 0, F.concat(F.lit("[x "), n(i), F.lit("](<https://o.com/"), n(i), F.lit('> "t")')))
        .otherwise(w)
    )
    m = documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), " "), word), " ").alias("m"))
    found = m.select("doc_id", F.transform(markdown.inline_links("m"), lambda x: F.struct(x["label"].alias("label"), markdown.parse_href(x["raw"]).alias("p"))).alias("l"))
    titled = F.size(F.filter("l", lambda x: x["p"]["suffix"] != "")).cast("bigint")
    return found.select("doc_id", F.md5(F.array_join(F.transform("l", lambda x: F.concat(x["label"], F.lit("="), x["p"]["href"])), "; ")).alias("links"), titled.alias("n_titled"))


@query(f"WITH m AS ({_LINKED}) SELECT page_id, array_to_string(regexp_extract_all(m, '(?m)^[ \\t]*\\[[^\\]]+\\]:\\s*(\\S+).*$', 1), ' ') AS refs, array_to_string(regexp_extract_all(m, '<\\s*(https?://[^>\\s]+)\\s*>', 1), ' ') AS autos FROM m")
def md_reference_links(spark, sf_dir):
    return linked(spark, sf_dir).select("page_id", F.array_join(markdown.reference_targets("m"), " ").alias("refs"), F.array_join(markdown.autolinks("m"), " ").alias("autos"))


@query("SELECT page_id, regexp_replace(url, '[.,!?;:]+$', '') || ' https://end.com/a' AS bare FROM pages")
def md_bare_urls(spark, sf_dir):
    return linked(spark, sf_dir).select("page_id", F.array_join(markdown.simple_bare_urls("m"), " ").alias("bare"))


#: Whole documents in which some lines are fences, of two kinds, of any length, indented or with an info string.
_FENCED = f"""f AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), {_NL}), lambda l, i: CASE (i * 7 + doc_id) % 11 WHEN 0 THEN '```' || l WHEN 3 THEN '  ~~~~' WHEN 5 THEN '````sql' WHEN 8 THEN '~~~' WHEN 9 THEN 'a ``` b' ELSE l END) AS ls FROM documents)"""


def fenced(spark, sf_dir):
    k = lambda i: (i + 1) * 7 + F.col("doc_id")
    line = lambda l, i: F.when(k(i) % 11 == 0, F.concat(F.lit("```"), l)).when(k(i) % 11 == 3, F.lit("  ~~~~")).when(k(i) % 11 == 5, F.lit("````sql")).when(k(i) % 11 == 8, F.lit("~~~")).when(k(i) % 11 == 9, F.lit("a ``` b")).otherwise(l)
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("m"))


@query(
    f"""WITH {_FENCED}, m AS (SELECT doc_id, list_transform(ls, lambda l: {{'open': regexp_extract(l, '^\\s*(```|~~~)', 1), 'skip': ''}}) AS ms FROM f)
    SELECT doc_id, list_reduce([{{'open': '', 'skip': ''}}] || ms, lambda s, x: {{'open': CASE WHEN s.open = '' THEN x.open WHEN s.open = x.open THEN '' ELSE s.open END, 'skip': s.skip || CASE WHEN x.open <> '' OR s.open <> '' THEN '1' ELSE '0' END}}).skip AS states FROM m"""
)
def fence_state(spark, sf_dir):
    return fenced(spark, sf_dir).select("doc_id", F.array_join(F.transform(markdown.fence_states("m"), lambda b: b.cast("int").cast("string")), "").alias("states"))


_LABEL = "CASE doc_id % 3 WHEN 0 THEN lang || ' ↗ ' WHEN 1 THEN lang ELSE lang || '  ' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_LABEL} ELSE {_LABEL} || ' ↗' END AS marked, lang AS plain FROM documents")
def md_external_marker(spark, sf_dir):
    k = F.col("doc_id") % 3
    label = F.when(k == 0, F.concat("lang", F.lit(" ↗ "))).when(k == 1, F.col("lang")).otherwise(F.concat("lang", F.lit("  ")))
    return documents(spark, sf_dir).select("doc_id", markdown.with_external_marker(label).alias("marked"), markdown.without_external_marker(label).alias("plain"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS collapsed FROM documents")
def collapsed_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.collapse_whitespace("text")).alias("collapsed"))


# ---- search

QUERY = "fr2"
_FUZZY = f"""p AS (SELECT DISTINCT {s_dir('url')} || '/page.md' AS path FROM pages),
    q AS (SELECT generate_subscripts(string_split('{QUERY}', ''), 1) AS k, unnest(string_split('{QUERY}', '')) AS c),
    s(path, k, spot, score, indices) AS (SELECT path, 0, -1, 0.0::DOUBLE, '' FROM p
        UNION ALL SELECT path, k, spot, score + greatest(10.0 + CASE WHEN prev = spot - 1 THEN 15 ELSE 0 END + CASE WHEN spot = 0 OR regexp_matches(substr(path, spot, 1), '[/\\\\_\\-.\\s]') THEN 10 ELSE 0 END + CASE WHEN substr(path, spot + 1, 1) = c THEN 2 ELSE 0 END - spot * 0.5, 1.0), indices || CASE WHEN indices = '' THEN '' ELSE ',' END || spot
        FROM (SELECT s.path, q.k, s.spot AS prev, s.score, s.indices, q.c, s.spot + instr(substr(lower(s.path), s.spot + 2), lower(q.c)) AS spot, instr(substr(lower(s.path), s.spot + 2), lower(q.c)) AS hit FROM s JOIN q ON q.k = s.k + 1) WHERE hit > 0),
    paths AS (SELECT path, CAST(score AS DOUBLE) AS score, indices FROM s WHERE k = {len(QUERY)})"""


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.concat(urls.output_dir("url"), F.lit("/page.md")).alias("path")).distinct()


def _listed(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH RECURSIVE {_FUZZY} SELECT path, score, indices FROM paths")
def fuzzy_paths(spark, sf_dir):
    return search.search_paths(page_paths(spark, sf_dir), QUERY).withColumn("indices", _listed("indices"))


@query(f"WITH RECURSIVE {_FUZZY} SELECT path, score FROM paths ORDER BY score DESC, path LIMIT 20")
def fuzzy_topk(spark, sf_dir):
    return search.search_paths(page_paths(spark, sf_dir), QUERY).select("path", "score").orderBy(F.desc("score"), "path").limit(20)


@query(f"WITH RECURSIVE {_FUZZY} SELECT path, array_to_string(list_transform(string_split(path, ''), lambda c, i: CASE WHEN list_contains(string_split(indices, ','), CAST(i - 1 AS VARCHAR)) THEN chr(27) || '[1m' || chr(27) || '[33m' || c || chr(27) || '[0m' ELSE c END), '') AS shown FROM paths")
def highlighted_paths(spark, sf_dir):
    return search.search_paths(page_paths(spark, sf_dir), QUERY).select("path", tx.highlight("path", "indices").alias("shown"))


WORD = "idiot"
_LINES = f"""l AS (SELECT doc_id, string_split(text, {_NL}) AS ls FROM documents), n AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
    hits AS (SELECT *, instr(lower(line), '{WORD}') - 1 AS spot FROM n WHERE instr(lower(line), '{WORD}') > 0)"""


def corpus_of(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@query(f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(count(*) * 10.0 + {len(WORD)} AS DOUBLE) AS score, count(*) AS n_matches FROM hits GROUP BY doc_id")
def content_search(spark, sf_dir):
    return search.search_content(corpus_of(spark, sf_dir), WORD).select("path", "score", F.size("matches").cast("bigint").alias("n_matches"))


@query(f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS path, i AS line_number, line, spot AS match_index, array_to_string(ls[greatest(i - 2, 1):i - 1], '|') AS before, array_to_string(ls[i + 1:i + 2], '|') AS after FROM hits")
def content_context(spark, sf_dir):
    m = search.search_content(corpus_of(spark, sf_dir), WORD).select("path", F.explode("matches").alias("m"))
    return m.select("path", F.col("m.line_number").cast("bigint").alias("line_number"), "m.line", F.col("m.match_index").cast("bigint").alias("match_index"), F.array_join("m.context_before", "|").alias("before"), F.array_join("m.context_after", "|").alias("after"))


@query(
    f"""WITH {_LINES}, b AS (SELECT doc_id, '  ' || i || ': ' || line || {_NL} AS own, i, array_to_string(list_transform(ls[greatest(i - 2, 1):i - 1], lambda x, k: '  ' || (greatest(i - 2, 1) + k - 1) || ': ' || x || {_NL}), '') AS pre, array_to_string(list_transform(ls[i + 1:i + 2], lambda x, k: '  ' || (i + k) || ': ' || x || {_NL}), '') AS post FROM hits)
    SELECT CAST(doc_id AS VARCHAR) AS path, md5(doc_id || {_NL} || string_agg(pre || own || post, {_NL} ORDER BY i)) AS shown FROM b GROUP BY doc_id"""
)
def formatted_results(spark, sf_dir):
    return search.format_content(search.search_content(corpus_of(spark, sf_dir), WORD)).select("path", F.md5("text").alias("shown"))


_MERGE = f"""c AS (SELECT path, content FROM (SELECT {s_dir('url')} || '/page.md' AS path, min(html) AS content FROM pages GROUP BY 1)),
    m AS (SELECT path, len(list_filter(string_split(content, {_NL}), lambda x: contains(lower(x), '{QUERY}'))) AS n FROM c)"""


@query(
    f"""WITH RECURSIVE {_FUZZY}, {_MERGE}, every AS (SELECT path, score, 'path' AS match_type FROM paths UNION ALL SELECT path, CAST(n * 10.0 + {len(QUERY)} AS DOUBLE), 'content' FROM m WHERE n > 0)
    SELECT path, score, match_type FROM every ORDER BY score DESC, match_type DESC, path LIMIT 20"""
)
def find_merged_topk(spark, sf_dir):
    files = table(spark, sf_dir, "pages").groupBy(F.concat(urls.output_dir("url"), F.lit("/page.md")).alias("path")).agg(F.min("html").alias("content"))
    return search.find(files, QUERY).select("path", "score", "match_type")
