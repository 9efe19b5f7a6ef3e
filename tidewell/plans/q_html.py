"""Queries of HTML pages: Markdown, clutter, content.

Their SQL takes the pages of the tables apart by their fixed frame (title,
style, script, a list of links, a box, an article of paragraphs, a footer)
and never builds a tree, so it shares no step with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import html
from tidewell.plans.catalog import query, table
from tidewell.plans.q_links import _LINKS

_NL = "chr(10)"


def _un(x: str) -> str:
    for name, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{name}', '{sign}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _inline(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g')"
    for pattern, by in (("([\\\\*_`\\[\\]])", "\\\\\\1"), ("^(#{1,6} |[-+>]|=+|~~~)", "\\\\\\1"), ("^(\\d+)\\. ", "\\1\\\\. ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _esc(x: str) -> str:
    return f"trim({_inline(x)})"


def _between(a: str, b: str) -> str:
    return f"regexp_extract(html, '(?s){a}(.*?){b}', 1)"


_PAGE = f"""raw AS (SELECT page_id, url, html, {_un(_between('<title>', '</title>'))} AS title, {_between('<style>', '</style>')} AS style, {_between('<script>', '</script>')} AS script,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs, list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: {_un('x')}) AS names,
    {_un(_between('<div class="ad">', '</div>'))} AS ad, {_un(_between('<h1>', '</h1>'))} AS h1, string_split({_between('</h1>', '</article>')}, '<p>')[2:] AS ps, {_un(_between('<footer>', '</footer>'))} AS footer FROM pages),
    told AS (SELECT *, list_transform(ps, lambda x: starts_with(x, '<b>')) AS bold, list_transform(ps, lambda x: {_un("regexp_replace(x, '<[^>]*>', '', 'g')")}) AS said FROM raw),
    page AS (SELECT *, list_filter(['# ' || {_esc('h1')}] || list_transform(said, lambda x, i: CASE WHEN x = '' THEN '' WHEN bold[i] THEN '**' || {_esc('x')} || '**' ELSE {_esc('x')} END), lambda x: x <> '') AS article,
    array_to_string(list_transform(names, lambda x, i: '-   [' || x || '](' || hrefs[i] || ')'), {_NL}) AS nav FROM told)"""
_MARKDOWN = f"array_to_string(list_filter([{_inline('title')} || {_inline('style')} || {_inline('script')}, nav, {_esc('ad')}] || article || [{_esc('footer')}], lambda x: x <> ''), {_NL} || {_NL})"
_CLUTTER = "[array_to_string(names, ''), footer, script, style]"
#: The article is told apart from the rest of the body if its text is long enough and a paragraph speaks.
_LONG = "length(h1 || array_to_string(said, '')) >= 500 AND list_max(list_transform(said, lambda x: length(x))) >= 25"


@query(f"WITH {_PAGE} SELECT page_id, {_MARKDOWN} AS markdown FROM page")
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


@query(f"WITH {_PAGE} SELECT page_id, trim(regexp_replace(ad || h1 || array_to_string(said, ''), '\\s+', ' ', 'g')) AS main, '<ul>' || array_to_string(list_transform(list_filter({_CLUTTER}, lambda x: trim(x) <> ''), lambda x: '<li>' || trim(x) || '</li>'), '') || '</ul>' AS clutter FROM page")
def strip_clutter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clutter_of("html").alias("c")).select("page_id", "c.*")


FETCHED = "2024-01-01T00:00:00.000Z"
_HEAD = f"'---' || {_NL} || 'Source: ' || url || {_NL} || 'Fetched: {FETCHED}' || {_NL} || '---' || {_NL} || {_NL} || '# ' || trim(title) || {_NL}"
_BODY = f"array_to_string(CASE WHEN {_LONG} THEN article ELSE list_filter([{_esc('ad')}], lambda x: x <> '') || article END, {_NL} || {_NL}) || {_NL}"


@query(
    f"""WITH {_LINKS}, firsts AS (SELECT page_id, target, min(pos) AS pos FROM links GROUP BY page_id, target), lists AS (SELECT page_id, string_agg(target, ' ' ORDER BY pos) AS links FROM firsts GROUP BY page_id), {_PAGE}
    SELECT page_id, trim(title) AS title, coalesce(lists.links, '') AS links, {_HEAD} || {_BODY} AS markdown, array_to_string(list_transform(list_filter({_CLUTTER}, lambda x: trim(x) <> ''), lambda x: '-   ' || array_to_string(list_transform(string_split(trim(x), '</p>'), lambda t: {_esc('t')}), '')), {_NL}) AS clutter_markdown,
    {_HEAD} || {_BODY} AS llms_markdown, {_HEAD} || {_MARKDOWN} || {_NL} AS llms_full_markdown FROM page LEFT JOIN lists USING (page_id)"""
)
def extract_content(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    d = html.extract_content(F.col("html"), F.col("url"), F.lit(FETCHED))
    return p.select("page_id", "url", d.alias("d")).select("page_id", "d.title", F.array_join("d.links", " ").alias("links"), "d.markdown", "d.clutter_markdown", "d.llms_markdown", "d.llms_full_markdown")
