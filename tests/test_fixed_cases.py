"""Functions and operators on small fixed inputs with known results."""

import pytest
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.functions import text as tx
from tidewell.functions import urls
from tidewell.operators import crawl, html, linkcheck, markdown, rewrite, robots, schedule, search
from tidewell.sources import corpus, fetch


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- utilities


@pytest.mark.parametrize("raw,other,want", [(None, 3, 3), ("abc", 4, 4), ("10", 1, 10), ("12abc", 1, 12), ("0", 4, 4), ("-3", 4, 4)])
def test_positive_int(spark, raw, other, want):
    assert value(spark, tx.parse_positive_int(F.lit(raw).cast("string"), other)) == want


@pytest.mark.parametrize("raw,want", [("Hello World!", "hello_world"), ("###", "index")])
def test_sanitize_segment(spark, raw, want):
    assert value(spark, urls.sanitize_segment(F.lit(raw))) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://example.com/docs/get-started", ".docs/example_com/docs/get_started/page.md"),
        ("https://h.com/", ".docs/h_com/root/page.md"),
        ("https://h.com/f%C3%BCr", ".docs/h_com/f_c3_bcr/page.md"),
        ("https://h.com:8080/a//b?x#y", ".docs/h_com/a/b/page.md"),
    ],
)
def test_output_paths(spark, url, want):
    paths = value(spark, urls.output_paths(F.lit(url)))
    assert paths["page_path"] == want and paths["llms_path"].endswith(".llms.md")
    assert rewrite.page_path(url) == want.removeprefix(".docs/")


def test_normalize_for_queue(spark):
    assert value(spark, urls.normalize_for_queue(F.lit("https://example.com/page?x=1#section"))) == "https://example.com/page"


@pytest.mark.parametrize("path,want", [("/image.png", False), ("/app.js", False), ("/styles.css", False), ("/about", True), ("/a.PNG", False), ("/a.js\n", True)])
def test_html_candidate(spark, path, want):
    assert value(spark, urls.is_html_candidate(F.lit(path))) is want


@pytest.mark.parametrize("path,scope,want", [("/docs/guide", "/docs", True), ("/blog/post", "/docs", False), ("/docs", "/docs", True), ("/docs2", "/docs", False), ("/docs/", "/docs", True), ("/docs", "/docs/", True), ("/x", "/", True)])
def test_scope(spark, path, scope, want):
    assert value(spark, urls.is_path_in_scope(F.lit(path), F.lit(scope))) is want
    assert rewrite.in_scope(path, scope) is want


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://h.org/", "https://h.org/llms.txt"),
        ("http://h.org:81", "http://h.org:81/llms.txt"),
        ("https://h.org/a/b-c", "https://h.org/a/b-c.md"),
        ("https://h.org/a//", "https://h.org/a.md"),
        ("https://h.org/A.MD", "https://h.org/A.MD"),
        ("https://h.org/notes.txt", "https://h.org/notes.txt"),
        ("https://h.com/a.html?x=1#y", "https://h.com/a.html.md?x=1"),
        ("https://h.com/a.MD/", "https://h.com/a.MD"),
    ],
)
def test_markdown_candidate(spark, url, want):
    assert value(spark, urls.markdown_candidate(F.lit(url))) == want


@pytest.mark.parametrize("n,want", [(200, False), (201, True)])
def test_meaningful_text(spark, n, want):
    page = "<html><style>p{}</style><script>var x = '</p>'</script><p>" + "x " * n + "</p>"
    assert value(spark, tx.has_meaningful_text(F.lit(page))) is want


@pytest.mark.parametrize(
    "href,base,want",
    [
        ("HTTPS://EXAMPLE.com:443/a/../b", None, "https://example.com/b"),
        ("für", "https://h.com/x/y", "https://h.com/x/f%C3%BCr"),
        ("//o.com", "https://h.com/", "https://o.com/"),
        ("?q=1", "https://h.com/a", "https://h.com/a?q=1"),
        ("https://", None, None),
        ("http://a:99999/", None, None),
        ("mailto:x@y.z", "https://h.com/", "mailto:x@y.z"),
    ],
)
def test_canonical_url(href, base, want):
    assert urls.canonical_url(href, base) == want


# ---- hashing and fuzzy matching


def test_rolling_hash_and_bloom(spark):
    assert [value(spark, tx.rolling_hash(F.lit("a"), s)) for s in tx.SEEDS] == [2725714748, 683130064]
    assert [value(spark, tx.rolling_hash(F.lit("https://example.com/docs"), s)) for s in tx.SEEDS] == [2496044449, 2991027597]
    assert list(value(spark, tx.bloom_positions(F.lit("https://example.com/docs"), 100))) == [449, 46, 643, 240, 837, 434, 31]


@pytest.mark.parametrize(
    "query,target,score,indices",
    [
        ("doc", "docs/page.md", 89.5, [0, 1, 2]),
        ("DOC", "docs/page.md", 83.5, [0, 1, 2]),
        ("gst", "get-started/page.md", 81.5, [0, 4, 5]),
        ("pm", "docs/page.md", 36.5, [5, 10]),
        ("md", "example_com/docs/a/very/long/path/to/page.md", 26.5, [3, 12]),
        ("xyz", "docs/page.md", None, None),
        ("", "a", 0.0, []),
    ],
)
def test_fuzzy(spark, query, target, score, indices):
    m = value(spark, tx.fuzzy_match(query, F.lit(target)))
    assert (m and (m["score"], list(m["indices"]))) == (None if score is None else (score, indices))


def test_content_search(spark):
    files = spark.createDataFrame([("f", "a\nB\nc"), ("g", None), ("h", "")], "path string, content string")
    row = search.search_content(files, "b", 1).collect()
    assert len(row) == 1 and row[0]["score"] == 11
    m = row[0]["matches"][0]
    assert (m["line_number"], m["match_index"], m["match_length"], list(m["context_before"]), list(m["context_after"])) == (2, 0, 1, ["a"], ["c"])
    shown = search.format_content(search.search_content(files, "b", 1)).first()["text"]
    assert shown == "f\n  1: a\n  2: B\n  3: c\n"
    assert search.find(files, "b", files_only=True, content_only=True).count() == 0


# ---- robots


def allowed(spark, text, agent, paths):
    rules = robots.rules_for(robots.parse(spark.createDataFrame([("o", text)], "origin string, text string")), agent)
    rows = robots.allowed(spark.createDataFrame([("o", p) for p in paths], "origin string, path string"), rules).collect()
    return {r["path"]: r["allowed"] for r in rows}


@pytest.mark.parametrize(
    "text,agent,want",
    [
        ("User-agent: *\nDisallow: /private\nAllow: /private/docs\nCrawl-delay: 2", "x", {"/private/docs/readme": True, "/private/other": False}),
        ("User-agent: *\nDisallow: ", "x", {"/": True, "/other": True}),
        ("User-agent: *\nDisallow: private", "x", {"/private": False}),
        ("User-agent: a\nUser-agent: b\nDisallow: /x", "a", {"/x": True}),
        ("User-agent: a\nUser-agent: b\nDisallow: /x", "b", {"/x": False}),
        ("User-agent: *\nDisallow: /a:b", "x", {"/a": False, "/a:b": False, "/b": True}),
        ("User-agent: *\nDisallow: /t\nAllow: /t", "x", {"/t": True}),
        ("", "x", {"/t": True}),
    ],
)
def test_robots(spark, text, agent, want):
    assert allowed(spark, text, agent, list(want)) == want


def test_robots_delay(spark):
    t = spark.createDataFrame([("o", "User-agent: *\nCrawl-delay: 2"), ("p", "User-agent: *\nDisallow:")], "origin string, text string")
    assert {r["origin"]: r["crawl_delay_ms"] for r in robots.select_agent(robots.parse(t), "x").collect()} == {"o": 2000.0, "p": None}


# ---- Markdown


def test_extract_markdown(spark):
    at = F.lit("t")
    a = value(spark, markdown.extract_markdown(F.lit("# Title\n\nBody"), F.lit("https://e.com/docs"), at))
    assert a == "---\nSource: https://e.com/docs\nFetched: t\n---\n# Title\n\nBody"
    b = value(spark, markdown.extract_markdown(F.lit("Body only"), F.lit("https://example.com/docs"), at))
    assert "# https://example.com/docs\n\nBody only" in b
    c = value(spark, markdown.extract_markdown(F.lit("intro\n\n## Later"), F.lit("u"), at))
    assert c.endswith("# Later\n\nintro\n\n## Later")


def test_href_target():
    assert rewrite.href_target("mailto:test@example.com", "https://e.com") is None
    assert rewrite.href_target("/docs", "https://example.com") == "https://example.com/docs"
    assert rewrite.href_target("https://example.com/docs/page#section", "https://e.com") == "https://example.com/docs/page"


def test_dom_links():
    page = '<a href="/in-scope/page">a</a><a href="https://other.com">b</a><a href="/skip.png">c</a><a href="/app.js">d</a><a href=/in-scope/page#x>e</a>'
    assert html.tree_links(html.parse(page), "https://example.com/", "https://example.com", "/") == ["https://example.com/in-scope/page"]
    based = '<base href="/deep/"><a href="x">a</a>'
    assert html.tree_links(html.parse(based), "https://example.com/", "https://example.com", "/") == ["https://example.com/deep/x"]


@pytest.mark.parametrize(
    "md,base,scope,want",
    [
        ('text <Tile id=1 href="/setup" /> more', "https://h.org/docs", "/docs", ["https://h.org/docs/setup"]),
        ("[Section](https://example.com/docs/page#anchor)", "https://example.com/docs", "/docs", ["https://example.com/docs/page"]),
        ("<Card href={'/a'} /> <Card href='/b' /> <Card href={x} />", "https://h.com/", "/", ["https://h.com/a", "https://h.com/b"]),
    ],
)
def test_markdown_links(md, base, scope, want):
    assert rewrite.page_links(md, base, base.split("/docs")[0].rstrip("/"), scope) == want


def relinked(md, current, known, scope=None):
    return rewrite.rewrite_document(md, current, rewrite.resolver(current, set(known).__contains__, None, scope))


def test_rewrite():
    at = "https://example.com/docs/intro"
    assert relinked("[Doc](https://example.com/docs/intro/overview)", at, ["https://example.com/docs/intro/overview"]) == "[Doc](overview/page.md)"
    page = "https://h.org/v2/start"
    front = "---\nSource: <https://h.org/v2/start> ↗\nFetched: x\n---\n"
    got = relinked(f"{front}\nread https://h.org/v2/faq, then [more](/faq#q 'title')\n", page, ["https://h.org/v2/faq"], "/v2")
    assert got == "---\nSource: https://h.org/v2/start\nFetched: x\n---\n\nread [https://h.org/v2/faq](../faq/page.md), then [more](../faq/page.md#q 'title')\n"
    assert relinked(got, page, ["https://h.org/v2/faq"], "/v2") == got  # once is enough
    assert relinked("see [away](//w.org/x)", page, []) == "see [away ↗](//w.org/x)"
    got = relinked("[Guide ↗](https://two.com/guide)", "https://one.com/docs/page", ["https://two.com/guide"])
    assert got.startswith("[Guide](") and "two_com/guide/page.md" in got and "↗" not in got
    assert relinked("[foo ](/x)", "https://h.com/", []) == "[foo](/x)"
    assert relinked("[![a](https://o.com/i.png)](https://o.com)", "https://h.com/", []) == "[![a ↗](https://o.com/i.png)](https://o.com)"
    fenced = "```\nhttps://h.com/a\n```\nhttps://h.com/a, `https://h.com/a`\n[r]: https://h.com/a x"
    assert relinked(fenced, "https://h.com/b", ["https://h.com/a"]) == "```\nhttps://h.com/a\n```\n[https://h.com/a](../a/page.md), `https://h.com/a`\n[r]: ../a/page.md x"


def test_link_check(spark):
    docs = [
        ("one.md", "---\nSource: https://one.example.com/docs/page\n---\n\n[Other ↗](https://two.example.com/guide)\n"),
        ("two.md", "---\nSource: https://two.example.com/guide\n---\n\nText\n"),
        ("none.md", "no source"),
    ]
    got = {r["file_path"]: r for r in linkcheck.link_check(spark.createDataFrame(docs, "file_path string, content string")).collect()}
    assert set(got) == {"one.md", "two.md"}
    assert "[Other](" in got["one.md"]["content"] and "↗" not in got["one.md"]["content"] and "two_example_com/guide/page.md" in got["one.md"]["content"]
    assert got["one.md"]["changed"] and not got["two.md"]["changed"]


@pytest.mark.parametrize(
    "paths,want",
    [(["/docs/a/b", "/docs/a/c"], "/docs/a"), (["/guide/z"], "/guide"), (["/v", "/w"], "/"), (["/"], "/"), (["/guide/z", "/guide/z"], "/guide/z")],
)
def test_scope_prefix(spark, paths, want):
    t = spark.createDataFrame([("o", p) for p in paths], "origin string, pathname string")
    assert linkcheck.scope_prefixes(t).first()["scope"] == want


# ---- HTML


@pytest.mark.parametrize(
    "page,want",
    [
        ('<a href="https://example.com">First line<br>Second line</a>', "[First line Second line](https://example.com)"),
        ('<a href="https://example.com"><h2>Sub</h2><h1>Main</h1></a>', "# [Sub Main](https://example.com)"),
        ("<table><tr><th>Col</th></tr><tr><td>Val</td></tr></table>", "| Col |\n| --- |\n| Val |"),
        ("<p>a <b>bold</b> and <em>soft</em> <del>gone</del></p><hr><p>x</p>", "a **bold** and _soft_ ~~gone~~\n\n* * *\n\nx"),
        ("<ul><li>one</li><li>two</li></ul><ol><li>x</li></ol>", "-   one\n-   two\n\n1.  x"),
        ("<pre><code class='language-py'>x = 1\n</code></pre>", "```py\nx = 1\n```"),
        ("<p>one<p>two", "one\n\ntwo"),
    ],
)
def test_to_markdown(page, want):
    assert html.to_markdown(html.parse(page)) == want


def test_clutter_and_content():
    page = "<html><head><title> T  x</title><script>var t='</p>'</script></head><body><nav>Menu</nav><main><p>Hello</p><a href='/n'>n</a></main><footer>End</footer></body>"
    main, clutter = html.strip_clutter(html.parse(page))
    assert html.collapse(main.content()) == "Hellon" and clutter == "<ul><li>Menu</li><li>End</li><li>var t='</p>'</li></ul>"
    d = html.extract(page, "https://h.com/a", "t")
    assert d["title"] == "T x" and d["links"] == ["https://h.com/n"] and d["markdown"].startswith("---\nSource: https://h.com/a\nFetched: t\n---\n\n# T x\nHello")
    assert "Menu" in d["llms_full_markdown"] and "Menu" not in d["markdown"]


#: A title cut inside an entity: without its semicolon, &quot still is a quotation mark (HTML Standard, named character references).
CUT = "<html><head><title>token = &quot</title></head><body><article><h1>token = &quot</h1><p>Said &quo; and &amp</p></article></body></html>"


def test_cut_entities_in_extracted_content():
    d = html.extract(CUT, "https://h.com/a", "t")
    assert d["title"] == 'token = "' and '# token = "\n\nSaid &quo; and &' in d["llms_markdown"]


def test_cut_entities_in_markdown():
    assert html.to_markdown(html.parse(CUT)) == 'token = "\n\n# token = "\n\nSaid &quo; and &'


def test_cut_entities_in_scraped_pages(spark):
    from tidewell.plans import commands

    pages = spark.createDataFrame([("https://h.com/a", CUT)], "url string, html string")
    (one,) = commands.scrape_urls(pages, pages.select("url"), "t").collect()
    assert '# token = "\n\nSaid &quo; and &' in one["markdown"]


def test_cut_entities_in_stripped_pages():
    main, _ = html.strip_clutter(html.parse(CUT))
    assert html.collapse(main.content()) == 'token = "Said &quo; and &'


# ---- scheduling


def test_slots(spark):
    t = spark.createDataFrame([("o", i, t) for i, t in enumerate((0, 10, 1000, 1010))] + [("p", 0, 5)], "origin string, seq long, now_ms long")
    got = schedule.politeness_slots(t, 150).orderBy("origin", "seq").collect()
    assert [r["slot_ms"] for r in got] == [0, 150, 1000, 1150, 5]
    assert [r["slot_ms"] for r in schedule.politeness_slots(t, 0).orderBy("origin", "seq").collect()] == [0, 10, 1000, 1010, 5]


def test_ewma(spark):
    assert value(spark, schedule.ewma(F.array(*map(F.lit, (100.0, 300.0, 0.0, 400.0))), 200)) == pytest.approx(266.3)
    t = spark.createDataFrame([("k", i, v) for i, v in enumerate((100.0, 300.0, 0.0, 400.0))], "k string, seq int, v double")
    assert schedule.ewma_by(t, "k", "seq", "v", 200).first()["ewma"] == pytest.approx(266.3)


def test_durations(spark):
    assert [value(spark, tx.format_duration(F.lit(ms))) for ms in (1, 59_400, 60_000, 125_500)] == ["1s", "59s", "1m 0s", "2m 6s"]


# ---- crawl, sources, sinks


def test_bfs_depth_budget_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "e")], "url string, target string")
    seed = spark.createDataFrame([("a",)], "url string")
    depth = {r["url"]: r["depth"] for r in crawl.bfs(seed, links, max_depth=2).collect()}
    assert depth == {"a": 0, "b": 1, "e": 1, "c": 2}
    assert crawl.bfs(seed, links, max_pages=2).count() == 2
    ok = spark.createDataFrame([(x,) for x in "abd"], "url string")
    assert {r["url"] for r in crawl.bfs(seed, links, allowed=ok).collect()} == {"a", "b"}


def test_url_list(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# c\n\nhttps://a.com\r\n https://b.com \nhttps://a.com\n")
    assert [r["url"] for r in corpus.read_url_file(spark, str(f), "https://b.com").orderBy("pos").collect()] == ["https://b.com", "https://a.com"]


def test_files_round_trip(spark, tmp_path):
    out = str(tmp_path / "docs")
    docs = spark.createDataFrame([("https://h.com/a", "page", "", "l", "f"), ("https://h.com/A", "later", "c", "l", "f")], "url string, markdown string, clutter_markdown string, llms_markdown string, llms_full_markdown string")
    files = corpus.page_files(docs, out, clutter=True, overwrite_llms=True)
    assert corpus.write_files(files).count() == 4
    found = {r["path"]: r["content"] for r in corpus.read_tree(spark, out).collect()}
    assert found == {"h_com/a/page.md": "later", "h_com/a/.llms.md": "l", "h_com/a/llms-full.md": "f"}
    assert corpus.read_tree(spark, out, for_links=True).count() == 4
    assert corpus.page_files(docs, out).count() == 1


def test_snapshot_fetch(spark):
    long = "<p>" + "x" * 300
    pages = spark.createDataFrame([("https://h.com/a", long), ("https://h.com/b", "<p>short"), ("https://h.com/c", "<p>short"), ("https://h.com/m", long), ("https://h.com/x.js", long)], "url string, html string")
    md = spark.createDataFrame([("https://h.com/m.md", "# M"), ("https://h.com/a.md", "  ")], "url string, text string")
    live = spark.createDataFrame([("https://h.com/b", long)], "url string, html string")
    frontier = pages.select("url").union(spark.createDataFrame([("https://h.com/none",)], "url string"))
    got = {r["url"][14:]: r["source"] for r in fetch.from_snapshot(frontier, pages, md, live).collect()}
    assert got == {"a": "html", "b": "rendered", "c": "html", "m": "markdown", "none": "missing"}
    assert {r["source"] for r in fetch.from_snapshot(frontier, pages, md, live, render=False).collect()} == {"html", "markdown", "missing"}


def test_retries():
    calls = []

    def fails():
        calls.append(1)
        raise OSError("HTTP 404 Not Found")

    assert fetch.with_retries(fails, 2) == (None, "HTTP 404 Not Found") and len(calls) == 3


def test_http_source_with_a_given_getter(spark):
    t = spark.createDataFrame([("https://h.com/a",), ("https://h.com/b.css",)], "url string")
    assert [tuple(r) for r in fetch.over_http(t, get=lambda u: u.upper()).collect()] == [("https://h.com/a", "HTTPS://H.COM/A", None)]


def test_crawl_site_end_to_end(spark):
    from tidewell.plans import commands

    body = "<p>" + "word " * 80 + "</p>"
    pages = [("https://h.com/docs", f"{body}<a href='/docs/a'>A</a><a href='/blog'>B</a>"), ("https://h.com/docs/a", f"{body}<a href='/docs/b'>b</a><a href='/docs/secret'>s</a>"), ("https://h.com/docs/b", f"{body}<a href='/docs/c'>c</a>"), ("https://h.com/docs/c", body), ("https://h.com/docs/secret", body), ("https://h.com/blog", body)]
    txt = spark.createDataFrame([("https://h.com", "User-agent: *\nDisallow: /docs/secret")], "origin string, text string")
    got = {r["url"]: r for r in commands.crawl_site(spark.createDataFrame(pages, "url string, html string"), "https://h.com/docs", "t", max_depth=2, robots_txt=txt).collect()}
    assert {u: r["depth"] for u, r in got.items()} == {"https://h.com/docs": 0, "https://h.com/docs/a": 1, "https://h.com/docs/b": 2}
    assert "[b](../b/page.md)" in got["https://h.com/docs/a"]["llms_full_markdown"]


@pytest.fixture
def site():
    """A site on the loopback device: (origin, requests made as (path, accept))."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    body = "<p>" + "word " * 80 + "</p>"
    held = {
        "/robots.txt": "User-agent: *\nDisallow: /docs/secret\nCrawl-delay: 0.01",
        "/docs": f"<title>Docs</title>{body}<a href='/docs/a'>A</a><a href='/docs/gone'>G</a><a href='/docs/secret'>S</a><a href='/blog'>B</a><a href='/docs/x.css'>X</a>",
        "/docs/a.md": "# A\n\n[b](/docs/b) and [far](https://far.example.org/)\n",
        "/docs/b": f"{body}<a href='/docs/c'>c</a>",
        "/docs/c": body,
    }
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Accept")))
            text = held.get(self.path)
            self.send_response(404 if text is None else 200)
            self.end_headers()
            self.wfile.write((text or "").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_live_crawl(spark, site):
    from tidewell.options import CrawlOptions
    from tidewell.plans import commands

    at, asked = site
    options = CrawlOptions(delay_ms=1, retries=1, max_depth=2, user_agent="tester")
    got = {r["url"].removeprefix(at): r for r in commands.crawl_live(spark, f"{at}/docs", "t", options).collect()}
    assert {u: r["depth"] for u, r in got.items()} == {"/docs": 0, "/docs/a": 1, "/docs/b": 2}
    assert "# A" in got["/docs/a"]["markdown"] and "[b](../b/page.md)" in got["/docs/a"]["markdown"] and "[far ↗](https://far.example.org/)" in got["/docs/a"]["markdown"]
    paths = [p for p, _ in asked]
    assert paths.count("/docs/gone") == 2 and paths.count("/docs/gone.md") == 1 and paths.count("/docs/a") == 0
    assert not {"/docs/secret", "/blog", "/docs/x.css", "/docs/c"} & set(paths)
    assert ("/docs/a.md", fetch.MARKDOWN_ACCEPT) in asked
    few = commands.crawl_live(spark, f"{at}/docs", "t", CrawlOptions(delay_ms=0, retries=0, max_pages=2))
    assert {r["url"].removeprefix(at) for r in few.collect()} == {"/docs", "/docs/a"}


def test_live_scrape_of_a_list(spark, site):
    from tidewell.options import CrawlOptions
    from tidewell.plans import commands

    at, _ = site
    wanted = spark.createDataFrame([(f"{at}/docs/a",), (f"{at}/docs/b#x",), (f"{at}/none",), ("not a url",)], "url string")
    got = {r["url"].removeprefix(at): r["markdown"] for r in commands.scrape_live(wanted, "t", CrawlOptions(delay_ms=0, retries=0)).collect()}
    assert set(got) == {"/docs/a", "/docs/b"} and "[b](../b/page.md)" in got["/docs/a"]


def test_live_requests_keep_their_distance(spark):
    import time

    t = spark.createDataFrame([(f"https://h.com/{i}", 100) for i in range(3)], "url string, delay_ms long")
    got = fetch.live(t, get=lambda url, accept: "" if accept else f"{url} {time.monotonic()}").collect()
    times = sorted(float(r["content"].split()[1]) for r in got)
    assert {r["source"] for r in got} == {"html"} and all(b - a >= 0.19 for a, b in zip(times, times[1:]))


def test_rendering_replaces_bare_pages(spark):
    rows = [("u1", "html", "<p>short", None), ("u2", "html", "<p>short", None), ("u3", "html", "x" * 300, None), ("u4", "missing", None, "e"), ("u5", "markdown", "# m", None)]
    t = spark.createDataFrame(rows, "url string, source string, content string, error string")
    got = {r["url"]: r["source"] for r in fetch.rendered(t, lambda u: "y" * 300 if u == "u1" else "z").collect()}
    assert got == {"u1": "rendered", "u2": "html", "u3": "html", "u4": "missing", "u5": "markdown"}


# ---- command line


@pytest.mark.parametrize(
    "argv,command,field,want",
    [
        (["https://example.com"], "crawl", "crawl_start", "https://example.com"),
        (["url", "https://example.com"], "url", "url", "https://example.com"),
        (["urls", "./urls.txt"], "urls", "urls_file", "./urls.txt"),
        (["crawl", "https://example.com", "--clutter"], "crawl", "clutter", True),
        (["https://example.com", "--no-clutter"], "crawl", "clutter", False),
        (["link-check", "-o", "./docs", "--verbose"], "link-check", "directory", "./docs"),
        (["linkcheck"], "link-check", "directory", ".docs"),
        (["find", "q", "-C", "0"], "find", "context_lines", 0),
        (["https://e.com", "--max-depth=7x", "--retries", "0"], "crawl", "max_depth", 7),
        (["https://e.com", "--Max-Depth=2", "--USER-AGENT=Bot/1"], "crawl", "user_agent", "Bot/1"),
        (["--version"], "version", "command", "version"),
    ],
)
def test_arguments(argv, command, field, want):
    a = cli.parse_args(argv)
    assert a.command == command and getattr(a, field) == want


@pytest.mark.parametrize("argv", [[], ["url"], ["crawl", "ftp://x"], ["find"]])
def test_bad_arguments(argv, capsys):
    with pytest.raises(SystemExit) as end:
        cli.parse_args(argv)
    said = capsys.readouterr().err
    assert end.value.code == 1 and said.startswith("usage: tidewell") and said.rstrip().splitlines()[-1].startswith("tidewell")


def test_help_names_all_commands(capsys):
    with pytest.raises(SystemExit) as end:
        cli.parse_args(["--help"])
    said = capsys.readouterr().out
    assert end.value.code == 0 and all(c in said for c in cli.COMMANDS)
    with pytest.raises(SystemExit):
        cli.parse_args(["crawl", "--help"])
    said = capsys.readouterr().out
    assert all(f"--{f}" in said for f in ("out-dir", "max-depth", "max-pages", "delay", "user-agent", "retries", "timeout", "no-clutter", "snapshot"))


def test_rewrite_of_several_columns_keeps_rows_apart(spark):
    rows = [("https://e.org/a", "[b](/b)", "[a](/a) [c](/c)"), ("https://e.org/a", "[c](/c)", None), ("https://e.org/a", "[c](/c)", None)]
    docs = spark.createDataFrame(rows, "url string, markdown string, other string")
    known = spark.createDataFrame([("https://e.org/a",), ("https://e.org/b",)], "url string")
    got = sorted(map(tuple, rewrite.rewrite(docs, known, "markdown", "other").collect()), key=repr)
    assert got == sorted([("https://e.org/a", "[b](../b/page.md)", "[a](page.md) [c](/c)"), *[("https://e.org/a", "[c](/c)", None)] * 2], key=repr)


def test_package_offers_the_commands(spark):
    import tidewell

    assert all(callable(getattr(tidewell, name)) for name in tidewell.__all__)
    with pytest.raises(AttributeError):
        tidewell.nothing  # noqa: B018
    body = "<title>T</title><main><p>Text of the page.</p><a href='/g/a'>in</a> <a href='/else'>out</a> <a href='/g'>self</a></main>"
    pages = spark.createDataFrame([("https://h.org/g#x", body), ("https://h.org/other", "no")], "url string, html string")
    one = tidewell.scrape_one(pages, "https://h.org/g?q=1", "now").collect()
    assert [(r["url"], r["links"]) for r in one] == [("https://h.org/g", ["https://h.org/g", "https://h.org/g/a"])]
    assert one[0]["markdown"].startswith("---\nSource: https://h.org/g\nFetched: now\n---\n\n# T\n") and "Text of the page." in one[0]["markdown"]
    assert tidewell.scrape_one(pages, "https://h.org/none", "now").count() == 0
