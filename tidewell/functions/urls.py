"""URL and path functions.

Columns here work on canonical absolute URLs (lower-case scheme and host, no
default port, path at least ``/``) and stay inside generated code. ``canonical``
makes such URLs out of any reference and base; it is the one part that needs
Python, and runs over Arrow batches.
"""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed value: endings of files that hold no page.
BLOCKED = "png|jpe?g|gif|svg|webp|ico|pdf|zip|tar|gz|mp4|mp3|woff2?|ttf|eot|css|js"
_URL = r"^([a-z][a-z0-9+.-]*)://([^/?#:]*)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- parts


def scheme(url) -> Column:
    return F.regexp_extract(_col(url), _URL, 1)


def hostname(url) -> Column:
    return F.regexp_extract(_col(url), _URL, 2)


def origin(url) -> Column:
    return F.regexp_extract(_col(url), r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def pathname(url) -> Column:
    p = F.regexp_extract(_col(url), _URL, 4)
    return F.when(p == "", F.lit("/")).otherwise(p)


def anchor_of(href) -> Column:
    """The ``#...`` of a reference, '' without one or if it is only the sign."""
    return F.regexp_extract(_col(href), r"(#.+)$", 1)


def normalize_for_queue(url) -> Column:
    """Without query and fragment; a trailing slash is kept."""
    return F.regexp_replace(_col(url), r"[?#][\s\S]*$", "")


# ---- names


def sanitize_segment(segment) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(_col(segment), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(s == "", F.lit("index")).otherwise(s)


def snake_domain(host) -> Column:
    return sanitize_segment(host)


def output_dir(url) -> Column:
    """``host/segment/...`` of the page, ``host/root`` for the site root."""
    parts = F.filter(F.split(pathname(url), "/"), lambda x: x != "")
    path = F.array_join(F.transform(parts, lambda x: F.lower(sanitize_segment(x))), "/")
    return F.concat(snake_domain(hostname(url)), F.lit("/"), F.when(path == "", F.lit("root")).otherwise(path))


def output_paths(url, out_dir: str = ".docs") -> Column:
    """struct dir, page_path, clutter_path, llms_path, llms_full_path."""
    d = F.concat(F.lit(out_dir.rstrip("/") + "/"), output_dir(url))
    names = {"page_path": "page.md", "clutter_path": ".clutter.md", "llms_path": ".llms.md", "llms_full_path": "llms-full.md"}
    return F.struct(d.alias("dir"), *(F.concat(d, F.lit("/" + n)).alias(k) for k, n in names.items()))


def markdown_candidate(url) -> Column:
    """Where a Markdown source of the page would be; the query is kept."""
    u = F.regexp_replace(_col(url), r"#[\s\S]*$", "")
    query = F.regexp_extract(u, r"(\?[\s\S]*)$", 1)
    path, low = pathname(u), F.lower(pathname(u))
    bare = F.regexp_replace(path, r"/+$", "")
    new = (
        F.when(low.endswith(".md") | low.endswith(".txt"), path)
        .when(path == "/", F.lit("/llms.txt"))
        .when(bare == "", F.lit("/llms.txt"))
        .when(path.endswith("/") & F.lower(bare).endswith(".md"), bare)
        .otherwise(F.concat(bare, F.lit(".md")))
    )
    return F.concat(origin(u), new, query)


def normalize_rule_path(rule) -> Column:
    r = _col(rule)
    return F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))


def truncate_url(url, width: int) -> Column:
    """At most ``width`` characters: the tail of a long path, else the head of host and path."""
    u = _col(url)
    path = F.concat(pathname(u), F.regexp_extract(u, _URL, 5))
    tail = F.concat(F.lit("..."), F.substring(path, -(width - 3), width - 3))
    head = F.concat(F.substring(F.concat(hostname(u), path), 1, width - 3), F.lit("..."))
    cut = F.when(F.length(path) > width - 3, tail).otherwise(head)
    return F.when(F.length(u) <= width, u).when(u.rlike(_URL), cut).otherwise(F.concat(F.substring(u, 1, width - 3), F.lit("...")))


# ---- predicates


def is_html_candidate(path) -> Column:
    """Not a file of a kind that holds no page."""
    return ~F.lower(_col(path)).rlike(rf"\.({BLOCKED})\z")


def is_blocked_download(path) -> Column:
    return F.lower(_col(path)).rlike(r"\.(css|js)\z")


def is_path_in_scope(path, scope) -> Column:
    """Segment-aware: ``/docs`` holds ``/docs`` and ``/docs/a``, not ``/docs2``."""
    p, s = _col(path), _col(scope)
    bare = F.regexp_replace(s, r"/\z", "")
    return (s == "/") | (p == bare) | p.startswith(F.concat(bare, F.lit("/")))


def is_external(href, target, current) -> Column:
    """A reference that leads to another origin over HTTP."""
    h = _col(href)
    plain = (h != "") & ~h.startswith("#") & ~h.startswith("mailto:") & ~h.startswith("tel:")
    return F.coalesce(plain & scheme(target).isin("http", "https") & (origin(target) != origin(current)), F.lit(False))


def apply_scope(href, target, scope) -> Column:
    """Root-relative references that leave the scope are moved below it."""
    h, t, s = _col(href), _col(target), _col(scope)
    moves = (s != "/") & h.startswith("/") & ~is_path_in_scope(pathname(t), s)
    return F.when(moves, F.concat(origin(t), F.regexp_replace(s, r"/\z", ""), pathname(t))).otherwise(t)


def relative_path(from_dir, to_path) -> Column:
    """``to_path`` as seen from the folder ``from_dir``; both start at the same root."""
    a, b = F.split(_col(from_dir), "/"), F.split(_col(to_path), "/")
    same = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1),
        F.lit(0),
        lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n),
    )
    up = F.repeat(F.lit("../"), F.size(a) - same)
    return F.concat(up, F.array_join(F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0))), "/"))


# ---- Source lines


def pick_source_candidate(label, href) -> Column:
    a, b = _col(label), _col(href)
    return F.when(a.rlike("(?i)^https?://"), a).when(b.rlike("(?i)^https?://"), b).otherwise(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def normalize_source_value(value) -> Column:
    """Without the external marker, unwrapped from ``[label](href)`` or ``<url>``."""
    v = F.trim(F.regexp_replace(_col(value), r"\s*↗\s*$", ""))
    link = r"^\[(.+?)\]\((.+?)\)$"
    label, href = F.trim(F.regexp_extract(v, link, 1)), F.trim(F.regexp_extract(v, link, 2))
    auto = F.trim(F.regexp_extract(v, r"^<(.+)>$", 1))
    return F.when(v == "", F.lit(None).cast("string")).when(v.rlike(link), pick_source_candidate(label, href)).when(v.rlike(r"^<.+>$"), F.nullif(auto, F.lit(""))).otherwise(v)


#: What a path may hold as it is; all else is percent-encoded.
PATH_SAFE = r"A-Za-z0-9/%:@!$&'()*+,;=._~\[\]|\^-"


def percent_encoded(url) -> Column:
    """A URL without query and fragment with its unsafe and non-ASCII characters percent-encoded (UTF-8)."""
    u = _col(url)
    parts = F.regexp_extract_all(u, F.lit(f"[{PATH_SAFE}]+|[^{PATH_SAFE}]+"), F.lit(0))
    code = lambda p: F.when(p.rlike(f"^[{PATH_SAFE}]"), p).otherwise(F.regexp_replace(F.url_encode(p), r"\+", "%20"))
    return F.when(u.rlike(f"[^{PATH_SAFE}]"), F.array_join(F.transform(parts, code), "")).otherwise(u)


# ---- native resolution for plain references


def resolve_plain(href, base) -> Column:
    """Absolute URL of an absolute, root-relative, ``#`` or ``?`` reference, null for others.

    Covers what pages hold for the most part without leaving generated code;
    ``canonical`` is the general form. Paths are not percent-encoded.
    """
    h, b = _col(href), _col(base)
    return (
        F.when(h.rlike("^https?://[^/?#]+$"), F.concat(h, F.lit("/")))
        .when(h.rlike("^https?://"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(b), h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin(b), pathname(b), h))
    )


# ---- the general form

_DEFAULT_PORT = {"http": 80, "https": 443}
_SPECIAL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")


def canonical_url(href: str | None, base: str | None = None) -> str | None:
    """A reference resolved and normalised the way browsers do, or None if invalid.

    Lower-case host (IDNA), no default port, dot segments gone, path at least
    ``/``, unsafe and non-ASCII characters percent-encoded.
    """
    if href is None:
        return None
    text = re.sub(r"[\t\r\n]", "", href.strip(" \t\r\n\f\x0b"))
    if re.match(r"(?i)^https?:", text) or (base and not _SPECIAL.match(text)):
        text = text.replace("\\", "/") if "?" not in text and "#" not in text else text
    try:
        joined = urljoin(base, text) if base else text
        parts = urlsplit(joined)
        if not parts.scheme or (parts.scheme in _DEFAULT_PORT and not parts.hostname):
            return None
        if parts.scheme not in _DEFAULT_PORT:
            return joined
        host = parts.hostname
        if re.search(r"[\s<>^|%\\]", host):
            return None
        if not host.isascii():
            host = host.encode("idna").decode("ascii")
        if ":" in host:
            host = f"[{host}]"
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    where = host if port is None or port == _DEFAULT_PORT[parts.scheme] else f"{host}:{port}"
    user = parts.netloc.rpartition("@")[0]
    path = _no_dots(quote(parts.path or "/", safe="/%:@!$&'()*+,;=-._~[]|^"))
    query = "?" + quote(parts.query, safe="/%:@!$&()*+,;=-._~?[]|^`{}\\") if parts.query else ""
    fragment = "#" + quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?#[]|^{}\\") if parts.fragment else ""
    return f"{parts.scheme}://{user + '@' if user else ''}{where}{path}{query}{fragment}"


def _no_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif low == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


@pandas_udf(StringType())
def canonical(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical_url(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def href_target(href: str, current: str, base: str | None = None) -> str | None:
    """The page that a reference leads to, without query and fragment; None if none."""
    if not href or href.startswith(("#", "mailto:", "tel:")):
        return None
    full = canonical_url(href, base or current)
    if not full or not full.startswith(("http://", "https://")):
        return None
    return re.sub(r"[?#].*$", "", full, flags=re.S)
