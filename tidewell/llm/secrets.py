"""Secrets: Aho-Corasick keyword prefilter, anchored expressions near the hits, checksums.

Regular expressions are only tried where the automaton found a keyword. The
keywords of hexadecimal runs are all groups of four such digits; the first
group in a run is where it begins, as a shorter run is too short to report.
Tokens that embed a checksum of themselves are reported only if it holds.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
from pyspark.sql import DataFrame

from tidewell.llm.spans import Span, folded, span_table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")

_ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Length of the groups of hexadecimal digits that are keywords.
GROUP = 4
#: Three letters, an underscore, 30 letters or digits and six base-62 digits of their CRC-32.
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out.rjust(width, "0")


@lru_cache(maxsize=1)
def finder():
    """Gives the function text -> spans; spans of a kind never overlap."""
    words = ahocorasick.Automaton()
    for w in ASSIGNED:
        words.add_word(w, ("assign", len(w)))
    for w in PREFIXED:
        words.add_word(w, ("token", len(w)))
    words.add_word("akia", ("access", 4))
    for g in product("0123456789abcdef", repeat=GROUP):
        words.add_word("".join(g), ("hex", GROUP))
    words.make_automaton()

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        ended = {"assign": 0, "access": 0, "token": 0, "hex": 0}
        for last, (kind, size) in words.iter(folded(text)):  # no keyword holds another of its kind, so they come by start
            at = last + 1 - size
            if at < ended[kind]:
                continue
            if kind == "hex":
                if m := _HEX.match(text, at):  # upper case digits are none
                    ended[kind] = m.end()
                    if m.end() - at >= 16:
                        out.append((kind, at, m.end()))
            elif kind == "assign":
                if m := _ASSIGN.match(text, at):
                    ended[kind] = m.end()
                    if len(m[1]) >= 12:
                        out.append((kind, at, m.end()))
            elif kind == "access":
                if m := _ACCESS.match(text, at):
                    ended[kind] = m.end()
                    if len(m[0]) >= 18:
                        out.append((kind, at, m.end()))
            elif (m := _TOKEN.match(text, at)) and base62(zlib.crc32(m[1].encode())) == m[2]:
                ended[kind] = m.end()
                out.append((kind, at, m.end()))
        return out

    return find


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start then
    kind. Base kinds are the leftmost non-overlapping matches of their kind
    that are long enough; tokens with a valid checksum come on top. A null
    text is empty and has no spans. Other columns are ignored.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    return span_table(docs, finder, BASE, lambda x: (x[1], rank[x[0]]))
