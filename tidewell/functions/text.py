"""Scalar functions on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as web engines count it.
WS = r"[\t\n\x0B\f\r    -     　﻿]"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_whitespace(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), f"{WS}+", " "))


def text_length(html) -> Column:
    """Characters outside scripts, styles, tags and white space; entities count as written."""
    h = F.regexp_replace(_col(html), r"(?is)<script.*?</script>", "")
    h = F.regexp_replace(h, r"(?is)<style.*?</style>", "")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    return F.length(F.regexp_replace(h, f"{WS}+", ""))


def has_meaningful_text(html, least: int = 200) -> Column:
    return text_length(html) > least


def is_markdown_too_short(markdown, least: int = 200) -> Column:
    body = F.regexp_replace(_col(markdown), rf"(?s)\A---.*?---{WS}*", "")
    return F.length(F.regexp_replace(F.regexp_replace(body, rf"\A{WS}+", ""), rf"{WS}+\z", "")) < least


def parse_positive_int(raw, fallback) -> Column:
    """The integer that a string begins with, or the fallback if there is none above 0."""
    n = F.regexp_extract(_col(raw), r"^\s*([+-]?[0-9]{1,15})", 1).try_cast("bigint")
    other = F.lit(fallback) if isinstance(fallback, int) else _col(fallback)
    return F.when(n > 0, n).otherwise(other)


def crawl_delay_ms(value) -> Column:
    """Seconds as a decimal prefix to milliseconds, null if not a number."""
    return F.regexp_extract(_col(value), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double") * 1000


def iso_millis(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_duration(ms) -> Column:
    s = F.greatest(F.lit(1), F.floor(_col(ms) / 1000 + 0.5)).cast("bigint")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def eta_ms(elapsed_ms, current, total) -> Column:
    c, t = _col(current), _col(total)
    return F.when((c > 0) & (t > c), _col(elapsed_ms) / c * (t - c))


def highlight(text, indices) -> Column:
    """Characters at ``indices`` in bold yellow escape codes."""
    t, at = _col(text), _col(indices)
    marked = F.transform(F.split(t, ""), lambda c, i: F.when(F.array_contains(at, i), F.concat(F.lit("\x1b[1m\x1b[33m"), c, F.lit("\x1b[0m"))).otherwise(c))
    return F.when(F.size(at) == 0, t).otherwise(F.array_join(marked, ""))


# ---- rolling hash and Bloom positions

#: Seeds of the two rolling hashes.
SEEDS = (0x811C9DC5, 0x9E3779B1)


def rolling_hash(text, seed: int) -> Column:
    """h = h * 31 + code over the characters, modulo 2^32."""
    codes = F.transform(F.split(_col(text), ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(seed).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296).cast("bigint")))


def bloom_bits(capacity: int) -> tuple[int, int]:
    """Bits and hash functions for a capacity at ten bits an item."""
    import math

    return max(1, math.ceil(capacity * 10)), max(1, math.floor(10 * math.log(2) + 0.5))


def bloom_positions(text, capacity: int) -> Column:
    bits, k = bloom_bits(capacity)
    a, b = (rolling_hash(text, s) for s in SEEDS)
    return F.transform(F.array(*(F.lit(i).cast("bigint") for i in range(k))), lambda i: F.pmod(a + i * b, F.lit(bits).cast("bigint")))


# ---- fuzzy and substring matching


def fuzzy_match(query: str, target) -> Column:
    """struct score, indices of the greedy leftmost subsequence, null without one.

    Every matched character gives 10, 15 more right after the last match (the
    first position counts as such), 10 more at the start or after a
    separator, 2 more for the same case, less half its position; at least 1.
    """
    t = _col(target)
    low = F.lower(t)
    state = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("indices"), F.lit(True).alias("ok"))
    q = F.array(*(F.lit(c) for c in query)) if query else F.array().cast("array<string>")

    def step(s, c):
        at = F.call_function("locate", F.lower(c), low, s["at"] + 2) - 1
        before = F.call_function("substring", t, at, F.lit(1))
        gain = (
            F.lit(10.0)
            + F.when(s["at"] == at - 1, 15.0).otherwise(0.0)
            + F.when((at == 0) | before.rlike(r"[/\\_\-.\s]"), 10.0).otherwise(0.0)
            + F.when(F.call_function("substring", t, at + 1, F.lit(1)) == c, 2.0).otherwise(0.0)
            - at * 0.5
        )
        hit = s["ok"] & (at >= 0)
        return F.when(
            hit,
            F.struct(at.alias("at"), (s["score"] + F.greatest(gain, F.lit(1.0))).alias("score"), F.concat(s["indices"], F.array(at)).alias("indices"), F.lit(True).alias("ok")),
        ).otherwise(F.struct(s["at"].alias("at"), s["score"].alias("score"), s["indices"].alias("indices"), F.lit(False).alias("ok")))

    end = F.aggregate(q, state, step)
    return F.when(end["ok"], F.struct(end["score"].alias("score"), end["indices"].alias("indices")))


def fuzzy_prefilter(query: str, target) -> Column:
    """A cheap test that ``fuzzy_match`` can only pass where it holds."""
    import re

    pattern = ".*".join(re.escape(c.lower()) for c in query)
    return F.lower(_col(target)).rlike(f"(?s){pattern}")


def substring_index(query: str, line) -> Column:
    """0-based place of the query, whatever the case; -1 without one."""
    return F.instr(F.lower(_col(line)), query.lower()) - 1
