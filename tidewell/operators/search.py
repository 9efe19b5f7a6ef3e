"""Searching a saved corpus: fuzzy paths, lines with context, merged top k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def search_paths(files: DataFrame, query: str) -> DataFrame:
    """path -> path, score, indices of the files whose path matches."""
    hits = files.where(tx.fuzzy_prefilter(query, "path")).select("path", tx.fuzzy_match(query, "path").alias("m")).where("m is not null")
    return hits.select("path", F.col("m.score").alias("score"), F.col("m.indices").alias("indices"))


def content_matches(query: str, lines: str, context: int = 2):
    """array<struct> over an array of lines: one for each line that holds the query."""
    every = F.col(lines)
    hits = F.filter(F.transform(every, lambda line, i: F.struct(i.alias("i"), line.alias("line"), tx.substring_index(query, line).alias("at"))), lambda m: m["at"] >= 0)

    def one(m):
        return F.struct(
            (m["i"] + 1).alias("line_number"),
            m["line"].alias("line"),
            m["at"].alias("match_index"),
            F.lit(len(query)).alias("match_length"),
            F.slice(every, F.greatest(m["i"] - context, F.lit(0)) + 1, F.least(m["i"], F.lit(context))).alias("context_before"),
            F.slice(every, m["i"] + 2, F.lit(context)).alias("context_after"),
        )

    return F.transform(hits, one)


def search_content(files: DataFrame, query: str, context: int = 2) -> DataFrame:
    """(path, content) -> path, score, matches; no shuffle.

    A text is cut into lines once, below the expression that uses them; only
    lines with a match get their context.
    """
    held = files.where(F.lower("content").contains(query.lower())).select("path", F.split("content", "\n").alias("lines"))
    found = held.select("path", content_matches(query, "lines", context).alias("matches"))
    return found.where(F.size("matches") > 0).select("path", (F.size("matches") * 10.0 + len(query)).alias("score"), "matches")


def find(files: DataFrame, query: str, limit: int = 20, context: int = 2, files_only: bool = False, content_only: bool = False) -> DataFrame:
    """Both searches, best first; path results come before content on a tie, then by path."""
    paths = search_paths(files, query).select("path", "score", F.lit("path").alias("match_type"), "indices", F.lit(0).alias("n_matches"))
    content = search_content(files, query, context).select("path", "score", F.lit("content").alias("match_type"), F.lit(None).cast("array<int>").alias("indices"), F.size("matches").alias("n_matches"))
    if content_only:
        paths = paths.where("false")
    if files_only:
        content = content.where("false")
    return paths.unionByName(content).orderBy(F.desc("score"), F.desc("match_type"), "path").limit(limit)


def format_content(results: DataFrame, color: bool = False) -> DataFrame:
    """path, text: matches with numbered context lines, as a terminal shows them."""
    dim, cyan, off = ("\x1b[2m", "\x1b[36m", "\x1b[0m") if color else ("", "", "")

    def context(lines, first):
        return F.transform(lines, lambda x, i: F.concat(F.lit(dim + "  "), (first + i).cast("string"), F.lit(": "), x, F.lit(off)))

    def block(m):
        own = m["line"]
        if color:
            own = F.concat(F.call_function("substring", own, F.lit(1), m["match_index"]), F.lit("\x1b[1m\x1b[33m"), F.call_function("substring", own, m["match_index"] + 1, m["match_length"]), F.lit("\x1b[0m"), F.call_function("substring", own, m["match_index"] + m["match_length"] + 1))
        shown = F.concat(F.lit("  "), m["line_number"].cast("string"), F.lit(": "), own)
        parts = F.concat(context(m["context_before"], m["line_number"] - F.size(m["context_before"])), F.array(shown), context(m["context_after"], m["line_number"] + 1), F.array(F.lit("")))
        return F.array_join(parts, "\n")

    return results.select("path", F.concat(F.lit(cyan), F.col("path"), F.lit(off + "\n"), F.array_join(F.transform("matches", block), "\n")).alias("text"))
