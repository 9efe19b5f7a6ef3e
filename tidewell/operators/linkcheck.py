"""Checking the links of a saved corpus: two passes over its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import markdown, rewrite
from tidewell.operators.crawl import staged


def common_prefix(low: Column, high: Column, n: Column) -> Column:
    """Longest common segment prefix of all paths from their least and greatest.

    A single path gives its first segment only; nothing in common gives /.
    """
    same = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(F.size(low), F.size(high)), F.lit(1)) - 1),
        F.lit(0),
        lambda k, i: F.when((k == i) & (F.get(low, i) == F.get(high, i)), k + 1).otherwise(k),
    )
    take = F.when(n == 1, F.least(F.lit(1), F.size(low))).otherwise(same)
    return F.concat(F.lit("/"), F.array_join(F.slice(low, F.lit(1), take), "/"))


def scope_prefixes(paths: DataFrame) -> DataFrame:
    """(origin, pathname) -> origin, scope, n_paths. Aggregates only a minimum and a maximum."""
    parts = F.filter(F.split("pathname", "/"), lambda x: x != "")
    return paths.select("origin", parts.alias("p")).groupBy("origin").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n_paths")).select("origin", common_prefix(F.col("lo"), F.col("hi"), F.col("n_paths")).alias("scope"), "n_paths")


def entries(docs: DataFrame) -> DataFrame:
    """(file_path, content) -> also url, origin, pathname; documents without a valid Source go."""
    url = urls.canonical(markdown.source_url("content"), F.lit(None).cast("string"))
    found = docs.withColumn("url", urls.normalize_for_queue(url)).where(F.col("url").rlike("^https?://"))
    return found.withColumns({"origin": urls.origin("url"), "pathname": urls.pathname("url")})


def link_check(docs: DataFrame) -> DataFrame:
    """(file_path, content) -> file_path, content, changed after relinking the corpus.

    The documents' own URLs need Python and are wanted by five parts of the
    plan, so they are written out once.
    """
    known = staged(entries(docs))
    scopes = scope_prefixes(known).select("origin", "scope")
    ready = known.join(scopes, "origin", "left").withColumns({"scope": F.coalesce("scope", F.lit("/")), "before": F.col("content")})
    done = rewrite.rewrite(ready, known, "content")
    return done.select("file_path", "content", (F.col("content") != F.col("before")).alias("changed"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("unchanged"))
