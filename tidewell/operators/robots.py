"""robots.txt as tables: parse, choose the agent, longest matching rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import urls


def parse(robots: DataFrame) -> DataFrame:
    """(origin, text) -> origin, pos, agent, kind, value: one row per directive.

    Each user-agent line replaces the agent before it; rules above the first
    are for ``*``. kind is agent, allow, disallow or delay; empty rules are
    left out. A value ends at a second colon.
    """
    lines = robots.select("origin", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parts = F.split(line, ":")
    named = lines.select("origin", "pos", F.lower(F.trim(F.get(parts, F.lit(0)))).alias("directive"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value")).where(F.col("directive").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("origin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.coalesce(F.last(F.when(F.col("directive") == "user-agent", F.lower("value")), ignorenulls=True).over(order), F.lit("*"))
    kind = F.when(F.col("directive") == "user-agent", "agent").when(F.col("directive") == "crawl-delay", "delay").otherwise(F.col("directive"))
    rule = F.when(kind.isin("allow", "disallow"), urls.normalize_rule_path("value")).otherwise(F.col("value"))
    out = named.select("origin", "pos", agent.alias("agent"), kind.alias("kind"), F.when(kind == "agent", F.lower("value")).otherwise(rule).alias("value"), (F.col("value") == "").alias("empty"))
    return out.where("kind = 'agent' or not empty").drop("empty")


def select_agent(parsed: DataFrame, user_agent: str) -> DataFrame:
    """One row per origin with a policy for the agent: origin, agent, crawl_delay_ms.

    The agent's exact name, else the first other that its name contains, else
    ``*``. The last delay of the chosen agent counts.
    """
    ua = user_agent.lower()
    per = parsed.groupBy("origin", "agent").agg(F.min("pos").alias("pos"), F.max_by(F.when(F.col("kind") == "delay", tx.crawl_delay_ms("value")), F.when((F.col("kind") == "delay") & tx.crawl_delay_ms("value").isNotNull(), F.col("pos"))).alias("crawl_delay_ms"))
    rank = F.when(F.col("agent") == ua, 0).when((F.col("agent") != "*") & F.lit(ua).contains(F.col("agent")), 1).when(F.col("agent") == "*", 2)
    return per.withColumn("rank", rank).where("rank is not null").groupBy("origin").agg(F.min_by(F.struct("agent", "crawl_delay_ms"), F.struct("rank", "pos")).alias("p")).select("origin", "p.agent", "p.crawl_delay_ms")


def rules_for(parsed: DataFrame, user_agent: str) -> DataFrame:
    """origin, kind, rule of the chosen agents."""
    chosen = select_agent(parsed, user_agent).select("origin", "agent")
    return parsed.where(F.col("kind").isin("allow", "disallow")).join(chosen, ["origin", "agent"]).select("origin", "kind", F.col("value").alias("rule")).distinct()


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with origin and path) plus ``allowed``.

    Rules are literal prefixes; the longest wins and a tie allows. Distinct
    paths are expanded to all their prefixes, so the match is an equi-join
    however many rules there are. Pages without origin or path are allowed.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.call_function("substring", F.col("path"), F.lit(1), n))
    best = (
        pages.where("path <> ''")
        .select("origin", "path")
        .distinct()
        .select("origin", "path", F.explode(prefixes).alias("rule"))
        .join(rules, ["origin", "rule"])
        .groupBy("origin", "path")
        .agg(F.max(F.when(F.col("kind") == "allow", F.length("rule"))).alias("__a"), F.max(F.when(F.col("kind") == "disallow", F.length("rule"))).alias("__d"))
    )
    return pages.join(best, ["origin", "path"], "left").select(*pages.columns, (F.coalesce("__a", F.lit(0)) >= F.coalesce("__d", F.lit(0))).alias("allowed"))
