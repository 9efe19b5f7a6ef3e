"""Bounded breadth-first crawl over a link table, and batch scrapes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder on a single-process master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_seen(frontier: DataFrame) -> DataFrame:
    """One row per url: the first by (depth, seq). A minimum aggregate, not a sort."""
    return frontier.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("k")).select("url", "k.depth", "k.seq")


def bfs(seeds: DataFrame, links: DataFrame, max_depth: int = 4, max_pages: int | None = 6000, allowed: DataFrame | None = None) -> DataFrame:
    """(url) seeds over (url, target) links -> url, depth of the pages saved.

    Pages at ``max_depth`` are saved and not expanded. A level's pages are
    taken in order of url until ``max_pages`` are saved, all of them without
    such a budget; failures are pages
    that ``allowed`` does not hold, they use no budget. Every level is one
    join of the frontier with the links and one anti-join with all seen, and
    is written out, so the plan does not grow with depth.
    """
    edges = links.select("url", "target")
    frontier = seeds.select("url", F.lit(0).alias("depth")).distinct()
    if allowed is not None:
        frontier = frontier.join(allowed.select("url").distinct(), "url", "left_semi")
    within = lambda level, n: level if max_pages is None else level.orderBy("url").limit(max_pages - n)
    frontier = staged(within(frontier, 0))
    seen, saved = frontier, frontier.count()
    depth, fresh = 0, saved
    while depth < max_depth and fresh and (max_pages is None or saved < max_pages):
        reached = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        if allowed is not None:
            reached = reached.join(allowed.select("url").distinct(), "url", "left_semi")
        depth += 1
        frontier = staged(within(reached.select("url", F.lit(depth).alias("depth")), saved))
        fresh = frontier.count()
        saved += fresh
        seen = seen.unionByName(frontier)
    return seen


def budget(frontier: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` rows by (depth, seq)."""
    return frontier.orderBy("depth", "seq", "url").limit(max_pages)


def skipped(visited: DataFrame) -> DataFrame:
    """Rows of (url, depth, seq) that a page seen before makes redundant."""
    order = Window.partitionBy("url").orderBy("depth", "seq")
    return visited.withColumn("n", F.row_number().over(order)).where("n > 1").drop("n")
