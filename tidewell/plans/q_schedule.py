"""Queries of scheduling, job states and statistics, over ``events``; and the crawl loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import crawl, schedule
from tidewell.plans.catalog import query, table
from tidewell.plans.q_links import _LINKS, links_of
from tidewell.plans.q_urls import s_norm, s_origin

KINDS = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'failed' WHEN 'signup' THEN 'timeout' ELSE 'markdownUnavailable' END"


def jobs(spark, sf_dir):
    """Events as crawl jobs: origin, seq, now_ms, outcome, duration."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("https://h"), (F.col("user_id") % 40).cast("string")).alias("origin"),
        (F.col("event_id") * 37).alias("now_ms"),
        F.expr(KINDS).alias("outcome"),
        F.expr("case when event_id % 2 = 0 then 'markdown' else 'hybrid' end").alias("worker_type"),
        F.col("value").alias("duration_ms"),
        F.expr("case when event_id % 3 = 0 then cast(event_id % 50 as int) end").alias("links_discovered"),
        F.col("event_type").alias("type"),
    )


_JOBS = f"""jobs AS (SELECT event_id AS seq, user_id AS job_id, 'https://h' || (user_id % 40) AS origin, event_id * 37 AS now_ms, {KINDS} AS outcome,
    CASE WHEN event_id % 2 = 0 THEN 'markdown' ELSE 'hybrid' END AS worker_type, value AS duration_ms, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS links_discovered, event_type AS type FROM events)"""


@query(
    f"""WITH {_JOBS}, r AS (SELECT origin, seq, now_ms, row_number() OVER (PARTITION BY origin ORDER BY seq) AS n FROM jobs)
    SELECT origin, seq, CAST(n * 1500 + max(now_ms - n * 1500) OVER (PARTITION BY origin ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot_ms FROM r"""
)
def politeness_slots(spark, sf_dir):
    return schedule.politeness_slots(jobs(spark, sf_dir), 1500).select("origin", "seq", "slot_ms")


@query(f"WITH {_JOBS} SELECT seq, CAST(greatest(150, coalesce(CASE WHEN seq % 2 = 0 THEN seq % 400 END, 0)) AS BIGINT) AS delay_ms FROM jobs")
def effective_delay(spark, sf_dir):
    robots = F.when(F.col("seq") % 2 == 0, F.col("seq") % 400)
    return jobs(spark, sf_dir).select("seq", schedule.effective_delay(F.lit(150), robots).cast("bigint").alias("delay_ms"))


@query(
    f"""WITH {_JOBS}, k AS (SELECT worker_type, duration_ms, row_number() OVER (PARTITION BY worker_type ORDER BY seq DESC) - 1 AS back FROM jobs WHERE duration_ms > 0)
    SELECT worker_type, round(sum(0.3 * pow(0.7, back) * duration_ms) + 200 * pow(0.7, count(*)), 4) AS ewma FROM k GROUP BY worker_type"""
)
def duration_ewma(spark, sf_dir):
    return schedule.ewma_by(jobs(spark, sf_dir), "worker_type", "seq", "duration_ms", 200).select("worker_type", F.round("ewma", 4).alias("ewma"))


@query(
    """WITH t AS (SELECT event_id, event_id % 70 AS pm, event_id % 5 AS im, event_id % 90 AS ph, event_id % 7 AS ih, 100.0 + event_id % 300 AS am, 300.0 + event_id % 900 AS ah, (event_id % 100) / 100.0 AS r FROM events),
    w AS (SELECT *, (pm + im) * am AS wm, (ph + ih + (pm + im) * r) * ah AS wh FROM t),
    x AS (SELECT *, CASE WHEN pm + im + ph + ih > 0 THEN least(greatest(CAST(ceil((wm + wh) / 6000) AS BIGINT), 2), 12) ELSE 2 END AS total FROM w),
    y AS (SELECT *, least(greatest(CAST(floor(CASE WHEN wm + wh > 0 THEN total * wm / (wm + wh) ELSE total / 2.0 END + 0.5) AS BIGINT), 1), total - 1) AS md FROM x)
    SELECT event_id, total, md AS markdown, greatest(total - md, 1) AS hybrid FROM y"""
)
def autoscale_targets(spark, sf_dir):
    i = F.col("event_id")
    t = schedule.worker_targets(i % 70, i % 5, i % 90, i % 7, 100.0 + i % 300, 300.0 + i % 900, (i % 100) / 100.0, 12)
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", *(F.col(f"t.{c}").cast("bigint").alias(c) for c in ("total", "markdown", "hybrid")))


@query(
    f"""WITH {_JOBS} SELECT worker_type, count(*) AS n, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'markdownUnavailable') AS unavailable,
    count(*) FILTER (outcome = 'timeout') AS timeout, round(avg(duration_ms), 4) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, CAST(sum(coalesce(links_discovered, 0)) FILTER (outcome = 'completed') AS BIGINT) AS links FROM jobs GROUP BY worker_type"""
)
def worker_bench_stats(spark, sf_dir):
    return schedule.bench_stats(jobs(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 4)).withColumn("links", F.col("links").cast("bigint"))


@query(f"WITH {_JOBS} SELECT job_id, arg_max(type, seq) AS state, count(*) AS n_events, min(CASE WHEN type = 'view' THEN seq END) AS started_seq FROM jobs GROUP BY job_id")
def job_state_latest(spark, sf_dir):
    e = jobs(spark, sf_dir)
    renamed = e.withColumn("type", F.when(F.col("type") == "view", "fetch").otherwise(F.col("type")))
    return schedule.latest_state(renamed).withColumn("state", F.when(F.col("state") == "fetch", "view").otherwise(F.col("state")))


@query(f"WITH {_JOBS} SELECT count(*) FILTER (outcome = 'completed') AS saved, count(*) FILTER (outcome = 'failed') AS failed, count(*) AS visited, count(*) - count(*) FILTER (outcome = 'completed') AS skipped FROM jobs")
def crawl_counters(spark, sf_dir):
    return schedule.counters(jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT worker_type AS kind, count(*) AS n, count(*) FILTER (duration_ms > 50) AS in_flight FROM jobs GROUP BY worker_type")
def pool_counts(spark, sf_dir):
    return schedule.pool_counts(jobs(spark, sf_dir).select(F.col("worker_type").alias("kind"), (F.col("duration_ms") > 50).alias("busy")))


@query(
    f"""WITH {_JOBS}, p AS (SELECT origin, seq, sum(CASE WHEN outcome = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY seq) AS saved, count(*) OVER (PARTITION BY origin) AS total FROM jobs)
    SELECT origin, seq, CAST(saved AS BIGINT) AS saved, CASE WHEN saved > 0 AND total > saved THEN round(seq * 10.0 / saved * (total - saved), 4) END AS eta_ms FROM p"""
)
def progress_eta(spark, sf_dir):
    from pyspark.sql import Window

    from tidewell.functions import text as tx

    by = Window.partitionBy("origin")
    p = jobs(spark, sf_dir).select("origin", "seq", F.sum(F.when(F.col("outcome") == "completed", 1).otherwise(0)).over(by.orderBy("seq")).alias("saved"), F.count("*").over(by).alias("total"))
    return p.select("origin", "seq", F.col("saved").cast("bigint").alias("saved"), F.round(tx.eta_ms(F.col("seq") * 10.0, "saved", "total"), 4).alias("eta_ms"))


_BFS = f"""WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT {s_norm('url')} AS url, target FROM links), s AS (SELECT min({s_norm('url')}) AS url FROM pages GROUP BY {s_origin('url')}),
    b(url, depth) AS (SELECT url, 0 FROM s UNION SELECT e.target, b.depth + 1 FROM b JOIN e USING (url) WHERE b.depth < 4), f AS (SELECT url, min(depth) AS depth FROM b GROUP BY url)"""


def page_graph(spark, sf_dir):
    """The first page of every site, and the links between pages."""
    seeds = table(spark, sf_dir, "pages").groupBy(urls.origin("url")).agg(F.min(urls.normalize_for_queue("url")).alias("url")).select("url")
    return seeds, links_of(spark, sf_dir).select(urls.normalize_for_queue("url").alias("url"), "target").distinct()


@query(f"{_BFS} SELECT url, CAST(depth AS BIGINT) AS depth FROM f")
def crawl_bfs(spark, sf_dir):
    seeds, edges = page_graph(spark, sf_dir)
    return crawl.bfs(seeds, edges, max_pages=None).select("url", F.col("depth").cast("bigint").alias("depth"))


@query(f"{_BFS} SELECT url, CAST(depth AS BIGINT) AS depth FROM f ORDER BY f.depth, url LIMIT 25")
def crawl_bfs_budget(spark, sf_dir):
    seeds, edges = page_graph(spark, sf_dir)
    return crawl.bfs(seeds, edges, max_pages=25).select("url", F.col("depth").cast("bigint").alias("depth"))


_VISITS = "v AS (SELECT CAST(user_id AS VARCHAR) AS url, CAST(event_id % 5 AS INTEGER) AS depth, event_id AS seq FROM events)"


@query(f"WITH {_VISITS} SELECT url, CAST(depth AS BIGINT) AS depth, seq FROM v QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, seq) = 1")
def frontier_dedupe(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), (F.col("event_id") % 5).cast("int").alias("depth"), F.col("event_id").alias("seq"))
    return crawl.first_seen(v).select("url", F.col("depth").cast("bigint").alias("depth"), "seq")


@query(f"WITH {_VISITS} SELECT url, CAST(depth AS BIGINT) AS depth, seq FROM v ORDER BY v.depth, seq, url LIMIT 100")
def frontier_budget(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), (F.col("event_id") % 5).cast("int").alias("depth"), F.col("event_id").alias("seq"))
    return crawl.budget(v, 100).select("url", F.col("depth").cast("bigint").alias("depth"), "seq")
