"""Politeness slots, moving averages, worker targets, job states and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def politeness_slots(requests: DataFrame, delay_ms) -> DataFrame:
    """(origin, seq, now_ms) plus slot_ms: each origin's requests a delay apart.

    slot(i) = max(now(i), slot(i - 1) + delay) in closed form, as a running
    maximum; a delay of 0 or less gives now. An origin's requests are ordered
    one after another on purpose, that is what the slots are for.
    """
    d = F.lit(delay_ms).cast("bigint") if isinstance(delay_ms, int) else delay_ms
    order = Window.partitionBy("origin").orderBy("seq")
    n = F.row_number().over(order)
    lead = requests.withColumns({"__n": n, "__d": F.greatest(d, F.lit(0).cast("bigint"))}).withColumn("__t", F.col("now_ms") - F.col("__n") * F.col("__d"))
    running = F.max("__t").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lead.withColumn("slot_ms", F.when(F.col("__d") == 0, F.col("now_ms")).otherwise(F.col("__n") * F.col("__d") + running)).drop("__n", "__d", "__t")


def effective_delay(option_ms, robots_ms) -> Column:
    return F.greatest(option_ms, F.coalesce(robots_ms, F.lit(0)))


def ewma(samples, prior: float, alpha: float = 0.3) -> Column:
    """Moving average over array<double> in order; samples that are not above 0 are skipped."""
    return F.aggregate(samples, F.lit(float(prior)), lambda a, x: F.when((x > 0) & (x < float("inf")), alpha * x + (1 - alpha) * a).otherwise(a))


def ewma_by(rows: DataFrame, key: str, seq: str, value: str, prior: float, alpha: float = 0.3) -> DataFrame:
    """key, ewma as a weighted sum, so nothing is collected per key.

    With n samples the i-th weighs alpha * (1 - alpha)^(n - i) and the prior
    (1 - alpha)^n; the rank comes from a window over the key.
    """
    ok = rows.where((F.col(value) > 0) & (F.col(value) < float("inf")))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq))) - 1
    weighed = ok.select(key, (F.lit(alpha) * F.pow(F.lit(1 - alpha), back) * F.col(value)).alias("w"))
    return weighed.groupBy(key).agg((F.sum("w") + F.lit(float(prior)) * F.pow(F.lit(1 - alpha), F.count("*"))).alias("ewma"))


def worker_targets(pending_md, inflight_md, pending_html, inflight_html, avg_md, avg_html, miss_rate, most: int) -> Column:
    """struct total, markdown, hybrid: workers that drain the queues in six seconds."""
    demand_md = pending_md + inflight_md
    demand_html = pending_html + inflight_html + demand_md * F.least(F.greatest(miss_rate, F.lit(0.0)), F.lit(1.0))
    work_md, work_html = demand_md * F.greatest(avg_md, F.lit(1.0)), demand_html * F.greatest(avg_html, F.lit(1.0))
    work = work_md + work_html
    total = F.when(demand_md + pending_html + inflight_html > 0, F.least(F.greatest(F.ceil(work / 6000), F.lit(2)), F.lit(most))).otherwise(F.lit(2)).cast("int")
    half = F.floor(F.when(work > 0, total * work_md / F.nullif(work, F.lit(0.0))).otherwise(total / 2) + 0.5)
    md = F.least(F.greatest(half, F.lit(1)), total - 1).cast("int")
    return F.struct(total.alias("total"), md.alias("markdown"), F.greatest(total - md, F.lit(1)).alias("hybrid"))


def latest_state(events: DataFrame) -> DataFrame:
    """(job_id, seq, type) -> job_id, state, n_events, started_seq (first fetch)."""
    return events.groupBy("job_id").agg(F.max_by("type", "seq").alias("state"), F.count("*").alias("n_events"), F.min(F.when(F.col("type") == "fetch", F.col("seq"))).alias("started_seq"))


def with_job(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages (job_id, ...) with the columns of their job; those of unknown jobs are dropped, as are repeats of a job."""
    return messages.join(jobs.dropDuplicates(["job_id"]), "job_id")


def counters(jobs: DataFrame) -> DataFrame:
    """saved, failed, visited, skipped of (outcome) rows."""
    saved, failed = F.count_if(F.col("outcome") == "completed"), F.count_if(F.col("outcome") == "failed")
    return jobs.agg(saved.alias("saved"), failed.alias("failed"), F.count("*").alias("visited"), (F.count("*") - saved).alias("skipped"))


def bench_stats(rows: DataFrame) -> DataFrame:
    """(worker_type, outcome, duration_ms, links_discovered) -> statistics of each type."""
    done = F.col("outcome") == "completed"
    return rows.groupBy("worker_type").agg(
        F.count("*").alias("n"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "markdownUnavailable").alias("unavailable"),
        F.count_if(F.col("outcome") == "timeout").alias("timeout"),
        F.avg("duration_ms").alias("avg_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum(F.when(done, F.coalesce("links_discovered", F.lit(0)))).alias("links"),
    )


def failure_summary(rows: DataFrame, shown: int = 3) -> DataFrame:
    """(url, error) -> error, n, urls: how many pages failed for each reason, and the first of them.

    Rows without an error are no failures. Only the least urls of a reason
    travel, so a reason that all pages share is no burden.
    """
    failed = rows.where("error is not null").select("error", "url")
    counts = failed.groupBy("error").agg(F.count("*").alias("n"))
    rest, least = failed.distinct(), []
    for _ in range(max(1, shown)):  # a few minimum aggregates, no sort of all pages of a reason
        least.append(rest.groupBy("error").agg(F.min("url").alias("url")))
        rest = rest.join(least[-1], ["error", "url"], "left_anti")
    some = reduce(DataFrame.unionByName, least).groupBy("error").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return counts.join(some, "error", "left")


def pool_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("busy").alias("in_flight"))


def stage_hops(attempts: DataFrame) -> DataFrame:
    """(job_id, seq, worker_type, outcome) -> job_id, stage, outcome, attempts: the two-stage queue.

    A job's first attempt of each kind counts. It begins with markdown and
    hops to hybrid when its source is unavailable; a job that was never tried
    as markdown, or whose hop was never tried, is pending there.
    """
    first = lambda kind: F.min_by(F.when(F.col("worker_type") == kind, F.col("outcome")), F.when(F.col("worker_type") == kind, F.col("seq")))
    tried = attempts.groupBy("job_id").agg(first("markdown").alias("md"), first("hybrid").alias("html"), F.count("*").alias("attempts"))
    hop = F.col("md") == "markdownUnavailable"
    stage = F.when(hop, F.lit("hybrid")).otherwise(F.lit("markdown"))
    return tried.select("job_id", stage.alias("stage"), F.coalesce(F.when(hop, F.col("html")).otherwise(F.col("md")), F.lit("pending")).alias("outcome"), "attempts")


def idle_workers(events: DataFrame, now_ms, timeout_ms: int = 45_000) -> DataFrame:
    """(worker, now_ms) -> worker, last_ms, exits: workers without an event for the timeout go."""
    return events.groupBy("worker").agg(F.max("now_ms").alias("last_ms")).withColumn("exits", F.lit(now_ms) - F.col("last_ms") >= timeout_ms)


def stopped(jobs: DataFrame, most: int) -> DataFrame:
    """(seq, outcome) -> the same with stops: whether a graceful stop ends the job before it begins.

    Jobs are begun in order until ``most`` are completed; what is in flight is
    finished. The running count is over ranges of jobs first, then within.
    """
    size = 10_000
    done = (F.col("outcome") == "completed").cast("long")
    ranged = jobs.withColumns({"__r": F.floor(F.col("seq") / size), "__d": done})
    before = ranged.groupBy("__r").agg(F.sum("__d").alias("__n"))
    before = before.withColumn("__n", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("__d").over(Window.partitionBy("__r").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__w", within).join(before, "__r").withColumn("stops", F.col("__n") + F.col("__w") >= most).drop("__r", "__d", "__n", "__w")
