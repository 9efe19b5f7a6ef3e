"""The streaming forms against the batch forms."""

from pyspark.sql import functions as F

from tidewell.operators import schedule
from tidewell.streaming import jobs


def run(spark, df, name, mode, tmp_path):
    # state that times out would ask for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    q.stop()
    assert ended
    return spark.table(name)


def parts(spark, rows, schema, tmp_path, n=3):
    """Rows as a stream of n files."""
    at = str(tmp_path / "in")
    for i in range(n):
        spark.createDataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_slots_keep_state_between_batches(spark, tmp_path):
    rows = [(f"o{i % 2}", i, i * 10) for i in range(30)]
    schema = "origin string, seq long, now_ms long"
    got = run(spark, jobs.slots(parts(spark, rows, schema, tmp_path), 150), "slots", "append", tmp_path).collect()
    by = {}
    for r in got:
        by.setdefault(r["origin"], []).append(r["slot_ms"])
    want = schedule.politeness_slots(spark.createDataFrame(rows, schema), 150).collect()
    assert len(got) == len(rows)
    for o in ("o0", "o1"):
        assert sorted(by[o]) == sorted(r["slot_ms"] for r in want if r["origin"] == o)
        assert all(b - a >= 150 for a, b in zip(sorted(by[o]), sorted(by[o])[1:], strict=False))


def test_states_follow_the_latest_event(spark, tmp_path):
    rows = [(i % 4, i, f"t{i}") for i in range(20)]
    schema = "job_id long, seq long, type string"
    got = run(spark, jobs.states(parts(spark, rows, schema, tmp_path)), "states", "complete", tmp_path).collect()
    assert {(r["job_id"], r["state"], r["n_events"]) for r in got} == {(0, "t16", 5), (1, "t17", 5), (2, "t18", 5), (3, "t19", 5)}


def test_fresh_links_come_once(spark, tmp_path):
    rows = [(f"u{i % 5}", i) for i in range(30)]
    stream = parts(spark, rows, "url string, s long", tmp_path).select("url", F.timestamp_seconds("s").alias("seen_at"))
    got = run(spark, jobs.fresh_links(stream), "fresh", "append", tmp_path).collect()
    assert sorted(r["url"] for r in got) == [f"u{i}" for i in range(5)]
