"""What plans must and must not hold, whatever the size of the tables."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tidewell.functions import batches
from tidewell.operators import html, rewrite
from tidewell.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    """The columns that each scan reads."""
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>(?=\n|$)", text)]


@pytest.mark.parametrize(
    "name,columns",
    [
        ("output_paths", {"page_id", "url"}),
        ("inlink_counts", {"url", "html"}),
        ("url_origin_split", {"page_id", "url"}),
        ("content_search", {"doc_id", "text"}),
        ("md_external_marker", {"doc_id", "lang"}),
        ("fence_state", {"doc_id", "text"}),
        ("scope_prefix_per_origin", {"url"}),
        ("links_per_host", {"url", "html"}),
        ("politeness_slots", {"event_id", "user_id"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    found = read_columns(plan(catalog.QUERIES[name](spark, SF)))
    assert found and all(c <= columns for c in found)


@pytest.mark.parametrize("name", ["page_links", "page_links_distinct", "inlink_counts", "link_existence", "robots_allowed", "content_search", "content_context", "fuzzy_paths", "fence_state", "md_inline_links", "md_extract", "unpivot_outputs", "politeness_slots", "duration_ewma", "two_stage_queue", "graceful_stop", "failure_summary"])
def test_hot_paths_stay_out_of_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow", text)


def test_top_results_are_taken_without_a_full_sort(spark):
    for name in ("fuzzy_topk", "find_merged_topk", "frontier_budget"):
        assert "TakeOrderedAndProject" in plan(catalog.QUERIES[name](spark, SF))


def test_pages_are_parsed_once_for_their_links(spark):
    """A filter on what a function gives is else moved below it, and the function run in a second worker."""
    df = catalog.QUERIES["tree_link_counts"](spark, SF)
    assert plan(df).count("ArrowEvalPython") == 1
    pages = spark.createDataFrame([(1, '<a href="/a">x</a><a href="/a#b">y</a>'), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = pages.select("page_id", html.content_links(F.col("html"), F.lit("https://h.com/")).alias("l")).where(F.size("l") > 0).collect()
    assert [tuple(r) for r in got] == [(1, ["https://h.com/a"])]


@pandas_udf(LongType())
def _held(text: pd.Series) -> pd.Series:
    return pd.Series([text.str.len().sum()] * len(text))


@pytest.mark.parametrize(
    "step",
    [
        lambda d: d.select(html.extract_content(F.col("markdown"), F.col("url"), F.lit(""))),
        lambda d: d.select(html.content_links(F.col("markdown"), F.col("url"))),
        lambda d: d.select(html.html_to_markdown("markdown")),
        lambda d: d.select(html.clutter_of("markdown")),
        lambda d: d.select(rewrite.markdown_links(F.col("markdown"), F.col("url"), F.lit("https://h.com"), F.lit("/"))),
        lambda d: rewrite.rewrite(d, d.select("url")),
    ],
)
def test_python_holds_documents_by_their_bytes(spark, step):
    """However many rows there are: 10,000 a batch are Spark's own bound."""
    docs = spark.range(0, 1500, 1, 1).select(F.lit("https://h.com/").alias("url"), F.repeat(F.lit("0123456789"), 1000).alias("markdown"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    step(docs)
    most = docs.select(_held("markdown").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * batches.BATCH_BYTES
