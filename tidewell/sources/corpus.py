"""Saved corpora and URL lists: reading folders of Markdown, writing page files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import urls


def url_list(lines: DataFrame, url: str | None = None) -> DataFrame:
    """(pos, value) lines of a URL file -> pos, url: comments and blanks go, the first of equals stays.

    ``url`` comes before the file's lines.
    """
    kept = lines.select("pos", F.trim(F.regexp_replace("value", r"\r$", "")).alias("url")).where("url <> '' and not startswith(url, '#')")
    if url:
        kept = kept.unionByName(lines.sparkSession.createDataFrame([(-1, url)], "pos long, url string"))
    return kept.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def read_url_file(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    return url_list(text.select(F.col("pos").cast("long"), "value"), url)


def read_tree(spark: SparkSession, directory: str, for_links: bool = False) -> DataFrame:
    """path (relative), content of the Markdown files below a folder.

    Hidden files count, so the listing is made here and the files are read by
    the executors. Clutter files are only read for link checks. Links to
    folders are not followed.
    """
    found = []
    for d, _, names in os.walk(directory):
        for n in sorted(names):
            if n.endswith(".md") and (for_links or not n.endswith(".clutter.md")):
                found.append((os.path.relpath(os.path.join(d, n), directory), os.path.join(d, n)))
    listing = spark.createDataFrame(sorted(found), "path string, file string").repartition(max(1, len(found) // 500))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = [], []
            for path, file in zip(b.column("path").to_pylist(), b.column("file").to_pylist(), strict=True):
                try:
                    with open(file, encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                    paths.append(path)
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

    return listing.mapInArrow(read, "path string, content string")


def page_files(pages: DataFrame, out_dir: str = ".docs", clutter: bool = False, overwrite_llms: bool = False) -> DataFrame:
    """(url, markdown, clutter_markdown, llms_markdown, llms_full_markdown) -> kind, path, content.

    The page is always written, clutter if asked for and not empty, the two
    llms files only on request. Where pages share a path, the least URL wins.
    """
    paths = urls.output_paths("url", out_dir)

    def one(kind: str, content: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), paths[f"{kind}_path"].alias("path"), F.col(content).alias("content")))

    kinds = F.array(
        one("page", "markdown", F.lit(True)),
        one("clutter", "clutter_markdown", F.lit(clutter) & (F.coalesce("clutter_markdown", F.lit("")) != "")),
        one("llms", "llms_markdown", F.lit(overwrite_llms)),
        one("llms_full", "llms_full_markdown", F.lit(overwrite_llms)),
    )
    rows = pages.select("url", F.explode(F.array_compact(kinds)).alias("f")).select("url", "f.*")
    return rows.groupBy("path").agg(F.min_by(F.struct("kind", "content"), "url").alias("f")).select("f.kind", "path", "f.content")


def write_files(files: DataFrame) -> DataFrame:
    """Writes each file where its path says, from the executors; gives path and bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                data = (content or "").encode()
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(write, "path string, bytes long")
