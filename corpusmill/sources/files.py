"""Reading documents, images, reports and evaluation cases; page ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.models import Writer, EchoWriter, write_column

NO_CHARTS = "No chart images found."
FAILED_VISION = "Vision analysis failed"
#: An image counts as a chart if it is wider than this, and has no more colours than this.
ASPECT, COLOURS = 1.1, 15_000


def page_ranges(docs: DataFrame, pages: str = "pages", size: int = 10) -> DataFrame:
    """Rows with start and end page for each range of ``size`` pages; a size under 1 steps by 1 and gives empty ranges."""
    start = F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(max(1, size))))
    return docs.filter(F.col(pages) >= 1).withColumn("start", start).withColumn("end", F.least(F.col("start") + size - 1, F.col(pages)))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source (file name) and markdown of each file; a missing path raises."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("source"), F.col("value").alias("markdown"))


def with_reports(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """Documents beside their report, empty where there is none."""
    return docs.join(reports.select("source", "report"), "source", "left").withColumn("report", F.coalesce("report", F.lit("")))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, source and content of binary files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("source"), "content")


def parse_pages(files: DataFrame, parse: Callable[[bytes, int, int], str]) -> DataFrame:
    """source, start, end, markdown from binary files with page ranges, by a parser plug-in (content, first, last page)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [parse(bytes(c), int(a), int(b)) for c, a, b in zip(pdf["content"], pdf["start"], pdf["end"], strict=True)]
            yield pdf[["source", "start", "end"]].assign(markdown=text)

    return files.select("source", "start", "end", "content").mapInPandas(run, "source string, start int, end int, markdown string")


def chart_images(images: DataFrame) -> DataFrame:
    """Images (width, height, n_colors) that look like charts; unknown colours (null) do not."""
    return images.filter((F.col("width") / F.greatest(F.lit(1), F.col("height")) > ASPECT) & (F.col("n_colors") <= COLOURS))


def image_base64(content: Column) -> Column:
    return F.base64(content)


def resolve_image(images: DataFrame, known: DataFrame, path: str = "image_file") -> DataFrame:
    """``images`` with resolved: the path itself if it is known, else a known path of the same file name."""
    names = known.select(F.col("path").alias("found"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    exact = known.select(F.col("path").alias("same")).distinct()
    by_name = names.groupBy("base").agg(F.min("found").alias("found"))
    rows = images.join(exact, F.col(path) == F.col("same"), "left").withColumn("base", F.regexp_extract(path, r"([^/]*)$", 1)).join(by_name, "base", "left")
    return rows.withColumn("resolved", F.coalesce("same", "found")).drop("same", "found", "base")


def describe_images(images: DataFrame, make: Callable[[], Writer] = EchoWriter) -> DataFrame:
    """file and summary of each image; a failed call becomes its summary, never an error."""
    return images.select("file", write_column(F.concat(F.lit("Describe "), F.col("file")), make, failed=FAILED_VISION).alias("summary"))


def vision_report(described: DataFrame) -> DataFrame:
    """One row: the report of all described images, in order of file name."""
    entry = F.concat(F.lit("## File: `"), F.col("file"), F.lit("`\n"), F.col("summary"), F.lit("\n\n---\n\n"))
    body = described.select("file", entry.alias("e")).agg(F.array_sort(F.collect_list(F.struct("file", "e"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["e"]), "")
    return body.select(F.when(F.size("all") == 0, F.lit(NO_CHARTS)).otherwise(F.concat(F.lit("# Vision Extraction Report\n\n"), text)).alias("report"))


def uploads(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files (source, content) with status: wrong_type, empty, known, or new. Known sources are found by a join."""
    have = documents.select("source").distinct().withColumn("have", F.lit(True))
    pdf = F.lower("source").endswith(".pdf")
    status = F.when(~pdf, "wrong_type").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").when(F.col("have"), "known").otherwise("new")
    return files.join(have, "source", "left").withColumn("status", status).drop("have")


class BadCase(ValueError):
    """An evaluation case without a query."""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id (line number), query, relevant_ids, relevant_text, source, metadata of a JSONL file; blank lines are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("i", "line"))
    return parse_cases(text.select((F.col("i") + 1).alias("case_id"), "line"))


def parse_cases(rows: DataFrame) -> DataFrame:
    """The same from rows (case_id, line). A line with a blank or missing query raises with its number when it is read."""
    shape = "query string, relevant_ids array<string>, relevant_id string, relevant_text string, source string, metadata map<string,string>"
    rows = rows.withColumn("line", tx.strip(F.col("line"))).filter(F.col("line") != "").withColumn("p", F.from_json("line", shape))
    query = tx.strip(F.coalesce("p.query", F.lit("")))
    checked = F.when(query == "", F.raise_error(F.concat(F.lit("Missing query on line "), F.col("case_id").cast("string"), F.lit(".")))).otherwise(query)
    first = F.when(F.col("p.relevant_id").isNotNull(), F.array("p.relevant_id")).otherwise(F.array().cast("array<string>"))
    ids = F.array_distinct(F.concat(first, F.coalesce("p.relevant_ids", F.array().cast("array<string>"))))
    meta = F.coalesce("p.metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return rows.select("case_id", checked.alias("query"), ids.alias("relevant_ids"), F.coalesce("p.relevant_text", F.lit("")).alias("relevant_text"), F.col("p.source").alias("source"), meta.alias("metadata"))


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON text of an evaluation summary row, keys sorted."""
    return summary.select(F.to_json(F.struct(*sorted(summary.columns)), {"pretty": "true"}).alias("value"))
