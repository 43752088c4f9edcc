"""Progressive ingestion and event-time windows with Structured Streaming.

The fast path cuts arriving page ranges to chunks and upserts them batch by batch; the slow path reads
the chunk table as a stream and adds graph facts. A batch written twice replaces itself, so both are
idempotent; a failing batch fails its query, and ``maxFilesPerTrigger`` bounds what a batch takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.parsing import sse_frame
from ..operators import chunking
from ..sources.tables import Corpus

PAGES = "source string, doc_id bigint, start int, `end` int, markdown string"
# Progress in per cent by stage.
STAGES = (("OCR", 30), ("Embedding Generation", 45), ("Entity Extraction", 62), ("Knowledge Graph Construction", 72), ("Ready", 100))


def page_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Arriving Parquet files of page ranges."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def range_chunks(pages: DataFrame, chars: int = 1800, overlap: int = 200) -> DataFrame:
    """Chunks of page ranges; sections begin anew in each range, the sequence counts through the document's ranges."""
    kept = ["doc_id", "source", "start", "range"]
    keyed = pages.withColumn("range", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    cut = chunking.with_sections(keyed, "markdown", kept).select(*kept, F.posexplode("parts").alias("section", "p")).select(*kept, "section", "p.*")
    parts = chunking.sliding_windows(cut, max(chunking.LEAST_WINDOW, chars), overlap)
    content = tx.strip(F.concat_ws("\n\n", "title", "content"))
    order = F.struct(F.col("start"), F.col("section"), F.col("window"))
    parts = parts.withColumn("whole", content).withColumn("place", order)
    return parts.select("doc_id", "source", F.lit("text").alias("content_type"), F.col("whole").alias("content"), "title", "place", F.create_map(F.lit("page_range"), F.col("range")).alias("metadata"))


def numbered(parts: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Chunks with sequence and identity, numbered on from ``last`` (doc_id, last)."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    rows = parts.withColumn("sequence", seq)
    if last is not None:
        rows = rows.join(last, "doc_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")
    ident = tx.chunk_id(F.concat(F.col("source"), F.lit(":text")), F.col("sequence"), F.col("content"))
    return rows.withColumn("chunk_id", ident).withColumn("sequence", F.col("sequence").cast("int")).drop("place")


def ingest(pages: DataFrame, corpus: Corpus, checkpoint: str, embed: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Start the fast path; it ends when what is there is read."""

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        last = None
        if corpus.has("chunks"):
            have = corpus.spark.read.option("basePath", f"{corpus.path}/chunks").parquet(f"{corpus.path}/chunks").filter(F.col("batch") != number)
            last = have.groupBy("doc_id").agg(F.max("sequence").alias("last"))
        chunks = numbered(range_chunks(rows), last)
        corpus.upsert("chunks", chunks, number)
        if embed is not None:
            fresh = corpus.spark.read.parquet(f"{corpus.path}/chunks/batch={number}")
            corpus.upsert("vectors", fresh.select(F.col("chunk_id").alias("id"), embed(F.col("content")).alias("embedding"), "source"), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract(corpus: Corpus, facts: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start the slow path: facts of chunks as they appear in the chunk table."""
    schema = corpus.spark.read.parquet(f"{corpus.path}/chunks").schema
    stream = corpus.spark.readStream.schema(schema).parquet(f"{corpus.path}/chunks")

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            corpus.upsert("facts", facts(rows), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(corpus: Corpus) -> DataFrame:
    """batch, indexed, entities, edges after each batch of facts: chunks with facts so far, and the distinct entities and edges in them."""
    facts = corpus.spark.read.option("basePath", f"{corpus.path}/facts").parquet(f"{corpus.path}/facts")
    none = F.lit(None).cast("string")
    key = lambda c: F.when(tx.entity_key(c) != "", tx.entity_id(c))
    said = facts.select("batch", "chunk_id", F.explode("entities").alias("e")).select("batch", "chunk_id", key(F.col("e.name")).alias("dst"))
    told = facts.select("batch", "chunk_id", F.explode("relations").alias("r")).select("batch", "chunk_id", key(F.col("r.source")).alias("a"), key(F.col("r.target")).alias("b")).filter("a is not null and b is not null")
    whole = facts.select("batch", F.lit("indexed").alias("kind"), F.col("chunk_id").alias("x"), none.alias("y"))
    ends = told.select("batch", "chunk_id", F.explode(F.array("a", "b")).alias("dst"))
    named = said.unionByName(ends).filter("dst is not null")
    whole = whole.union(named.select("batch", F.lit("entities"), "dst", none)).union(named.select("batch", F.lit("edges"), "chunk_id", "dst")).union(told.select("batch", F.lit("edges"), "a", "b"))
    # What is new in a batch is what no earlier one has.
    new = whole.groupBy("kind", "x", "y").agg(F.min("batch").alias("batch")).groupBy("batch").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("indexed", "entities", "edges")])
    sofar = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch
    every = facts.select("batch").distinct().join(new, "batch", "left").na.fill(0)
    return every.select("batch", *[F.sum(k).over(sofar).alias(k) for k in ("indexed", "entities", "edges")])


def progress(events: DataFrame) -> DataFrame:
    """seq, stage, percent, so far (never falling) of events (seq, stage); other stages are at 55."""
    percent = F.lit(55)
    for name, p in STAGES:
        percent = F.when(F.col("stage") == name, p).otherwise(percent)
    rows = events.withColumn("percent", percent)
    return rows.withColumn("so_far", F.max("percent").over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def event_frames(events: DataFrame) -> DataFrame:
    """Server-sent frames of events (kind and any other columns)."""
    rest = [c for c in events.columns if c != "kind"]
    return events.select(sse_frame(F.col("kind"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("frame"))


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``events`` with a time stamp that watermarks accept."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total by window; works on tables and streams alike."""
    rows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, slide or size).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, stop, n of each session."""
    rows = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
