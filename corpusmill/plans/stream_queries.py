"""Windows, sessions, upserts and streaming ingestion as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import embed_column
from ..sources.shared import fresh
from ..sources.tables import Corpus, newest, sources_of, status
from ..streaming import ingest
from . import graph_queries
from .shared import document_chunks, table


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.tumbling(table(spark, sf_dir, "events"), "1 day")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


TUMBLING_WINDOWS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.sessions(table(spark, sf_dir, "events"), "6 hours")
    f = "yyyy-MM-dd HH:mm:ss"
    return rows.select("user_id", F.date_format("start", f).alias("start"), F.date_format("stop", f).alias("stop"), "n")


SESSIONS = """
WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM g GROUP BY user_id, s"""


def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("batch"), "event_type", "value")
    return newest(rows, "user_id")


LAST_WRITES = "SELECT user_id, max(event_id) AS batch, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_of(document_chunks(spark, sf_dir))


SOURCE_LIST = "SELECT source, min(doc_id) AS first, count(*) AS chunks FROM documents GROUP BY source"


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph_queries._graph(spark, sf_dir)
    return status(graph_queries.chunks(spark, sf_dir), n, e)


INDEX_STATUS = f"""
WITH {graph_queries._FACTS}
SELECT (SELECT count(DISTINCT source) FROM f) AS sources, (SELECT count(*) FROM f) AS chunks, (SELECT count(*) FROM nodes) AS nodes,
       (SELECT count(*) FROM nodes WHERE node_type = 'entity') AS entities, (SELECT count(*) FROM edges) AS edges"""


def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Uploading", "OCR", "Embedding Generation", "status", "Knowledge Graph Construction", "Entity Extraction", "Ready")])
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("source"), names[(F.col("event_id") % 7).cast("int")].alias("stage"))
    return ingest.progress(e).select("seq", "source", "percent", "so_far")


INGEST_PROGRESS = """
WITH p AS (SELECT event_id AS seq, user_id::VARCHAR AS source, [55, 30, 45, 55, 72, 62, 100][event_id % 7 + 1] AS percent FROM events)
SELECT seq, source, percent, max(percent) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far FROM p"""


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in files and become chunks with vectors, batch by batch."""
    base = fresh(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(1).alias("start"), F.lit(5).alias("end"), F.col("text").alias("markdown"))
    docs.repartition(4, "doc_id").write.parquet(f"{base}/pages")
    corpus = Corpus(spark, f"{base}/corpus")
    ingest.ingest(ingest.page_stream(spark, f"{base}/pages", 2), corpus, f"{base}/fast", embed_column).awaitTermination()
    return corpus.read("chunks", "chunk_id").select("chunk_id", "source", "content_type", "content", "title", "sequence")


QUERIES = {
    "tumbling_windows": (tumbling_windows, TUMBLING_WINDOWS), "sessions": (sessions, SESSIONS), "last_writes": (last_writes, LAST_WRITES), "source_list": (source_list, SOURCE_LIST),
    "index_status": (index_status, INDEX_STATUS), "ingest_progress": (ingest_progress, INGEST_PROGRESS), "streaming_ingest": (streaming_ingest, None),
}
