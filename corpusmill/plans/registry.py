"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, search_queries, stream_queries, text_queries

_ALL = text_queries.QUERIES | search_queries.QUERIES | graph_queries.QUERIES | stream_queries.QUERIES
_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql} | {"streaming_ingest": f"SELECT DISTINCT chunk_id, source, content_type, content, title, sequence FROM ({text_queries.MARKDOWN_CHUNKS})"}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: cosine and BM25 rankings fused by reciprocal ranks."""
    return search_queries.rrf_fusion(spark, sf_dir).filter("fused_rank <= 6")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
