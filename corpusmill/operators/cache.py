"""A query cache as a table: cache_key, scope, query, result, last_used.

The key holds the scope of a query (source and mode) beside its words. A lookup takes the exact key, else the most alike
key (the oldest of equals) at or above a threshold; either is then the newest. The newest ``LIMIT``
entries are kept.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.text import cache_key

LIMIT, THRESHOLD = 128, 0.82


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def entries(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The cache after a log (seq, scope, query, result) was put in in order."""
    keyed = log.withColumn("cache_key", cache_key(F.col("query")))
    last = keyed.groupBy("scope", "cache_key").agg(F.max(F.struct("seq", "query", "result")).alias("e"))
    flat = last.select("scope", "cache_key", F.col("e.query").alias("query"), F.col("e.result").alias("result"), F.col("e.seq").alias("last_used"))
    return flat.orderBy(F.desc("last_used")).limit(limit)


def lookup(cache: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """query_id, cache_key, score, result of each query (query_id, scope, query) that hits one of the ``limit`` newest entries."""
    asked = queries.select("query_id", "scope", cache_key(F.col("query")).alias("asked"))
    kept = cache.orderBy(F.desc("last_used")).limit(limit)
    both = asked.join(F.broadcast(kept), "scope")
    # The ratio is at most twice the shorter length over both lengths; this rules out most pairs before Python sees them.
    a, b = F.length("asked"), F.length("cache_key")
    both = both.filter((F.col("asked") == F.col("cache_key")) | (2 * F.least(a, b) >= threshold * (a + b)))
    score = F.when(F.col("asked") == F.col("cache_key"), F.lit(2.0)).otherwise(likeness("asked", "cache_key"))
    scored = both.withColumn("score", score).filter(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "last_used")
    best = scored.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return best.select("query_id", "scope", "cache_key", F.least("score", F.lit(1.0)).alias("score"), "result")


def touched(cache: DataFrame, hits: DataFrame, since: int) -> DataFrame:
    """The entries hit, their last_used counting on from ``since`` in order of query_id."""
    used = hits.groupBy("scope", "cache_key").agg(F.max("query_id").alias("query_id"))  # at most LIMIT rows
    order = F.row_number().over(Window.orderBy("query_id", "scope", "cache_key"))
    used = used.select("scope", "cache_key", (order + since).cast("long").alias("last_used"))
    return cache.drop("last_used").join(used, ["scope", "cache_key"]).select("scope", "cache_key", "query", "result", "last_used")
