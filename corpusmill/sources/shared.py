"""Tables in the folder that all executors share (``spark.checkpoint.dir``), as lineage cuts.

Where that setting is absent, a temporary folder of the driver stands in if the master is local.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAND_IN: list[str] = []


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _STAND_IN:
        _STAND_IN.append("file://" + tempfile.mkdtemp(prefix="corpusmill-"))
    return _STAND_IN[0]


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/corpusmill/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written out and read back."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_passes(queries: DataFrame, most: int, key: str = "query_id") -> list[DataFrame]:
    """``queries`` as they are if at most ``most`` rows, else written out and dealt by ``key`` to parts of about that many."""
    n = queries.count()
    if n <= most:
        return [queries]
    held, parts = written(queries, "queries"), -(-n // most)
    return [held.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
