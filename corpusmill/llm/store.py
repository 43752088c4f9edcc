"""Shared-folder tables: lineage cuts and intermediate files that outlive executors.

Everything is written below the folder the cluster names in ``spark.checkpoint.dir``; where that is
unset, a temporary folder of the driver stands in if the master is local, and anything else is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="corpusmill-"))
    return _FALLBACK[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/corpusmill/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder behind a table made by ``keep``, or a plain selection from it, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    relation = df._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    roots = relation.location().rootPaths()
    for folder in (roots.apply(i).toString() for i in range(roots.size())):
        if "/corpusmill/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def row_key(key: Column | str, text: Column | str) -> Column:
    """128 bits that stand for a row's id and text; rows that agree in both have one key."""
    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(key.cast("string"), F.lit("\x02")), F.coalesce(text, F.lit("")))))


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, or with marks after it, so that no column has the name."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has this path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` are within ``limit``; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def release() -> None:
    """Give memory that a worker has freed back to the system, at the end of a task."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)
