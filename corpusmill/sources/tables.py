"""A corpus as a folder of tables, with upserts that need no table format.

Upserts append a batch and readers take each key's row of the newest batch, so a writer that dies leaves
nothing half replaced; ``compact`` rewrites a table to its current rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "chunks", "vectors", "nodes", "edges", "facts", "cache")


def newest(rows: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """Each key's row of its newest batch; of repeats within a batch one. A max over structs combines before its shuffle."""
    rest = [c for c in rows.columns if c != key]
    order = [batch] + [c for c in rest if c != batch and not rows.schema[c].dataType.typeName() == "map"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def checked_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, embedding, source of the chunks; raises if the counts differ."""
    n, m = chunks.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} chunks but {m} embeddings")
    return chunks.select(F.col("chunk_id").alias("id"), "source").join(vectors.select("id", "embedding"), "id")


class Corpus:
    """The tables of one corpus below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.path}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        jvm, fs = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(self._folder(name)))

    def upsert(self, name: str, rows: DataFrame, batch: int) -> None:
        """Add a batch; writing the same batch again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self._folder(name)}/batch={batch}")

    def read(self, name: str, key: str) -> DataFrame:
        rows = self.spark.read.option("basePath", self._folder(name)).option("mergeSchema", "true").parquet(self._folder(name))
        return newest(rows, key).drop("batch")

    def compact(self, name: str, key: str, batch: int) -> None:
        """Rewrite a table to its current rows as one batch, then drop the older ones."""
        self.upsert(name, self.read(name, key), batch)
        jvm, fs = self._fs()
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self._folder(name))):
            if s.getPath().getName() != f"batch={batch}":
                fs.delete(s.getPath(), True)

    def reset(self, *names: str) -> None:
        """Drop these tables, all if none is named; what is not there is no error."""
        jvm, fs = self._fs()
        for n in names or TABLES:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(n)), True)

    def sources(self) -> list[str]:
        """Sources in order of first appearance; the corpus's documents are its dimension."""
        return source_names(self.read("chunks", "chunk_id"))


def source_names(chunks: DataFrame) -> list[str]:
    return [r["source"] for r in sources_of(chunks).orderBy("first").collect()]


def sources_of(chunks: DataFrame) -> DataFrame:
    """source, first (smallest ordinal), chunks."""
    return chunks.groupBy("source").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("chunks"))


def status(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    a = chunks.agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("chunks"))
    b = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "entity").alias("entities"))
    return a.crossJoin(b).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
