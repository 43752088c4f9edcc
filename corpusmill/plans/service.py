"""A corpus as a service: ingest, retrieve, chat, status and resets over the tables of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import models, parsing
from ..operators import cache, chunking, graph, pii
from ..sources.shared import written
from ..sources.tables import Corpus, sources_of, status
from .retrieval import Answering, HybridRetrieval, Index, default_scope

MODULES = ("chunking", "retrieval", "graph", "pii", "evaluation", "cache")


class NotIndexed(LookupError):
    """Nothing was ingested yet."""


def error_json(detail: Column) -> Column:
    """How an error is told to a client."""
    return F.to_json(F.struct(detail.alias("detail")))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """chunk_id and the chunk as JSON."""
    names = ("chunk_id", "source", "content_type", "title", "sequence", "content", "metadata")
    return chunks.select("chunk_id", F.to_json(F.struct(*names)).alias("json"))


class CorpusService:
    def __init__(self, spark: SparkSession, path: str, embed=models.HashEmbedder, rerank=models.OverlapReranker, write=models.EchoWriter, facts=models.named_facts):
        self.spark, self.corpus = spark, Corpus(spark, path)
        self.embed, self.rerank, self.write, self.facts = embed, rerank, write, facts

    def health(self) -> dict:
        return {"status": "ok", "has_index": self.corpus.has("chunks"), "modules": dict.fromkeys(MODULES, True)}

    def _chunks(self) -> DataFrame:
        if not self.corpus.has("chunks"):
            raise NotIndexed("ingest documents first")
        return self.corpus.read("chunks", "chunk_id")

    def sources(self) -> DataFrame:
        """source, chunks in order of first appearance; no rows without an index."""
        if not self.corpus.has("chunks"):
            return self.spark.createDataFrame([], "source string, chunks long")
        return sources_of(self._chunks()).orderBy("first").select("source", "chunks")

    def index_status(self) -> DataFrame:
        i = self.index()
        return status(i.chunks, i.nodes, i.edges)

    def index(self) -> Index:
        """The corpus to ask; the graph follows from the stored facts."""
        chunks = self._chunks()
        facts = self.corpus.read("facts", "chunk_id")
        nodes, edges = graph.build_graph(chunks, facts)
        return Index(chunks, self.corpus.read("vectors", "id"), nodes, edges)

    def ingest(self, docs: DataFrame, batch: int, chars: int = 1800, overlap: int = 200) -> DataFrame:
        """Add documents (doc_id, source, markdown) whose source is new; returns the sources added. A repeated batch replaces itself."""
        if self.corpus.has("chunks"):
            rows = self.spark.read.option("basePath", f"{self.corpus.path}/chunks").parquet(f"{self.corpus.path}/chunks")
            docs = docs.join(rows.filter(F.col("batch") != batch).select("source").distinct(), "source", "left_anti")
        chunks = chunking.markdown_chunks(docs, chars, overlap).withColumn("ordinal", F.col("doc_id") * (1 << 20) + F.col("sequence"))
        self.corpus.upsert("chunks", chunks, batch)
        fresh = self.spark.read.schema(chunks.schema).parquet(f"{self.corpus.path}/chunks/batch={batch}")
        self.corpus.upsert("vectors", fresh.select(F.col("chunk_id").alias("id"), models.embed_column(F.col("content"), self.embed).alias("embedding"), "source"), batch)
        found = fresh.select("chunk_id", "source", F.col("ordinal").alias("ord"), self.facts(F.col("content")).alias("f"))
        self.corpus.upsert("facts", found.select("chunk_id", "source", "ord", "f.entities", "f.relations"), batch)
        return fresh.select("source").distinct()

    def _masked(self, queries: DataFrame, mask: bool) -> DataFrame:
        if not mask:
            return queries
        rest = [c for c in queries.columns if c != "query"]
        # Written out, as the queries are read several times.
        return written(pii.mask_rows(queries, "query").select(*rest, F.col("masked").alias("query")), "masked")

    def _hybrid(self, index: Index, semantic_k: int, lexical_k: int, final_k: int) -> HybridRetrieval:
        return HybridRetrieval(index, lambda c: models.embed_column(c, self.embed, "query"), semantic_k, lexical_k, final_k)

    def retrieve(self, queries: DataFrame, mask: bool = True, semantic_k: int = 20, lexical_k: int = 20, final_k: int = 6) -> DataFrame:
        """The ``final_k`` best chunks of queries (query_id, query, scope), with fused ranks and scores, in the source asked for, else in the corpus's first one."""
        index = self.index()
        asked = default_scope(self._masked(queries, mask), index.chunks)
        found = self._hybrid(index, semantic_k, lexical_k, final_k).fused(asked.select("query_id", "query", "scope"))
        return found.filter(F.col("fused_rank") <= final_k)

    def explain(self, queries: DataFrame, mask: bool = True, semantic_k: int = 20, lexical_k: int = 20, final_k: int = 6) -> DataFrame:
        """As ``retrieve``, a row for each query: masked query, scope, audit (token -> value), fused chunks and their context."""
        index = self.index()
        rest = queries.select("query_id", "query", "scope")
        masked = written(pii.mask_rows(rest, "query"), "masked") if mask else rest.withColumns({"masked": F.col("query"), "audit": F.create_map().cast("map<string,string>")})
        asked = default_scope(masked.select(F.col("query_id").cast("string").alias("query_id"), F.col("masked").alias("query"), "scope", "audit"), index.chunks)
        told = self._hybrid(index, semantic_k, lexical_k, final_k).explained(asked.select("query_id", "query", "scope"))
        return asked.join(told, "query_id", "left")

    def chat(self, queries: DataFrame, batch: int, mask: bool = True, source: str | None = None, threshold: float | None = None) -> DataFrame:
        """query_id, answer, status, cached: from the cache where a query is like an earlier one of the same scope, else a guarded answer.

        ``batch`` orders the entries this call adds to the cache.
        """
        scope = source or ""
        asked = self._masked(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), mask).withColumn("scope", F.lit(scope))
        hits = None
        if self.corpus.has("cache"):
            rows = written(self.corpus.read("cache", "key").select("scope", "cache_key", "query", "result", "last_used"), "cache")
            hits = written(cache.lookup(rows, asked), "cache-hits")
            left = asked.join(hits, "query_id", "left_anti")
        else:
            left = asked
        answers = Answering(self.index(), self.embed, self.rerank, self.write).robust(left, source, threshold)
        fresh = written(left.join(answers, "query_id"), "answers")
        out = fresh.select("query_id", "answer", "status", F.lit(False).alias("cached"))
        log = fresh.filter("status = 'answered'").select((F.lit(batch) * (1 << 20) + F.row_number().over(Window.partitionBy("scope").orderBy("query_id"))).cast("long").alias("seq"), "scope", "query", F.col("answer").alias("result"))
        entries = cache.entries(log)
        if hits is not None:
            out = out.unionByName(hits.select("query_id", F.col("result").alias("answer"), F.lit("answered").alias("status"), F.lit(True).alias("cached")))
            # An entry that was hit is among the newest again.
            entries = entries.unionByName(cache.touched(rows, hits, batch * (1 << 20) + (1 << 19)))
        self.corpus.upsert("cache", entries.withColumn("key", F.concat_ws("|", "scope", "cache_key")), batch)
        return out

    @staticmethod
    def frames(answers: DataFrame) -> DataFrame:
        """query_id, i, frame: each answer as server-sent events of a few characters."""
        parts = answers.select("query_id", F.posexplode(parsing.pieces(F.col("answer"))).alias("i", "text"))
        return parts.select("query_id", "i", parsing.sse_frame(F.lit("token"), F.to_json(F.struct("text"))).alias("frame"))

    def reset_chat(self) -> None:
        self.corpus.reset("cache")

    def reset_index(self) -> None:
        self.corpus.reset()
