"""Ranking, fusion, context and evaluation as registered queries.

Documents stand for chunks; vectors and documents meet by vec_id = doc_id, a convention of these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import named_facts
from ..functions.text import tokens
from ..operators import cache, context, evaluate, fusion, graph, lexical, vector
from ..sources.shared import written
from .retrieval import Answering, HybridRetrieval, Index
from .shared import BM25_CTES, document_chunks, sql_truncate, table

K = 20
#: A document is relevant to a benchmark text if it holds so many of its words in a row.
RELEVANT_WORDS = 8


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries, each with the vector of its number."""
    b = table(spark, sf_dir, "benchmark")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return b.join(v, "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "vector")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.Bm25Index(document_chunks(spark, sf_dir)).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


BM25_STATS = f"WITH {BM25_CTES} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM idf JOIN df USING (term), size"


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = document_chunks(spark, sf_dir)
    scores = lexical.Bm25Index(chunks).scores(_asked(spark, sf_dir))
    return lexical.lexical_ranking(scores, K, digits=6)


_BM_RANK = """
br AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM bm) WHERE score > 0)"""
BM25_TOPK = f"WITH {BM25_CTES}, {_BM_RANK} SELECT query_id, 'd' || doc_id AS chunk_id, rank::INT AS rank, score FROM br WHERE rank <= 20"


def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = document_chunks(spark, sf_dir)
    scores = lexical.Bm25Index(chunks).scores(_asked(spark, sf_dir))
    return lexical.lexical_ranking(lexical.in_source(scores, chunks, "src3"), 5, digits=6)


BM25_SCOPED = f"""
WITH {BM25_CTES},
r AS (
  SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(score, 6) AS s FROM bm JOIN documents USING (doc_id) WHERE source = 'src3') WHERE s > 0)
SELECT query_id, 'd' || doc_id AS chunk_id, rank::INT AS rank, score FROM r WHERE rank <= 5"""


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.nearest_to(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 15, digits=9)


_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9)"
_COS_TOPK = """
WITH s AS (SELECT e.vec_id, {cos} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {where})
SELECT row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 15"""
COSINE_TOPK = _COS_TOPK.format(cos=_COS, where="")


def cosine_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.nearest_to(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 15, where=F.col("label") == 3, digits=9)


COSINE_SCOPED = _COS_TOPK.format(cos=_COS, where="WHERE e.label = 3")


def cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector.nearest_to_all(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), K)
    return rows.select(F.col("query_id").cast("long").alias("query_id"), "rank", "vec_id", F.round("score", 9).alias("score"))


_SEM = f"""
q AS (SELECT vec_id AS query_id, embedding FROM embeddings JOIN benchmark ON item_id = vec_id),
sem AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.query_id, e.vec_id, {_COS} AS score FROM embeddings e, q))"""
COSINE_BATCH = f"WITH {_SEM} SELECT query_id, rank::INT AS rank, vec_id, score FROM sem WHERE rank <= 20"


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = cosine_batch(spark, sf_dir).select("query_id", F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("chunk_id"), "rank")
    return near, bm25_topk(spark, sf_dir)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _rankings(spark, sf_dir)
    return fusion.fuse(near, words, document_chunks(spark, sf_dir)).withColumn("fusion_score", F.round("fusion_score", 9))


_FUSE = """
a AS (SELECT query_id, vec_id AS doc_id, rank AS sr FROM sem WHERE rank <= 20),
b AS (SELECT query_id, doc_id, rank AS lr FROM br WHERE rank <= 20),
ab AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, sr, lr FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
known AS (SELECT * FROM ab WHERE doc_id IN (SELECT doc_id FROM documents)),
sc AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS f FROM known),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, coalesce(sr, 1e9), coalesce(lr, 1e9), 'd' || doc_id) AS fr FROM sc)"""
_FUSED = f"{BM25_CTES}, {_BM_RANK}, {_SEM}, {_FUSE}"
RRF_FUSION = f"WITH {_FUSED} SELECT query_id, 'd' || doc_id AS chunk_id, round(f, 9) AS fusion_score, fr::INT AS fused_rank, sr::INT AS semantic_rank, lr::INT AS lexical_rank FROM fused"


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf_fusion(spark, sf_dir).filter("fused_rank <= 6")


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among documents: each to the ten it belongs to, and to its neighbour among these."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    up = d.filter("doc_id % 10 != 0").select(name(F.col("doc_id")).alias("src"), name(F.col("doc_id") - F.col("doc_id") % 10).alias("dst"), F.lit("parent").alias("relation"), F.col("doc_id").alias("ord"))
    beside = d.filter("doc_id % 10 != 9").select(name(F.col("doc_id")).alias("src"), name(F.col("doc_id") + 1).alias("dst"), F.lit("next_sibling").alias("relation"), F.col("doc_id").alias("ord"))
    return up.unionByName(beside)


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = written(_final(spark, sf_dir), "fused")
    return context.joined_context(context.context_blocks(best, document_chunks(spark, sf_dir), _family(spark, sf_dir)))


CONTEXT_BLOCKS = f"""
WITH {_FUSED},
e AS (SELECT doc_id AS a, doc_id - doc_id % 10 AS b, 0 AS g FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, doc_id + 1, 2 FROM documents WHERE doc_id % 10 <> 9),
two AS (SELECT a, b, g FROM e UNION SELECT b, a, g FROM e),
top AS (SELECT query_id, doc_id FROM fused WHERE fr = 1),
cand AS (
  SELECT query_id, b AS doc_id, g, b AS place FROM top JOIN two ON a = doc_id
  UNION ALL SELECT query_id, doc_id, 1, 0 FROM top UNION ALL SELECT query_id, doc_id, 3, fr FROM fused WHERE fr <= 6),
least AS (SELECT query_id, doc_id, min(g * 1000000000000 + place) AS spot FROM cand JOIN documents USING (doc_id) GROUP BY ALL),
blocks AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, 'd' || doc_id) AS i FROM least)
SELECT query_id, string_agg('[' || i || '] chunk_id=d' || doc_id || ' source=' || source || ' type=text | Title ' || doc_id || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context
FROM blocks JOIN documents USING (doc_id) GROUP BY query_id"""


def sources_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _final(spark, sf_dir).select("query_id", "chunk_id", F.col("fused_rank").alias("rank"), F.col("fusion_score").alias("score"))
    rows = context.sources_list(ranked, document_chunks(spark, sf_dir))
    return rows.select("query_id", "marker", "source", "chunk_id", "title", "content_type", "sequence", "page", "rerank_score", "snippet")


SOURCES_LIST = f"""
WITH {_FUSED}
SELECT query_id, 'S' || fr AS marker, source, 'd' || doc_id AS chunk_id, 'Title ' || doc_id AS title, 'text' AS content_type, doc_id::INT AS sequence, '' AS page,
       round(f, 9) AS rerank_score, {sql_truncate("text", 320)} AS snippet
FROM fused JOIN documents USING (doc_id) WHERE fr <= 6"""


def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _final(spark, sf_dir).select("query_id", "chunk_id", F.col("fused_rank").alias("rank"), F.col("fusion_score").alias("score"))
    rows = context.evidence_text(ranked, document_chunks(spark, sf_dir))
    return rows.select("query_id", F.array_join("documents", ",").alias("documents"), F.sha2("evidence", 256).alias("evidence_sha256"))


EVIDENCE_DOCUMENTS = f"""
WITH {_FUSED},
e AS (SELECT query_id, fr, source, '[S' || fr || ' | document=' || source || ' | section=Title ' || doc_id || ' | score=' || printf('%.4f', round(f, 9)) || ']' || chr(10) || {sql_truncate("text", 3500)} AS block
      FROM fused JOIN documents USING (doc_id) WHERE fr <= 6)
SELECT query_id, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM e e2 WHERE e2.query_id = e.query_id)) AS documents,
       sha256(string_agg(block, chr(10) || chr(10) ORDER BY fr)) AS evidence_sha256
FROM e GROUP BY query_id"""


def _windows(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and every run of RELEVANT_WORDS words of ``text``."""
    words = rows.select(key, tokens(F.coalesce("text", F.lit(""))).alias("ts")).filter(F.size("ts") >= RELEVANT_WORDS)
    at = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ts") - RELEVANT_WORDS + 1)))
    return at.select(key, F.array_join(F.slice("ts", F.col("at"), F.lit(RELEVANT_WORDS)), " ").alias("run"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark text's relevant documents: those that hold RELEVANT_WORDS of its words in a row."""
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "case_id")
    runs = written(_windows(b, "case_id").distinct(), "eval-runs")
    runs = F.broadcast(runs) if runs.count() <= lexical.BROADCAST_ROWS else runs
    held = _windows(table(spark, sf_dir, "documents"), "doc_id").join(runs, "run")
    ids = held.groupBy("case_id").agg(F.collect_set(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("relevant_ids"))
    return b.select("case_id").join(ids, "case_id", "left")


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    return evaluate.score_cases(_relevant(spark, sf_dir), found, 6).select("case_id", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")], "hit")


_EVAL = f"""
{BM25_CTES}, {_BM_RANK},
dw AS (SELECT DISTINCT doc_id, array_to_string(ts[i:i + 7], ' ') AS run FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM tok)),
bw AS (SELECT DISTINCT case_id, array_to_string(ts[i:i + 7], ' ') AS run FROM (
  SELECT case_id, ts, unnest(range(1, len(ts) - 6)) AS i FROM (SELECT item_id AS case_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM benchmark))),
rel AS (SELECT DISTINCT case_id, doc_id FROM dw JOIN bw USING (run)),
n AS (SELECT item_id AS case_id, (SELECT count(*) FROM rel WHERE case_id = item_id) AS n FROM benchmark),
top AS (SELECT query_id AS case_id, doc_id, rank FROM br WHERE rank <= 6),
h AS (SELECT n.case_id, any_value(n.n) AS n, count(r.doc_id) AS hits, min(CASE WHEN r.doc_id IS NOT NULL THEN top.rank END) AS first
      FROM n LEFT JOIN top USING (case_id) LEFT JOIN rel r ON r.case_id = n.case_id AND r.doc_id = top.doc_id GROUP BY n.case_id),
cases AS (SELECT case_id, round(hits / 6.0::DOUBLE, 9) AS precision_at_k, round(CASE WHEN n > 0 THEN hits / n::DOUBLE ELSE 0 END, 9) AS recall_at_k, round(coalesce(1 / first::DOUBLE, 0), 9) AS reciprocal_rank, hits > 0 AS hit FROM h)"""
EVAL_CASES = f"WITH {_EVAL} SELECT * FROM cases"


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summarize(eval_cases(spark, sf_dir))
    return s.select("cases", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mean_reciprocal_rank", "hit_rate")])


EVAL_METRICS = f"""
WITH {_EVAL}
SELECT count(*) AS cases, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k,
       round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg(hit::INT), 6) AS hit_rate
FROM cases"""


def subquestion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25_topk(spark, sf_dir).filter("rank <= 5").select((F.col("query_id") % 4).alias("query_id"), F.col("query_id").cast("int").alias("sub"), "chunk_id", "rank", "score")
    return fusion.union_best(rows)


SUBQUESTION_UNION = f"""
WITH {BM25_CTES}, {_BM_RANK},
u AS (SELECT query_id % 4 AS query_id, 'd' || doc_id AS chunk_id, max(score) AS score, min((query_id * 100 + rank)) AS seen FROM br WHERE rank <= 5 GROUP BY 1, 2)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank, score FROM u"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("").alias("scope"), F.col("text").alias("query"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("result"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.entries(_log(spark, sf_dir)).select("cache_key", "query", "result", "last_used")


CACHE_ENTRIES = """
WITH l AS (SELECT conv_id * 1000 + turn AS seq, text AS query, 'r' || conv_id AS result, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS cache_key FROM conversations WHERE role = 'user')
SELECT cache_key, arg_max(query, seq) AS query, arg_max(result, seq) AS result, max(seq) AS last_used FROM l GROUP BY cache_key ORDER BY last_used DESC LIMIT 128"""


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return cache.lookup(cache.entries(log), log.select(F.col("seq").alias("query_id"), "scope", F.concat(F.col("query"), F.lit(" please")).alias("query")))


def _vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    ids = F.concat(F.lit("d"), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select(ids.alias("id"), "embedding").join(chunks.select(F.col("chunk_id").alias("id"), "source"), "id")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """Documents as chunks, the graph of the names in them, and the edges among documents."""
    chunks = document_chunks(spark, sf_dir)
    facts = chunks.select("chunk_id", "source", F.col("ordinal").alias("ord"), named_facts(F.col("content")).alias("f")).select("chunk_id", "source", "ord", "f.*")
    nodes, edges = graph.build_graph(chunks, written(facts, "facts"))
    edges = edges.select("src", "dst", "relation", F.col("ord").cast("decimal(38,0)").alias("ord")).unionByName(_family(spark, sf_dir).withColumn("ord", F.col("ord").cast("decimal(38,0)")))
    nodes = nodes.select("node_id", "label", "node_type", "canonical", "ord")  # what answers need
    return Index(chunks, _vectors(spark, sf_dir, chunks), written(nodes, "nodes"), edges)


def _hybrid(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    chunks = document_chunks(spark, sf_dir)
    index = Index(chunks, _vectors(spark, sf_dir, chunks), None, None)
    found = HybridRetrieval(index, digits=6).fused(asked).filter("fused_rank <= 6")
    return found.withColumn("query_id", F.col("query_id").cast("long")).withColumn("fusion_score", F.round("fusion_score", 9))


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, _asked(spark, sf_dir))


def retrieve_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query in a source of its own."""
    return _hybrid(spark, sf_dir, _asked(spark, sf_dir).withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 8).cast("string"))))


def _hybrid_sql(scope: str) -> str:
    return f"""
WITH {BM25_CTES},
br AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE {scope}) WHERE score > 0),
q AS (SELECT vec_id AS query_id, embedding FROM embeddings JOIN benchmark ON item_id = vec_id),
sem AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.query_id, e.vec_id, {_COS} AS score FROM embeddings e JOIN documents ON doc_id = vec_id, q WHERE {scope})),
{_FUSE}
SELECT query_id, 'd' || doc_id AS chunk_id, round(f, 9) AS fusion_score, fr::INT AS fused_rank, sr::INT AS semantic_rank, lr::INT AS lexical_rank FROM fused WHERE fr <= 6"""


HYBRID_RETRIEVAL, RETRIEVE_SCOPED = _hybrid_sql("true"), _hybrid_sql("source = 'src' || (query_id % 8)")


def _every_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries to be embedded."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def robust_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Answering(_index(spark, sf_dir)).robust(_every_text(spark, sf_dir))


def _parts(text: Column) -> Column:
    """A whole text in parts of at most 60 characters, cut at white space or, within longer words, after 60."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\S.{0,59}(?=\s|$)|\S{1,60}"), F.lit(0))


def stepwise_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _every_text(spark, sf_dir)
    return Answering(_index(spark, sf_dir)).stepwise(q.select("query_id", F.array_join(_parts(F.col("query")), "? and also ").alias("query")))


QUERIES = {
    "bm25_stats": (bm25_stats, BM25_STATS), "bm25_topk": (bm25_topk, BM25_TOPK), "bm25_scoped": (bm25_scoped, BM25_SCOPED), "cosine_topk": (cosine_topk, COSINE_TOPK), "cosine_scoped": (cosine_scoped, COSINE_SCOPED),
    "cosine_batch": (cosine_batch, COSINE_BATCH), "rrf_fusion": (rrf_fusion, RRF_FUSION), "context_blocks": (context_blocks, CONTEXT_BLOCKS), "sources_list": (sources_list, SOURCES_LIST),
    "evidence_documents": (evidence_documents, EVIDENCE_DOCUMENTS), "eval_cases": (eval_cases, EVAL_CASES), "eval_metrics": (eval_metrics, EVAL_METRICS), "subquestion_union": (subquestion_union, SUBQUESTION_UNION),
    "cache_entries": (cache_entries, CACHE_ENTRIES), "cache_lookup": (cache_lookup, None), "hybrid_retrieval": (hybrid_retrieval, HYBRID_RETRIEVAL), "retrieve_scoped": (retrieve_scoped, RETRIEVE_SCOPED), "robust_answers": (robust_answers, None), "stepwise_evidence": (stepwise_evidence, None),
}
