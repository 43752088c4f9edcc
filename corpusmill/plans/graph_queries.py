"""The knowledge graph as registered queries: suppliers are chunks, nations documents, and their keys make facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .shared import sql_uuid, table


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, source, ord, entities, relations: a supplier names itself and its region, and says where it is."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entity = lambda name, kind: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"))
    relation = lambda a, b, how: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(how).alias("relation"))
    return s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("chunk_id"), F.concat(F.lit("doc "), F.col("n_name")).alias("source"), F.col("s_suppkey").alias("ord"),
        F.array(entity("s_name", "organization"), entity("r_name", "place")).alias("entities"),
        F.array(relation("s_name", "n_name", "Located-In"), relation("n_name", "r_name", "part of!")).alias("relations"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return f.select("chunk_id", "source", F.lit("text").alias("content_type"), F.concat(F.lit("About "), F.col("entities")[0]["name"]).alias("content"), F.lit("").alias("title"), F.col("ord").cast("int").alias("sequence"), none.alias("metadata"), F.col("ord").alias("ordinal"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(chunks(spark, sf_dir), facts(spark, sf_dir))


_FACTS = f"""
f AS (
  SELECT 's' || s_suppkey AS chunk_id, 'doc ' || n_name AS source, s_suppkey AS ord, s_name, n_name, r_name,
         {sql_uuid("s_name")} AS s_id, {sql_uuid("n_name")} AS n_id, {sql_uuid("r_name")} AS r_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ent AS (
  SELECT s_id AS node_id, s_name AS name, 'organization' AS entity_type, source, ord * 10 AS ord FROM f
  UNION ALL SELECT n_id, n_name, 'other', source, ord * 10 + 2 FROM f
  UNION ALL SELECT r_id, r_name, 'place', source, ord * 10 + 1 FROM f),
e AS (
  SELECT node_id, upper(trim(regexp_replace(any_value(name), '[^A-Za-z0-9]+', ' ', 'g'))) AS label, any_value(entity_type) AS entity_type,
         list_sort(list(DISTINCT source)) AS docs, min(ord) AS ord
  FROM ent GROUP BY node_id),
ev AS (
  SELECT chunk_id AS src, s_id AS dst, 'supports_relation' AS relation, ord * 10 AS ord FROM f
  UNION ALL SELECT chunk_id, r_id, 'supports_relation', ord * 10 + 1 FROM f
  UNION ALL SELECT s_id, n_id, 'located_in', ord * 10 + 2 FROM f
  UNION ALL SELECT chunk_id, n_id, 'supports_relation', ord * 10 + 4 FROM f
  UNION ALL SELECT n_id, r_id, 'part_of', ord * 10 + 5 FROM f),
fe AS (SELECT src, dst, any_value(relation) AS relation, min(ord) AS ord FROM ev GROUP BY src, dst),
pairs AS (SELECT unnest(docs) AS d, node_id FROM e),
links AS (SELECT 'document::' || a.d AS src, 'document::' || b.d AS dst, count(*)::INT AS shared_entities FROM pairs a JOIN pairs b ON a.node_id = b.node_id AND a.d < b.d GROUP BY 1, 2),
edges AS (SELECT src, dst, relation, NULL::INT AS shared_entities, ord FROM fe UNION ALL SELECT src, dst, 'related_to', shared_entities, 1e15::BIGINT FROM links),
nodes AS (
  SELECT node_id, label, 'entity' AS node_type, entity_type, '' AS source FROM e
  UNION ALL SELECT chunk_id, chunk_id, 'chunk', '', source FROM f
  UNION ALL SELECT DISTINCT 'document::' || d, d, 'document', '', '' FROM pairs)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = _graph(spark, sf_dir)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return n.select("node_id", "label", "node_type", empty("entity_type"), empty("source"))


GRAPH_NODES = f"WITH {_FACTS} SELECT * FROM nodes"


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return graph.labelled(e, n).select("src", "dst", "relation", "shared_entities", "src_label", "dst_label")


GRAPH_EDGES = f"""
WITH {_FACTS}
SELECT src, dst, relation, shared_entities, a.label AS src_label, b.label AS dst_label FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst"""


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.document_links(graph.entity_nodes(facts(spark, sf_dir)))


DOCUMENT_LINKS = f"WITH {_FACTS} SELECT * FROM links"


def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_nodes(facts(spark, sf_dir)).select("node_id", "label", "entity_type", F.array_join("source_documents", ";").alias("documents"))


ENTITY_SOURCES = f"WITH {_FACTS} SELECT node_id, label, entity_type, array_to_string(docs, ';') AS documents FROM e"


def _seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    q = spark.createDataFrame([("1", "ASIA"), ("2", "What of NATION_7, or of Europe?"), ("3", "???")], "query_id string, query string")
    seeds = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", "s3"), ("3", "absent")], "query_id string, node_id string")
    return q, seeds


_SEEDS = """
q AS (SELECT * FROM (VALUES ('1', 'asia'), ('2', 'what of nation 7 or of europe')) t(query_id, k)),
cand AS (
  SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY ord, node_id) AS n
  FROM q, e WHERE contains(k, lower(label)) OR contains(lower(label), k)),
seed AS (
  SELECT * FROM (VALUES ('1', 's1'), ('2', 's2'), ('3', 's3'), ('3', 'absent')) t(query_id, node_id)
  UNION SELECT query_id, node_id FROM cand WHERE n <= 8),
both AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
d1 AS (SELECT query_id, node_id FROM seed UNION SELECT query_id, b FROM seed JOIN both ON node_id = a),
d2 AS (SELECT query_id, node_id FROM d1 UNION SELECT query_id, b FROM d1 JOIN both ON node_id = a)"""
_SEEDS = _SEEDS.replace("both AS", "around AS").replace("JOIN both", "JOIN around")


def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.query_entities(_seeds(spark)[0], graph.entity_nodes(facts(spark, sf_dir))).select("query_id", "node_id")


QUERY_ENTITIES = f"WITH {_FACTS}, {_SEEDS} SELECT query_id, node_id FROM cand WHERE n <= 8"


def _reach(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n, e = _graph(spark, sf_dir)
        q, seeds = _seeds(spark)
        every = seeds.unionByName(graph.query_entities(q, n.filter("node_type = 'entity'")).select("query_id", "node_id"))
        return graph.neighbourhood(e, every, depth)

    return run


subgraph_d1, subgraph_d2 = _reach(1), _reach(2)
SUBGRAPH_D1 = f"WITH {_FACTS}, {_SEEDS} SELECT * FROM d1"
SUBGRAPH_D2 = f"WITH {_FACTS}, {_SEEDS} SELECT * FROM d2"


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    q, seeds = _seeds(spark)
    return graph.local_context(n, e, seeds, q, depth=1)


GRAPH_CONTEXT = f"""
WITH {_FACTS}, {_SEEDS},
inside AS (SELECT a.query_id, src, dst, relation, row_number() OVER (PARTITION BY a.query_id ORDER BY edges.ord, src, dst) AS n FROM edges JOIN d1 a ON a.node_id = src JOIN d1 b ON b.node_id = dst AND a.query_id = b.query_id),
lines AS (SELECT query_id, string_agg(x.label || ' --[' || relation || ']--> ' || y.label, chr(10) ORDER BY n) AS context FROM inside JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst WHERE n <= 40 GROUP BY query_id)
SELECT ids.query_id, coalesce(context, 'No localized graph context was found for this query.') AS context FROM (VALUES ('1'), ('2'), ('3')) ids(query_id) LEFT JOIN lines USING (query_id)"""


def contributing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    q, seeds = _seeds(spark)
    return graph.contributing(n, e, seeds, q)[1].select("query_id", "n", "src", "dst", "relation", "src_label", "dst_label")


def contributing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    q, seeds = _seeds(spark)
    return graph.contributing(n, e, seeds, q)[0].select("query_id", "node_id", "label", "node_type", "entity_type")


_CONTRIBUTING = f"""
{_FACTS}, {_SEEDS},
cited AS (SELECT * FROM (VALUES ('1', 's1'), ('2', 's2'), ('3', 's3'), ('3', 'absent')) t(query_id, node_id)),
mem AS (SELECT * FROM cited UNION SELECT query_id, dst FROM cited JOIN edges ON src = node_id JOIN e ON e.node_id = dst UNION SELECT query_id, node_id FROM cand WHERE n <= 8)"""
CONTRIBUTING_NODES = f"WITH {_CONTRIBUTING} SELECT query_id, node_id, label, node_type, entity_type FROM mem JOIN nodes USING (node_id)"
CONTRIBUTING_EDGES = f"""
WITH {_CONTRIBUTING},
inside AS (SELECT a.query_id, src, dst, relation, row_number() OVER (PARTITION BY a.query_id ORDER BY edges.ord, src, dst) AS n FROM edges JOIN mem a ON a.node_id = src JOIN mem b ON b.node_id = dst AND a.query_id = b.query_id)
SELECT query_id, n::INT AS n, src, dst, relation, x.label AS src_label, y.label AS dst_label FROM inside JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst WHERE n <= 30"""


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return graph.metrics(n, e).withColumn("density", F.round("density", 9))


GRAPH_METRICS = f"""
WITH RECURSIVE {_FACTS},
two AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT node_id AS a, node_id AS b FROM nodes WHERE node_type = 'document' UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
least AS (SELECT b AS node_id, min(a) AS c FROM reach GROUP BY b),
parts AS (SELECT count(DISTINCT c) AS n FROM least),
hung AS (SELECT DISTINCT x.node_id FROM nodes x JOIN two ON two.a = x.node_id WHERE x.node_id NOT IN (SELECT node_id FROM least)),
comp AS (
  SELECT node_id AS a, node_id AS b FROM hung UNION SELECT comp.a, two.b FROM comp JOIN two ON comp.b = two.a),
rest AS (SELECT count(DISTINCT c) AS n FROM (SELECT b, min(a) AS c FROM comp GROUP BY b)),
alone AS (SELECT count(*) AS n FROM nodes WHERE node_type <> 'document' AND node_id NOT IN (SELECT a FROM two))
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
       round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0::DOUBLE)), 9) AS density,
       ((SELECT n FROM parts) + (SELECT n FROM rest) + (SELECT n FROM alone))::BIGINT AS components"""

QUERIES = {
    "graph_nodes": (graph_nodes, GRAPH_NODES), "graph_edges": (graph_edges, GRAPH_EDGES), "document_links": (document_links, DOCUMENT_LINKS), "entity_sources": (entity_sources, ENTITY_SOURCES),
    "query_entities": (query_entities, QUERY_ENTITIES), "subgraph_d1": (subgraph_d1, SUBGRAPH_D1), "subgraph_d2": (subgraph_d2, SUBGRAPH_D2), "graph_context": (graph_context, GRAPH_CONTEXT),
    "contributing_nodes": (contributing_nodes, CONTRIBUTING_NODES), "contributing_edges": (contributing_edges, CONTRIBUTING_EDGES), "graph_metrics": (graph_metrics, GRAPH_METRICS),
}
