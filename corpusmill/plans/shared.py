"""SQL pieces that several oracles share, and table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALIASES, ENTITY_PREFIX, URL_NAMESPACE

#: A white space class for RE2.
SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_key(x: str) -> str:
    key = f"lower(trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"
    spellings = " ".join(f"WHEN '{spelling}' THEN '{name}'" for spelling, name in ALIASES.items())
    return f"CASE {key} {spellings} ELSE {key} END"


def sql_uuid(x: str) -> str:
    """Name-based UUID of an entity name."""
    h = f"sha1(unhex('{URL_NAMESPACE}') || encode('{ENTITY_PREFIX}' || {sql_key(x)}))"
    variant = f"lower(printf('%02x', (('0x' || substr({h}, 17, 2))::INT & 63) | 128))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12))"


def sql_truncate(x: str, most: int) -> str:
    s = sql_strip(x)
    return f"CASE WHEN length({s}) <= {most} THEN {s} ELSE regexp_replace(substr({s}, 1, {most - 20}), '{SPACE}+$', '') || chr(10) || '...[truncated]' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id d<doc_id>, in order of doc_id."""
    docs = table(spark, sf_dir, "documents")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", F.lit("text").alias("content_type"), F.col("text").alias("content"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").cast("int").alias("sequence"), none.alias("metadata"), F.col("doc_id").alias("ordinal"),
    )


#: BM25 of benchmark texts over documents, in SQL: a chain of CTEs ending in ``bm`` (query_id, doc_id, score).
BM25_CTES = """
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
bm AS (
  SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM ask JOIN idf USING (term) JOIN post USING (term), size GROUP BY 1, 2)"""
