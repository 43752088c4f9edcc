"""The ten operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, langid, mixing, neardup, quality, secret_ledger, store, token_store, toxicity, warc

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_ledger.BlobLedger(spark, store.fresh_path(spark, "ledger"))
    return secret_ledger.secret_report(_table(spark, sf_dir, "documents"), ledger)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), WEIGHTS)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_KINDS = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))


def _secrets_sql() -> str:
    parts = [
        f"SELECT rid, doc_id, '{kind}' AS kind, {i} AS kind_no, {least} AS least, regexp_extract_all(t, '{pattern}') AS m, "
        f"regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM d"
        for i, (kind, pattern, group, least) in enumerate(_KINDS)
    ]
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in _KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT rid, kind, kind_no, length(v[i]) >= least AS fits, length(m[i]) AS width,
         sum(length(g[i]) + length(m[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop
  FROM each),
spans AS (SELECT rid, kind, kind_no, stop - width AS start, stop FROM placed WHERE fits),
told AS (
  SELECT rid, {counts},
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) AS spans
  FROM spans GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bl AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT rid, n, i, w[i:i + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
met AS (SELECT rid, item, spots.n, i FROM spots JOIN win ON spots.n = win.n AND spots.win = win.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

_NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
u AS (SELECT CASE WHEN len(w) > 0 THEN w ELSE ['', t] END AS k, min(doc_id) AS node, any_value(w) AS w FROM d GROUP BY 1),
s AS (
  SELECT node, s, count(*) AS c
  FROM (SELECT node, w[i:i + least(5, len(w)) - 1] AS s FROM (SELECT node, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM u WHERE len(w) > 0))
  GROUP BY 1, 2),
size AS (SELECT node, sum(c) AS n FROM s GROUP BY 1),
overlap AS (SELECT a.node AS a, b.node AS b, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
link AS (SELECT a, b FROM overlap JOIN size x ON x.node = a JOIN size y ON y.node = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node AS a, node AS b FROM u UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id FROM d JOIN u ON u.k = CASE WHEN len(d.w) > 0 THEN d.w ELSE ['', d.t] END JOIN class USING (node)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_quality, op3_secrets, op4_warc, op5_mixing, op6_neighbours, op7_decontamination, op8_tokens, op9_near_duplicates, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": _secrets_sql(), "op4_warc": _WARC_SQL, "op7_decontamination": _DECONTAMINATION_SQL, "op9_near_duplicates": _NEAR_SQL}
