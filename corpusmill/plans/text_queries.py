"""Chunking, identities, labels and parsing as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as tx
from ..operators import chunking, pii
from ..sources import files
from .shared import sql_key, sql_strip, sql_truncate, sql_uuid, table


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("sha256_id"), tx.chunk_id(F.col("source"), F.col("doc_id"), F.col("text"), sha1=True).alias("sha1_id"))


CHUNK_IDS = """
SELECT doc_id, 'chunk_' || substr(sha256(source || ':' || doc_id || ':' || text), 1, 16) AS sha256_id,
       'chunk_' || substr(sha1(source || ':' || doc_id || ':' || text), 1, 16) AS sha1_id
FROM documents"""


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, sf_dir, "documents"))


FIXED_WINDOWS = f"""
WITH b AS (SELECT doc_id, source, {sql_strip("regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')")} AS body FROM documents),
s AS (SELECT *, unnest(range(0, greatest(0, ceil((length(body) - 1600) / 1400.0)::INT) * 1400 + 1, 1400)) AS start_char FROM b WHERE length(body) > 0),
w AS (SELECT doc_id, source, start_char, least(length(body), start_char + 1600) AS end_char, {sql_strip("substr(body, (start_char + 1)::INT, 1600)")} AS content FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS sequence FROM w WHERE content <> '')
SELECT doc_id, 'chunk_' || substr(sha1(source || ':' || sequence || ':' || content), 1, 16) AS chunk_id, source, content,
       sequence::INT AS sequence, start_char::INT AS start_char, end_char::INT AS end_char
FROM n"""

_MARKDOWN = "concat('before ', lang, '\n# Title ', doc_id, '\n## Empty\n###  ', source, '  \n', text)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(table(spark, sf_dir, "documents").select("doc_id", F.expr(_MARKDOWN).alias("markdown")))


SECTIONS = f"""
WITH m AS (SELECT doc_id, lang, source, {sql_strip("text")} AS body FROM documents)
SELECT doc_id, 1 AS section, 'Document' AS title, 'before ' || lang AS body FROM m
UNION ALL
SELECT doc_id, 2, source, body FROM m WHERE body <> ''"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sliding_windows(_bodies(spark, sf_dir))


_EDGE = """greatest(
  CASE WHEN strpos(reverse(seg), ' .') > 0 THEN p0 + length(seg) - strpos(reverse(seg), ' .') - 1 ELSE -1 END,
  CASE WHEN strpos(reverse(seg), chr(10) || chr(10)) > 0 THEN p0 + length(seg) - strpos(reverse(seg), chr(10) || chr(10)) - 1 ELSE -1 END)"""
_WINDOWS = f"""
t AS (SELECT doc_id, source, {sql_strip("text")} AS t FROM documents),
step AS (
  SELECT doc_id, source, t, 0::BIGINT AS p0, 1 AS i,
         (SELECT CASE WHEN length(t) <= 1800 THEN length(t) WHEN e > 900 THEN e + 1 ELSE 1800 END FROM (SELECT {_EDGE} AS e FROM (SELECT substr(t, 1, 1800) AS seg, 0::BIGINT AS p0))) AS stop
  FROM t WHERE t <> ''
  UNION ALL
  SELECT doc_id, source, t, p0, i,
         CASE WHEN p0 + 1800 >= length(t) THEN length(t) WHEN e > p0 + 900 THEN e + 1 ELSE p0 + 1800 END
  FROM (SELECT *, {_EDGE} AS e FROM (SELECT doc_id, source, t, stop - 200 AS p0, i + 1 AS i, substr(t, (stop - 200 + 1)::INT, 1800) AS seg FROM step WHERE stop < length(t)))),
win AS (SELECT doc_id, source, i, {sql_strip("substr(t, (p0 + 1)::INT, (stop - p0)::INT)")} AS content FROM step)"""
SLIDING_WINDOWS = f'WITH RECURSIVE {_WINDOWS} SELECT doc_id, i::INT AS "window", content FROM win WHERE content <> \'\''


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("markdown", F.col("text"))
    return chunking.markdown_chunks(docs).drop("metadata")


MARKDOWN_CHUNKS = f"""
WITH RECURSIVE {_WINDOWS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sequence, 'Document' || chr(10) || chr(10) || content AS whole FROM win WHERE content <> '')
SELECT doc_id, 'chunk_' || substr(sha256(source || ':text:' || sequence || ':' || whole), 1, 16) AS chunk_id, source, 'text' AS content_type,
       whole AS content, 'Document' AS title, sequence::INT AS sequence
FROM n"""

#: A heading, a paragraph, a table, and the whole text with each line as a paragraph.
_TABLED = "concat('# Title ', doc_id, '\n\nBefore the table.\n\n| a | b |\n|---|---|\n| ', doc_id, ' | ', lang, ' |\n\nAfter it.\n\n', replace(text, '\n', '\n\n'))"


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_TABLED).alias("markdown"))
    return chunking.structured_chunks(docs).withColumn("has_table", F.col("metadata.has_table")).drop("metadata")


STRUCTURED_CHUNKS = f"""
WITH RECURSIVE t AS (SELECT doc_id, source, text, 'Title ' || doc_id AS title, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' AS tab FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls) + 1)) AS i, unnest(list_prepend('After it.', ls)) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)),
b AS (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, {sql_strip("regexp_replace(raw, '[ \t]+', ' ', 'g')")} AS body FROM l) WHERE body <> ''),
s AS (
  SELECT doc_id, n, body, 0 AS run, length(body) AS held FROM b WHERE n = 1
  UNION ALL
  SELECT doc_id, b.n, b.body, CASE WHEN held >= 300 AND held + 2 + length(b.body) > 1800 THEN run + 1 ELSE run END,
         CASE WHEN held >= 300 AND held + 2 + length(b.body) > 1800 THEN length(b.body) ELSE held + 2 + length(b.body) END
  FROM s JOIN b USING (doc_id) WHERE b.n = s.n + 1),
c AS (
  SELECT doc_id, source, title, 1 AS sequence, 'text' AS content_type, 'Before the table.' AS content FROM t
  UNION ALL SELECT doc_id, source, title, 2, 'table', '## ' || title || chr(10) || chr(10) || 'Before the table.' || chr(10) || chr(10) || tab FROM t
  UNION ALL SELECT doc_id, source, title, 3 + run, 'text', content FROM t JOIN (SELECT doc_id, run, string_agg(body, chr(10) || chr(10) ORDER BY n) AS content FROM s GROUP BY ALL) USING (doc_id))
SELECT doc_id, 'chunk_' || substr(sha1(source || ':' || sequence || ':' || content), 1, 16) AS chunk_id, source, content_type, content, title, sequence::INT AS sequence,
       CASE WHEN content_type = 'table' THEN 'true' ELSE 'false' END AS has_table
FROM c"""


def chart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = "concat('# Report\n\n## File: `img/x_pages_', doc_id, '_to_', doc_id + 4, '.png`\nA chart about ', lang, '.\n\n---\n\n## File: `y.png`\nVision analysis failed: 500\n\n---\n\n## File: `page-3.png`\nLast one.\n\n---\n\n')"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(report).alias("report"))
    last = docs.select("doc_id", F.lit(2).alias("last"))
    rows = chunking.chart_chunks(docs, last)
    return rows.select("doc_id", "chunk_id", "source", "content_type", "content", "title", "sequence", F.col("metadata.image_file").alias("image_file"), F.col("metadata.page_range").alias("page_range"))


CHART_CHUNKS = """
WITH e AS (
  SELECT doc_id, source, 3 AS sequence, 'img/x_pages_' || doc_id || '_to_' || (doc_id + 4) || '.png' AS file, 'A chart about ' || lang || '.' AS body, doc_id || '-' || (doc_id + 4) AS page_range FROM documents
  UNION ALL SELECT doc_id, source, 4, 'page-3.png', 'Last one.', '3' FROM documents),
c AS (SELECT *, 'Chart/Image file: ' || file || chr(10) || chr(10) || 'Vision summary:' || chr(10) || body AS content FROM e)
SELECT doc_id, 'chunk_' || substr(sha256(source || ':chart:' || sequence || ':' || content), 1, 16) AS chunk_id, source, 'chart_summary' AS content_type, content,
       regexp_extract(file, '([^/]*)$', 1) AS title, sequence, file AS image_file, page_range
FROM c"""


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("cast(n_chars div 500 as int)").alias("pages"))
    return files.page_ranges(docs, size=5)


PAGE_RANGES = """
SELECT doc_id, pages, start::INT AS start, least(start + 4, pages)::INT AS "end"
FROM (SELECT doc_id, (n_chars // 500)::INT AS pages, unnest(range(1, (n_chars // 500) + 1, 5)) AS start FROM documents)"""


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), 320).alias("snippet"), F.size(parsing.pieces(F.col("text"))).alias("pieces"), tx.squash(F.col("text")).alias("squashed"))


TRUNCATION = f"""
SELECT doc_id, {sql_truncate("text", 320)} AS snippet, ceil(length(text) / 8.0)::INT AS pieces,
       trim(regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS squashed
FROM documents"""


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).union(table(spark, sf_dir, "nation").select("n_name")).distinct()
    n = F.col("name")
    return names.select("name", tx.entity_key(n).alias("canonical"), tx.entity_id(n).alias("entity_id"), tx.entity_label(n).alias("label"), tx.relation_label(n).alias("relation"))


ENTITY_NAMES = f"""
WITH n AS (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation)
SELECT name, {sql_key("name")} AS canonical, {sql_uuid("name")} AS entity_id, upper({sql_key("name")}) AS label,
       regexp_replace(regexp_replace(lower(name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS relation
FROM n"""


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", tx.cache_key(F.col("text")).alias("cache_key"), F.size(tx.tokens(F.col("text"))).alias("n_tokens"))


QUERY_TEXTS = """
SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS cache_key, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens
FROM conversations WHERE role = 'user'"""


def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    head = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    none = F.lit(None).cast("string")
    return p.select("page_id", head.alias("title"), tx.source_type(F.lit("text"), F.col("html"), head, none).alias("kind"), tx.confidence_label(F.col("page_id") / 100).alias("confidence"), tx.page_label(F.col("page_id").cast("string")).alias("page"))


EVIDENCE_LABELS = r"""
WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, lower(html) AS body FROM pages)
SELECT page_id, title,
  CASE WHEN regexp_matches(body, '\|[-:\s|]+\||\n\||<(table|tr|td)\b') THEN 'table'
       WHEN regexp_matches(lower(title), '\b(chart|graph|figure)\b') OR regexp_matches(body, '\b(chart|graph|figure)\b|chart/image file|<!--\s*(chart|graph)\s*-->|<svg\b') THEN 'chart'
       WHEN regexp_matches(lower(title), '\.(png|jpg|jpeg)$') OR regexp_matches(body, '\.(png|jpg|jpeg)|<!--\s*(image|figure)\s*-->|<img\b') THEN 'image'
       ELSE 'text' END AS kind,
  CASE WHEN page_id / 100 <= 1 THEN floor(page_id / 100 * 100 + 0.5)::BIGINT || '%' WHEN page_id / 100 <= 100 THEN floor(page_id / 100 + 0.5)::BIGINT || '%' END AS confidence,
  'Page ' || page_id AS page
FROM p"""


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.get_json_object(parsing.json_body(fenced), "$.k").alias("k"), parsing.sse_frame(F.col("event_type"), F.col("props")).alias("frame"))


EVENT_PROPS = """
SELECT event_id, json_extract_string(props, '$.k') AS k, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame
FROM events"""


def tables_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    md = F.expr("concat('| key | **name** |\n|---|---|\n| ', n_nationkey, ' | ', n_name, ' |\n')")
    html = F.expr("concat('<p>x</p><table><tr><th>key</th><th>name</th></tr>\n<tr><td>', n_nationkey, '</td><td><b>', n_name, '</b></td></tr></table>')")
    return n.select("n_nationkey", F.to_json(parsing.markdown_table(md)).alias("from_markdown"), F.to_json(parsing.html_table(html)).alias("from_html"))


TABLES_IN_TEXT = """
SELECT n_nationkey, '[["key","name"],["' || n_nationkey || '","' || n_name || '"]]' AS from_markdown, '[["key","name"],["' || n_nationkey || '","' || n_name || '"]]' AS from_html
FROM nation"""


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rank = F.expr("concat('{\"rankings\":[{\"index\":2,\"logit\":', n_nationkey, '.5},{\"index\":0,\"score\":1.25}]}')")
    vec = F.expr("concat('{\"data\":[{\"index\":1,\"embedding\":[2.0]},{\"index\":0,\"embedding\":[', n_nationkey, '.0]}]}')")
    facts = F.expr("concat('Here: {\"entities\":[\"', n_name, '\",{\"name\":\" \"},{\"name\":\"x\",\"type\":\"place\"}],\"relations\":[{\"source\":\"', n_name, '\",\"target\":\"x\"},{\"source\":\"\"}]} done')")
    f = parsing.facts_of(facts)
    return n.select(
        "n_nationkey", F.to_json(parsing.rerank_scores(rank, F.lit(3))).alias("scores"), F.to_json(parsing.embeddings_of(vec)).alias("vectors"),
        F.array_join(F.transform(f["entities"], lambda e: F.concat_ws("/", e["name"], e["type"])), ",").alias("entities"),
        F.array_join(F.transform(f["relations"], lambda r: F.concat_ws("/", r["source"], r["target"], r["relation"])), ",").alias("relations"),
    )


MODEL_REPLIES = """
SELECT n_nationkey, '[1.25,0.0,' || n_nationkey || '.5]' AS scores, '[[' || n_nationkey || '.0],[2.0]]' AS vectors,
       n_name || '/other,x/place' AS entities, n_name || '/x/related_to' AS relations
FROM nation"""


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.mask_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "masked", F.size("audit").alias("n_values"))


def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.token_table(table(spark, sf_dir, "documents"))


def pii_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.mask_table(docs, pii.token_table(docs))


QUERIES = {
    "chunk_ids": (chunk_ids, CHUNK_IDS), "fixed_windows": (fixed_windows, FIXED_WINDOWS), "sections": (sections, SECTIONS), "sliding_windows": (sliding_windows, SLIDING_WINDOWS),
    "markdown_chunks": (markdown_chunks, MARKDOWN_CHUNKS), "structured_chunks": (structured_chunks, STRUCTURED_CHUNKS), "chart_chunks": (chart_chunks, CHART_CHUNKS), "page_ranges": (page_ranges, PAGE_RANGES),
    "truncation": (truncation, TRUNCATION), "entity_names": (entity_names, ENTITY_NAMES), "query_texts": (query_texts, QUERY_TEXTS), "evidence_labels": (evidence_labels, EVIDENCE_LABELS),
    "event_props": (event_props, EVENT_PROPS), "tables_in_text": (tables_in_text, TABLES_IN_TEXT), "model_replies": (model_replies, MODEL_REPLIES), "pii_mask": (pii_mask, None), "pii_tokens": (pii_tokens, None), "pii_table": (pii_table, None),
}
