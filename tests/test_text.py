from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_strip_is_unicode_wide(spark):
    assert value(spark, " \t\n x y  \n", tx.strip) == "x y"
    assert value(spark, " a \n b ", tx.squash) == "a b"
    assert value(spark, " a \t b\r\nc\rd ", tx.squash_blanks) == "a b\nc\nd"


def test_lines_split_at_all_breaks(spark):
    assert value(spark, "a\r\nb\x0bc d\x1ce\n", tx.lines) == ["a", "b", "c", "d", "e"]
    assert value(spark, "", tx.lines) == []


def test_chunk_ids(spark):
    r = spark.range(1).select(tx.chunk_id(F.lit("a"), F.lit(1), F.lit("b")), tx.chunk_id(F.lit("a"), F.lit(1), F.lit("b"), sha1=True)).first()
    assert tuple(r) == ("chunk_070ff5beb6cd768f", "chunk_ea46941b54d6ab9c")


def test_entity_names(spark):
    assert value(spark, " T.C.S ", tx.entity_key) == "t c s"
    assert value(spark, "TCS", tx.entity_key) == "tata consultancy services"
    assert value(spark, "Ünïx", tx.entity_key) == "n x"
    want = str(uuid.uuid5(uuid.NAMESPACE_URL, "hybrid-graphrag/entity/acme corp"))
    assert value(spark, "Acme, Corp.", tx.entity_id) == want
    assert value(spark, "日本", tx.entity_label) == "UNKNOWN_ENTITY"
    assert value(spark, "  Is Part-Of! ", tx.relation_label) == "is_part_of"
    assert value(spark, "!!", tx.relation_label) == "related_to"


def test_truncate(spark):
    assert value(spark, "x" * 30, lambda c: tx.truncate(c, 25)) == "xxxxx\n...[truncated]"
    assert value(spark, " short ", lambda c: tx.truncate(c, 25)) == "short"


@pytest.mark.parametrize(("name", "want"), [("a_pages_1_to_5_img.png", "1-5"), ("Page-7.png", "7"), ("x.png", None)])
def test_page_range(spark, name, want):
    assert value(spark, name, tx.page_range) == want


def test_tidy_query(spark):
    assert value(spark, "  what   is\tthis* (really)? ", tx.tidy_query) == "What is this really?"
    assert value(spark, "", tx.tidy_query) == ""


@pytest.mark.parametrize(("v", "want"), [("0.5", "50%"), ("88", "88%"), ("-1", None), ("101", None), ("0.125", "13%")])
def test_confidence(spark, v, want):
    assert value(spark, v, tx.confidence_label) == want


def test_page_labels(spark):
    assert value(spark, "3", tx.page_label) == "Page 3"
    assert value(spark, "page 3", tx.page_label) == "page 3"
    assert value(spark, "2-9", tx.page_count) == 9
    assert value(spark, "4", tx.page_count) == 4
    assert value(spark, "x", tx.page_count) is None


def test_citation_label(spark):
    def label(page=None, title="", content="", sequence=0, source="", marker=""):
        cols = [F.lit(x) for x in (page, title, content, sequence, source, marker)]
        return spark.range(1).select(tx.citation_label(cols[0].cast("string"), *cols[1:])).first()[0]

    assert label(page="4") == "Page 4"
    assert label(title="Table 2.1 sales") == "Table 2.1"
    assert label(content="see Figure 7 here") == "Figure 7"
    assert label(sequence=3) == "Section 3"
    assert label(source="annual.pdf") == "Annual Report"
    assert label(source="x" * 30) == "x" * 23 + "..."
    assert label(marker="S2") == "S2"
    assert label() == "Source"


def test_source_type(spark):
    def kind(ct="", content="", title="", image=None):
        return spark.range(1).select(tx.source_type(F.lit(ct), F.lit(content), F.lit(title), F.lit(image).cast("string"))).first()[0]

    assert kind(content="x\n| a | b |\n|---|---|") == "table"
    assert kind(ct="chart_summary") == "chart"
    assert kind(image="a.png") == "image"
    assert kind(content="plain") == "text"
