from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import models, parsing


def value(spark, text, f):
    r = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()[0]
    return [x.asDict() if hasattr(x, "asDict") else x for x in r] if isinstance(r, list) else r


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"a":1}\n```', {"a": 1}), ("no json here", {"entities": [], "relations": []}), ('so: {"a":{"b":2}} end', {"a": {"b": 2}}), ("{broken", {"entities": [], "relations": []}), (None, {"entities": [], "relations": []})],
)
def test_tolerant_json(spark, raw, want):
    assert json.loads(value(spark, raw, parsing.json_body)) == want


def test_rerank_forms(spark):
    f = lambda c: parsing.rerank_scores(c, F.lit(3))
    assert value(spark, '{"rankings":[{"index":1,"logit":2.5,"score":9}]}', f) == [0.0, 2.5, 0.0]
    assert value(spark, '{"results":[{"document_index":2,"score":1},{"relevance_score":4}]}', f) == [4.0, 0.0, 1.0]
    assert value(spark, '{"scores":[0.1,0.2]}', f) == [0.1, 0.2]


def test_embeddings(spark):
    assert value(spark, '{"data":[{"index":1,"embedding":[2]},{"embedding":[1]}]}', parsing.embeddings_of) == [[1.0], [2.0]]
    assert value(spark, '{"embeddings":[[3,4]]}', parsing.embeddings_of) == [[3.0, 4.0]]


def test_sub_questions(spark):
    assert value(spark, '["a ",{"question":"","sub_question":"b"},"",{"text":"c"}]', parsing.sub_questions) == ["a", "b", "c"]
    assert value(spark, '{"x":1}', parsing.sub_questions) == []


def test_sse(spark):
    stream = 'event: a\ndata: {"x":1}\n\ndata: {"y":\ndata: 2}\n\nevent: bad\ndata: {oops\n\nevent: none\n\n'
    assert value(spark, stream, parsing.sse_events) == [{"event": "a", "data": '{"x":1}'}, {"event": "message", "data": '{"y":2}'}]
    assert value(spark, "x", lambda c: parsing.sse_frame(c, F.lit("{}"))) == "event: x\ndata: {}\n\n"


def test_pieces(spark):
    assert value(spark, "abcdefghij", parsing.pieces) == ["abcdefgh", "ij"]
    assert value(spark, "", parsing.pieces) == []


def test_tables(spark):
    md = "intro\n| a | **b** |\n|---|:--|\n| 1 | [S1] x |\n"
    assert value(spark, md, parsing.markdown_table) == [["a", "b"], ["1", "x"]]
    assert value(spark, "| a |", parsing.markdown_table) is None
    html = "<TABLE><tr><th>a</th></tr>\n<tr></tr><tr><td><i>1</i></td></tr></TABLE>"
    assert value(spark, html, parsing.html_table) == [["a"], ["1"]]
    assert value(spark, "<p>", parsing.html_table) is None


def test_vision_entries(spark):
    report = "# R\n\n## File: `a/b.png`\nText\nmore\n\n---\n\n## File: `c.png`\n\n---\n## File: `d.png`\nlast"
    assert value(spark, report, parsing.vision_entries) == [{"file": "a/b.png", "body": "Text\nmore"}, {"file": "d.png", "body": "last"}]


def test_answer_sections(spark):
    got = value(spark, "Summary: s here\nKey Findings\n- k\nSources: z", parsing.answer_sections)
    assert got == {"Summary": "s here", "Key Findings": "- k", "Sources": "z"}
    assert value(spark, "plain", parsing.answer_sections) == {"Summary": "plain"}


def test_evidence_blocks(spark):
    assert value(spark, "# H\n\n\npara **b**", parsing.evidence_blocks) == [{"type": "heading", "text": "H"}, {"type": "paragraph", "text": "para b"}]


def test_category_and_multi_hop(spark):
    assert value(spark, " TRICK ", parsing.category) == "trick"
    assert value(spark, "odd", parsing.category) == "answerable"
    one = spark.range(1).select(parsing.multi_hop(F.lit(True), F.array(F.lit("a"))), parsing.multi_hop(F.lit(True), F.array(F.lit("a"), F.lit("b")))).first()
    assert one[0] == [] and one[1] == ["a", "b"]


def test_retry():
    waits, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise models.CallError(429 if len(calls) == 1 else 503)
        return "ok"

    assert models.with_retry(busy, sleep=waits.append) == "ok" and waits == [5, 4]
    with pytest.raises(models.CallError):
        models.with_retry(lambda: (_ for _ in ()).throw(models.CallError(400)), sleep=waits.append)


def test_models(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = rows.select(models.embed_column(F.col("t")).alias("v")).collect()
    assert got[0].v == got[1].v and sum(x * x for x in got[0].v) == pytest.approx(1)
    assert set(got[2].v) == {0.0}
    assert rows.select(models.rerank_column(F.col("t"), F.lit("b c")).alias("s")).first().s == 0.5

    class Down:
        def write(self, prompt):
            raise models.CallError(400, "no")

    assert rows.select(models.write_column(F.col("t"), Down, failed="Failed")).first()[0].startswith("Failed")
    short = rows.select(models.hyde_text(F.col("t"))).first()[0]
    assert short == "a b"
