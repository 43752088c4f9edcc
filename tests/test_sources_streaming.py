from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.models import embed_column
from corpusmill.sources import files
from corpusmill.sources.tables import Corpus, checked_vectors, source_names
from corpusmill.streaming import ingest


def test_page_ranges(spark):
    d = spark.createDataFrame([(7,), (0,)], "pages int")
    assert [(r.start, r.end) for r in files.page_ranges(d, size=3).collect()] == [(1, 3), (4, 6), (7, 7)]
    assert [(r.start, r.end) for r in files.page_ranges(d.limit(1), size=0).limit(2).collect()] == [(1, 0), (2, 1)]


def test_markdown_and_images(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    r = files.read_markdown(spark, str(tmp_path)).first()
    assert (r.source, r.markdown) == ("a.md", "# A\nx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_markdown(spark, str(tmp_path / "none"))
    i = spark.createDataFrame([("w", 300, 100, 10), ("s", 100, 100, 10), ("n", 300, 100, None), ("c", 300, 100, 20000)], "file string, width int, height int, n_colors int")
    assert [r.file for r in files.chart_images(i).collect()] == ["w"]
    b = files.read_binary(spark, str(tmp_path)).select(files.image_base64(F.col("content"))).first()[0]
    assert b == "IyBBCng="
    got = files.resolve_image(spark.createDataFrame([("x/a.md",), ("q/z.md",)], "image_file string"), files.read_binary(spark, str(tmp_path))).collect()
    assert [bool(r.resolved) for r in sorted(got, key=lambda r: r.image_file, reverse=True)] == [True, False]


def test_reports(spark):
    d = spark.createDataFrame([("b.png", "B"), ("a.png", "A")], "file string, summary string")
    text = files.vision_report(d).first().report
    assert text.index("a.png") < text.index("b.png") and text.endswith("---\n\n")
    assert files.vision_report(d.limit(0)).first().report == files.NO_CHARTS


def test_uploads(spark):
    up = spark.createDataFrame([("a.PDF", b"x"), ("b.pdf", b""), ("c.txt", b"x"), ("d.pdf", b"x")], "source string, content binary")
    have = spark.createDataFrame([("d.pdf",)], "source string")
    assert {r.source: r.status for r in files.uploads(up, have).collect()} == {"a.PDF": "new", "b.pdf": "empty", "c.txt": "wrong_type", "d.pdf": "known"}


def test_cases(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"query":" q ","relevant_ids":[2,"a"],"relevant_id":"z"}\n\n{"query":"r"}\n')
    got = files.read_cases(spark, str(p)).orderBy("case_id").collect()
    assert [(r.case_id, r["query"], r.relevant_ids) for r in got] == [(1, "q", ["z", "2", "a"]), (3, "r", [])]
    p.write_text('{"query":"ok"}\n{"relevant_id":"x"}\n')
    with pytest.raises(Exception, match="Missing query on line 2"):
        files.read_cases(spark, str(p)).collect()


def test_upserts(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, source string, ordinal long")
    assert not c.has("chunks")
    c.upsert("chunks", rows(("a", "s", 2), ("b", "t", 1)), 1)
    c.upsert("chunks", rows(("a", "u", 3)), 2)
    assert {r.chunk_id: r.source for r in c.read("chunks", "chunk_id").collect()} == {"a": "u", "b": "t"}
    c.compact("chunks", "chunk_id", 3)
    assert {r.chunk_id: r.source for r in c.read("chunks", "chunk_id").collect()} == {"a": "u", "b": "t"}
    assert c.sources() == ["t", "u"] == source_names(c.read("chunks", "chunk_id"))
    c.reset()
    assert not c.has("chunks")
    with pytest.raises(ValueError):
        checked_vectors(rows(("a", "s", 1)), spark.createDataFrame([], "id string, embedding array<double>"))


def test_ingest_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, 1, 5, "# A\nalpha"), ("f", 1, 6, 10, "beta"), ("g", 2, 1, 5, "")], ingest.PAGES)
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    for _ in range(2):
        ingest.ingest(ingest.page_stream(spark, f"{tmp_path}/pages"), c, f"{tmp_path}/cp", embed_column).awaitTermination()
    rows = c.read("chunks", "chunk_id").orderBy("sequence").collect()
    assert [(r.sequence, r.title, r.metadata["page_range"]) for r in rows] == [(1, "A", "1-5"), (2, "Document", "6-10")]
    facts = lambda d: d.select("chunk_id", F.array(F.struct(F.lit("x").alias("name"), F.lit("y").alias("type"))).alias("entities"))
    ingest.extract(c, facts, f"{tmp_path}/cp2").awaitTermination()
    assert c.read("facts", "chunk_id").count() == 2
    assert c.read("vectors", "id").count() == 2


def test_running_counts(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    schema = "chunk_id string, source string, ord long, entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,relation:string>>"
    c.upsert("facts", spark.createDataFrame([("a", "s", 1, [("Rome", "place"), ("?!", "x")], [("Rome", "Italy", "in")])], schema), 1)
    c.upsert("facts", spark.createDataFrame([("b", "s", 2, [("ROME", "place")], [("Rome", "Italy", "of")]), ("c", "s", 3, [], [])], schema), 2)
    # Chunk a leads to Rome and Italy, Rome to Italy; chunk b leads to both again.
    assert [tuple(r) for r in ingest.running(c).orderBy("batch").collect()] == [(1, 1, 2, 3), (2, 3, 2, 5)]


def test_event_windows_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/ev")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ev")
    q = ingest.tumbling(s, "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == e.count() == ingest.tumbling(e, "1 day").agg(F.sum("n")).first()[0]


def test_progress_and_frames(spark):
    e = spark.createDataFrame([(1, "f", "OCR"), (2, "f", "Ready"), (3, "f", "odd")], "seq int, source string, stage string")
    assert [(r.percent, r.so_far) for r in ingest.progress(e).orderBy("seq").collect()] == [(30, 30), (100, 100), (55, 100)]
    f = ingest.event_frames(spark.createDataFrame([("done", 3, None)], "kind string, n int, x string")).first().frame
    assert f == 'event: done\ndata: {"n":3,"x":null}\n\n'
