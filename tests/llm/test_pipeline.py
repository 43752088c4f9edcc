from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert 0.5 * n < docs.select("doc_id").distinct().count() <= n


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    assert corpus_pipeline.run(spark, SF).count() == len(got)


def test_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None, "a text without an id but with quite a few words in it", "en", "x"), (9001, None, None, None), (9002, "", "en", ""), (9003, "!!", "de", "x"), (9004, "word " * 30_000, "en", "x")]
    odd += [(9005, "these nine words stand here twice in one row", "en", "x")] * 2 + [(9006, "These nine words stand here, twice, in one row!", "fr", "y")]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    names = {"rk": 1, "rk_": 2, "__rk": 3, "n": 4, "size": 5, "h": 6, "copies": 7, "bucket": 8, "known": 9}
    rows = docs.select(more.columns).unionByName(more).withColumns({k: F.lit(v) for k, v in names.items()})
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, rows.limit(0), SF)
        assert empty.columns == columns and empty.count() == 0, name
        before = {r.doc_id for r in rows.filter("doc_id is null or doc_id > 9000").collect()}
        rows = store.keep(stage(spark, rows, SF), "t")
        assert rows.columns == columns, name
        assert rows.filter(F.struct(*names) != F.struct(*[F.lit(v) for v in names.values()])).count() == 0, name
        if name == "near_duplicates":
            kept = [r.doc_id for r in rows.filter("doc_id is null or doc_id > 9000").collect()]
            # Null and empty texts are equal; of the alike rows the smallest doc_id stays, once.
            gone = {b for a, b in ((9001, 9002), (9005, 9006)) if a in before}
            assert sorted(kept, key=str) == sorted(before - gone, key=str)
    tokens = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert tokens.count() == rows.count()
