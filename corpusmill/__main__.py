"""Command line: python -m corpusmill --corpus PATH [--markdown PATH] [--query TEXT]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.service import CorpusService
from .sources.files import read_markdown


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusmill")
    p.add_argument("--corpus", required=True, help="folder of the corpus's tables")
    p.add_argument("--markdown", help="files to ingest; sources that are there already are left alone")
    p.add_argument("--batch", type=int, default=1, help="number of this ingestion; the same number replaces itself")
    p.add_argument("--chunk-chars", type=int, default=1800)
    p.add_argument("--query")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    service = CorpusService(spark, a.corpus)
    if a.markdown:
        docs = read_markdown(spark, a.markdown).withColumn("doc_id", F.crc32("source"))
        service.ingest(docs, a.batch, a.chunk_chars).show(truncate=False)
    if a.query:
        service.chat(spark.createDataFrame([("1", a.query)], "query_id string, query string"), a.batch).show(truncate=False)
    service.sources().show(truncate=False)


if __name__ == "__main__":
    main()
