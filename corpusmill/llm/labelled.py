"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: int, chars: int) -> DataFrame:
    """(doc_id, y, text) of up to ``each`` documents of either label with ``chars`` characters or fewer, chosen by hash.

    A doc_id with both labels, or a null one, is left out; repeated label rows count once, and of rows that
    repeat a doc_id the smallest text counts. So at most 2 x ``each`` rows come back.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
    marks = marks.agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top").select("doc_id", "y")
    short = docs.filter(learn & F.col("doc_id").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text")
    marked = short.select("doc_id").distinct().join(marks, "doc_id")
    # Each task sends its first rows only, and at most 2 x each rows are broadcast.
    first = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    ids = first[0].unionByName(first[1])
    found = short.join(F.broadcast(ids.select("doc_id", "y")), "doc_id")
    return found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
