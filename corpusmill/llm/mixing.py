"""Mixing sources to target weights by hash thresholds.

Each document has a fixed 63-bit hash. A source that must give ``target`` words of its ``size`` repeats
every document ``floor(target / size)`` times and fills the rest with the documents whose hash lies
under a threshold. The threshold is found from histograms: words by source and hash bucket, then only
the boundary bucket is split again, until the boundary is a single hash. Budgets are nested by size: the
few large documents of a source are dealt with first, and smaller ones make up for their boundary.
Nothing is sorted and no document row reaches the driver.

Defined results: a null text has no words; a null source is a source of its own, last in order; rows
with equal doc_id and text share a hash and are taken or left together; an empty table gives no rows;
sources without words have target 0. The driver holds one row per source, which the weights name anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 63
LEVEL_BITS = 9
MOST_COPIES = 3
#: Nested fills of what a boundary document leaves open; they stop once all sources are this near.
FILLS, NEAR = 4, 0.0005
#: A table of sources up to this many rows is broadcast.
BROADCAST_SOURCES = 50_000

#: Large documents are dealt with first: those of more than a 4th of their source, then a 16th, and so on.
CLASSES = (4, 16, 64, 256)

_STATE = "src string, prefix long, budget long, least_h long, over long, most long"


def source_order(sources: Sequence[str | None]) -> list[str | None]:
    """Code point order, null last."""
    return sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)


def targets(sizes: dict[str | None, int], weights: Sequence[float], most: float = MOST_COPIES) -> dict[str | None, float]:
    """Share all words by weight; a target stops at ``most`` times its size, and the excess is shared again."""
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(source_order(list(sizes)))}
    out: dict[str | None, float] = {}
    left, still = float(sum(sizes.values())), set(weight)
    while still:
        whole = sum(weight[s] for s in still)
        share = {s: left * weight[s] / whole for s in still}
        over = [s for s in still if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            still.discard(s)
    return out


def _boundaries(words: DataFrame, state: dict) -> dict:
    """For each source of ``state`` (budget, least hash, size over, largest size): (threshold, what it leaves open, words of the rows at it).

    A threshold of None means that all eligible rows fit.
    """
    spark, done, bits = words.sparkSession, {}, 0
    open_ = {s: (0, *v) for s, v in state.items()}
    while open_:
        table = spark.createDataFrame([(s, *v) for s, v in open_.items()], _STATE)
        shift = HASH_BITS - bits
        joined = words.join(store.small(table, len(open_), BROADCAST_SOURCES), words["source"].eqNullSafe(table["src"]))
        joined = joined.filter((F.col("h") >= F.col("least_h")) & (F.col("size") <= F.col("most")) & (F.col("size") > F.col("over")))
        if bits:
            joined = joined.filter(F.shiftright("h", shift) == F.col("prefix"))
        bucket = F.shiftright("h", shift - LEVEL_BITS).alias("bucket")
        hist = joined.groupBy("src", bucket).agg(F.sum("size").alias("sum"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("budget").alias("budget"))
        by = Window.partitionBy("src").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("sum").over(by)).filter(F.col("upto") > F.col("budget"))
        first = hist.groupBy("src").agg(F.min(F.struct("bucket", "upto", "sum", "lo", "hi")).alias("b"))
        found = {r["src"]: r["b"] for r in first.collect()}
        for s, (_, budget, *rest) in list(open_.items()):
            if s not in found:
                done[s] = (None, budget, 0)
                del open_[s]
                continue
            b, left = found[s], budget - (found[s]["upto"] - found[s]["sum"])
            if b["lo"] == b["hi"]:
                done[s] = (b["lo"], left, b["sum"])
                del open_[s]
            else:
                open_[s] = (b["bucket"], left, *rest)
        bits += LEVEL_BITS
    return done


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with each row's words ``__size`` and hash ``__h``."""
    text = F.coalesce("text", F.lit(""))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", text, F.lit(7)), 1)
    return docs.withColumns({"__size": F.regexp_count(text, F.lit(WORD)).cast("long"), "__h": spread})


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h of every row; the plan: one row per source with its repeats and fills)."""
    spark = docs.sparkSession
    words = _sized(docs).select("doc_id", "source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    words = store.keep(words, "mix-words")
    sizes = {r["source"]: r["n"] for r in words.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    aim = targets(sizes, weights)
    whole = {s: min(MOST_COPIES, int(aim[s] // n)) if n else 0 for s, n in sizes.items()}
    open_ = {s: round(aim[s] - whole[s] * n) for s, n in sizes.items() if n and whole[s] < MOST_COPIES}
    fills: dict = {s: [] for s in sizes}  # (hash from, hash below, size over, largest size)
    bounds = {s: [*(n // c for c in CLASSES), 0] for s, n in sizes.items()}
    table = spark.createDataFrame([(s, b) for s, b in bounds.items()], "src string, bounds array<bigint>")
    number = F.size(F.filter("bounds", lambda b: F.col("size") <= b)).alias("k")
    classed = words.filter("size > 0").join(store.small(table, len(bounds), BROADCAST_SOURCES), words["source"].eqNullSafe(table["src"]))
    held: dict = {s: [0] * len(bounds[s]) for s in sizes}
    for r in classed.groupBy("src", number).agg(F.sum("size").alias("n")).collect():  # a few rows per source
        held[r["src"]][r["k"]] = r["n"]
    left = {s: budget for s, budget in open_.items() if budget > 0}
    after: dict = {}
    for k in range(len(CLASSES) + 1):
        # Each class gives its share of what is still open; a smaller class makes up for a larger one's boundary.
        state = {}
        for s, budget in left.items():
            if held[s][k] and budget > 0:
                top = bounds[s][k - 1] if k else sizes[s]
                state[s] = (round(budget * held[s][k] / sum(held[s][k:])), 0, bounds[s][k], top)
        for s, (below, open_words, at) in (_boundaries(words, state) if state else {}).items():
            budget, least, over, top = state[s]
            nearer = below is not None and at - open_words < open_words
            fills[s].append((least, below + nearer if below is not None else None, over, top))
            left[s] -= budget - open_words + at * nearer
            after[s] = (fills[s][-1][1], over)
    for _ in range(FILLS):
        # What is open still goes to documents of the last class that fit.
        state = {s: (left[s], b, over, left[s]) for s, (b, over) in after.items() if b is not None and left[s] > NEAR * aim[s] and left[s] > over}
        if not state:
            break
        after = {}
        for s, (below, open_words, _) in _boundaries(words, state).items():
            _, least, over, top = state[s]
            fills[s].append((least, below, over, top))
            left[s], after[s] = open_words, (below, over)
    plan = [(s, sizes[s], float(aim[s]), whole[s], fills[s]) for s in sizes]
    ddl = "src string, source_size long, target double, whole int, fills array<struct<a:bigint,b:bigint,over:bigint,m:bigint>>"
    return words, store.small(spark.createDataFrame(plan, ddl), len(plan), BROADCAST_SOURCES)


def _copies(h: str, size: str):
    """How often the plan beside a row takes it."""
    taken = F.exists("fills", lambda f: (F.col(h) >= f["a"]) & (f["b"].isNull() | (F.col(h) < f["b"])) & (F.col(size) > f["over"]) & (F.col(size) <= f["m"]))
    return F.col("whole") + F.when(taken, 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken."""
    words, plan = plan_mix(docs, weights)
    joined = words.join(plan, words["source"].eqNullSafe(plan["src"])).withColumn("copies", _copies("h", "size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken. The plan is small, so texts are not shuffled."""
    _, plan = plan_mix(docs, weights)
    # The row rides along whole, so that its columns may have any names.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = _sized(docs.select(row, "doc_id", "source", "text"))
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["src"])).withColumn("copies", _copies("__h", "__size"))
    rows = joined.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select("row.*")
