"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is 13 consecutive words of a benchmark item (all its words if it has fewer). Windows and
documents are cut into three-word shingles. A first pass over the documents counts how often each shingle
of the benchmark occurs. A window must be contained whole, so one shingle of it is its necessary prefix:
the rarest. A second pass joins the documents' positions with prefixes only, drops starts that the
position and length bounds rule out, and compares the words from each start with the window's, in the
task that reads the document. Only hits are shuffled, and no words. A benchmark too large to be broadcast
is joined in blocks, each with passes of its own.

Defined results: a null or empty text has no words and is not contaminated; an item without words has
no windows; an item of one or two words is cut into shingles of that length; repeated document rows each
get a row; repeated items count once by item_id; a null item_id hits but is not listed; empty tables
give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WINDOW = 13
SHINGLE = 3
#: Word characters before lower-casing A-Z; the same runs as after it. Java looks a character up in a
#: table if a class lists its characters one by one, which is a tenth of the work of trying ranges.
WORDS = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a block of prefixes or shingles, about, which is broadcast (up to 300 bytes each); also of any other broadcast.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same, faster, where no other character has a lower case."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _key(s: int, at: Column) -> Column:
    """Join key of the shingle of ``s`` words at a position; null where it would pass the end."""
    return F.when(at + s <= F.size("words"), F.xxhash64(F.lit(s), *[F.get("words", at + i) for i in range(s)]))


def _positions(docs: DataFrame, lengths: list[int], path: str, text: str) -> DataFrame:
    """rk, words, pos, key: one row per position of a document and shingle length."""
    rows = docs.select(store.row_key(path, text).alias("rk"), words_of(F.col(text)).alias("words"))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("words"))))
    if len(lengths) == 1:
        rows = rows.withColumn("key", _key(lengths[0], F.col("pos")))
    else:
        rows = rows.withColumn("key", F.explode(F.array(*[_key(s, F.col("pos")) for s in lengths])))
    return rows.filter(F.col("key").isNotNull())


def _blocks(table: DataFrame) -> list[DataFrame]:
    """A kept table with a ``key`` in parts of about BROADCAST_ROWS rows."""
    n = -(-table.count() // BROADCAST_ROWS)
    return [table] if n < 2 else [table.filter(F.pmod(F.xxhash64("key", F.lit(n)), F.lit(n)) == i) for i in range(n)]


class BenchmarkWindows:
    """Distinct windows of a benchmark table (wid, span, words), and (wid, item) of the items that hold them."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text"):
        items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
        span = F.least(F.lit(WINDOW), F.size("words"))
        start = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("span")))
        cut = items.withColumn("span", span).withColumn("at", start)
        cut = store.keep(cut.select("item", F.slice("words", F.col("at") + 1, F.col("span")).alias("words")).distinct(), "bench-cut")
        distinct = cut.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), F.size("words").alias("span"), "words")
        self.windows = store.keep(distinct, "bench-windows")  # written out, so that the ids stay
        self.items = store.keep(cut.filter(F.col("item").isNotNull()).join(self.windows, "words").select("wid", "item"), "bench-items")
        self.lengths = [r["s"] for r in self.windows.select(F.least(F.lit(SHINGLE), "span").alias("s")).distinct().orderBy("s").collect()]

    def shingles(self) -> DataFrame:
        """wid, off, key of each shingle of each window."""
        cuts = [self.windows.filter(F.least(F.lit(SHINGLE), "span") == s).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("span") - s))).select("wid", "off", _key(s, F.col("off")).alias("key")) for s in self.lengths]
        return reduce(DataFrame.union, cuts)

    def prefixes(self, docs: DataFrame, path: str, text: str) -> DataFrame:
        """key, off, wid, span, window: of each window that may occur, its rarest shingle among ``docs``."""
        shingles = store.keep(self.shingles(), "bench-shingles")
        known = store.keep(shingles.select("key").distinct(), "bench-keys")
        each = [_positions(docs, self.lengths, path, text).select("key").join(F.broadcast(part), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")) for part in _blocks(known)]
        often = store.keep(reduce(DataFrame.union, each), "bench-often")
        # A window with a shingle that no document has can't occur.
        rare = shingles.join(often, "key").groupBy("wid").agg(F.min(F.struct("n", "off", "key")).alias("rare"), F.count(F.lit(1)).alias("have"))
        whole = F.col("have") == F.col("span") - F.least(F.lit(SHINGLE), "span") + 1
        fixed = self.windows.join(rare, "wid").filter(whole)
        return store.keep(fixed.select("rare.key", "rare.off", "wid", "span", F.col("words").alias("window")), "bench-prefixes")


def _hits(docs: DataFrame, bench: BenchmarkWindows, path: str, text: str) -> DataFrame:
    """rk, start, span, wid of every occurrence of a window."""
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("span") <= F.size("words"))
    found = []
    for part in _blocks(bench.prefixes(docs, path, text)):
        met = _positions(docs, bench.lengths, path, text).join(F.broadcast(part), "key").filter(fits)
        met = met.filter(F.slice("words", start + 1, F.col("span")) == F.col("window"))
        found.append(met.select("rk", start.alias("start"), "span", "wid"))
    return reduce(DataFrame.union, found)


def _covered(spans: Column) -> Column:
    """How many positions an array of (start, span) covers."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def step(a: Column, x: Column) -> Column:
        end = F.greatest(a["upto"], x["start"] + x["span"])
        return F.struct((a["n"] + end - F.greatest(a["upto"], F.least(x["start"], end))).alias("n"), end.alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, rk (its row key), n_words, n_hit and the sorted ids of items with occurring windows."""
    bench = BenchmarkWindows(benchmark)
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(path).alias("doc_id"), store.row_key(path, text).alias("rk"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("n_words"))
    if not bench.lengths:
        return rows.select("*", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    hits = _hits(docs, bench, path, text).groupBy("rk").agg(F.collect_set(F.struct("start", "span")).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids"))
    hits = hits.select("rk", _covered(F.col("spans")).alias("n_hit"), "wids", F.xxhash64("wids").alias("h"))
    hits = store.keep(hits, "bench-hits")
    # The items of each distinct set of windows, as many documents may hold the same.
    sets = hits.select("h", "wids").distinct()
    listed = sets.select("h", "wids", F.explode("wids").alias("wid")).join(bench.items, "wid").groupBy("h", "wids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = store.keep(listed, "bench-listed")
    per = hits.join(store.small(listed, listed.count(), BROADCAST_ROWS // 100), ["h", "wids"], "left").select("rk", "n_hit", "items")
    joined = rows.join(store.small(per, hits.count(), BROADCAST_ROWS // 100), "rk", "left")
    return joined.select("doc_id", "rk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated() -> Column:
    """The contract's rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The operator's rows as digests."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    rk = store.free_name(docs.columns, "rk")
    bad = contamination(docs, benchmark).filter(is_contaminated()).select(F.col("rk").alias(rk)).distinct()
    bad = store.keep(bad, "bench-bad")
    left = docs.withColumn(rk, store.row_key("doc_id", "text")).join(store.small(bad, bad.count(), BROADCAST_ROWS), rk, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
