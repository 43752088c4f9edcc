"""Nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own k-means codebook, so that every vector
has a cell (u, v). A query visits cells by growing sum of its two distances to the centroids, taken
from a heap, until the visited cells hold a stated share of all vectors; their entries are ranked again by
the exact cosine in double precision. Equal vectors are one entry with its smallest ids, so a hot vector
costs no more than any other.

The codebooks are fitted on a bounded sample (``FIT_ROWS``); every vector is indexed. The ``BOOKS`` most
frequent lengths of vectors have codebooks of their own; vectors of other lengths share one cell for each
length, which is searched whole. A cell's entries and the queries that visit it are dealt to blocks of
bounded size, which meet in one task each.

Defined results: rows with a null id or a null, zero, non-finite or empty vector take no part; only
vectors of the query's length are candidates; rows that repeat an id each count, and a query leaves out
its own row only; fewer candidates than asked are returned all; ties go to the smaller id; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

QUERY_STEP = 50
TOP = 5
FIT_ROWS = 20_000
#: Share of all entries that a query's visited cells hold, at least; see the tests for the recall this gives.
SHARE = 0.75
#: And so many entries at least, all if there are fewer.
LEAST = 100
#: Lengths of vectors that have codebooks.
BOOKS = 8
#: Entries and queries that meet at once, about.
BLOCK_ROWS, QUERY_ROWS = 8_192, 4_096
LLOYD_ROUNDS = 12
#: Queries multiplied with a block, or planned, at once.
PART_ROWS = 256


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, d) of the rows that take part; d is the vector's length."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col(key).cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("d"))
    return some.filter(F.col("id").isNotNull() & (F.col("d") > 0) & F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from farthest-spread starts; the same result each time."""
    rng = np.random.default_rng(11)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(LLOYD_ROUNDS):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _unit(vecs) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
    # Scaling first keeps squares of very large and very small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def visit(du: np.ndarray, dv: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (u, v) by growing ``du[u] + dv[v]`` until they hold ``enough`` entries."""
    ou, ov = np.argsort(du, kind="stable"), np.argsort(dv, kind="stable")
    heap, seen, out, got = [(du[ou[0]] + dv[ov[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        u, v = int(ou[i]), int(ov[j])
        if counts[u, v]:
            out.append((u, v))
            got += int(counts[u, v])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(ou) and b < len(ov) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (du[ou[a]] + dv[ov[b]], a, b))
    return out


@dataclass
class Book:
    """The two codebooks of one length of vectors, and how many entries each cell holds."""

    u: np.ndarray
    v: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    @classmethod
    def fit(cls, x: np.ndarray, total: int) -> Book:
        half = x.shape[1] // 2
        k = int(min(len(x), np.clip(round((total / 64) ** 0.5), 4, 256)))
        return cls(kmeans(x[:, :half], k) if half else np.zeros((1, 0)), kmeans(x[:, half:], k))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of ``x`` to the centroids, less what is the same for all of them."""
        half = self.u.shape[1]
        return tuple((c * c).sum(1) - 2 * (h @ c.T) for h, c in ((x[:, :half], self.u), (x[:, half:], self.v)))


def _search(key, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"q": pd.Series(dtype="int64"), "e": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(entries) or not len(queries):
        return none
    order = np.lexsort((entries["e"], entries["id"]))
    x, cell, ids = _unit(entries["vec"])[order], entries["v"].to_numpy()[order], entries["e"].to_numpy()[order]
    # An entry stands for up to TOP + 1 ids, so TOP + 1 entries are enough.
    n, out = min(TOP + 1, len(ids)), []
    for at in range(0, len(queries), PART_ROWS):
        part = queries.iloc[at : at + PART_ROWS]
        score = _unit(part["vec"]) @ x.T
        for i, cells in enumerate(part["cells"]):
            score[i, ~np.isin(cell, cells)] = -np.inf
        least = np.partition(score, -n, axis=1)[:, -n]
        for q, row, t in zip(part["q"].tolist(), score, least.tolist(), strict=True):
            some = np.flatnonzero(row >= t)
            some = some[np.argsort(-row[some], kind="stable")][:n]  # entries stand by id
            out += [(q, ids[j], row[j]) for j in some if row[j] > -np.inf]
    return pd.DataFrame(out, columns=["q", "e", "score"]) if out else none


_PLACED = "e long, id long, vec array<double>, d int, u int, v int"
_ROUTED = "q long, vec array<double>, d int, u int, cells array<int>"


def _placing(books: dict[int, Book]):
    """A mapInPandas function that gives entries (e, id, vec, d) their cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                u = v = np.zeros(len(part), np.int64)
                if d in books:
                    u, v = (x.argmin(1) for x in books[d].distances(_unit(part["vec"])))
                yield part[["e", "id", "vec", "d"]].assign(u=u, v=v)

    return run


def _routing(books: dict[int, Book], share: float, least: int):
    """A mapInPandas function from queries (q, vec, d) to rows for each first half of their cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, same in pdf.groupby("d"):
                for at in range(0, len(same), PART_ROWS):
                    part, out = same.iloc[at : at + PART_ROWS], []
                    if d not in books:
                        out = [(q, vec, d, 0, [0]) for q, vec in zip(part["q"].tolist(), part["vec"], strict=True)]
                    else:
                        book = books[d]
                        enough = max(least, int(np.ceil(share * book.counts.sum())))
                        for q, vec, du, dv in zip(part["q"].tolist(), part["vec"], *book.distances(_unit(part["vec"])), strict=True):
                            by_u: dict[int, list[int]] = {}
                            for u, v in visit(du, dv, book.counts, enough):
                                by_u.setdefault(u, []).append(v)
                            out += [(q, vec, d, u, vs) for u, vs in by_u.items()]
                    yield pd.DataFrame(out, columns=["q", "vec", "d", "u", "cells"])

    return run


def _books(entries: DataFrame) -> dict[int, Book]:
    lengths = entries.groupBy("d").count().orderBy(F.desc("count"), "d").limit(BOOKS).collect()
    found = {}
    for d, total in lengths:
        sample = entries.filter(F.col("d") == d).orderBy(F.xxhash64("e"), "e").limit(FIT_ROWS).select("vec").toPandas()
        found[d] = Book.fit(_unit(sample["vec"]), total)
    return found


def nearest(rows: DataFrame, step: int = QUERY_STEP, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score of the TOP nearest found for every id divisible by ``step``."""
    spark = rows.sparkSession
    # Equal vectors are one entry. The window keeps its smallest ids, and does so before the shuffle too.
    some = store.keep(usable(rows).withColumn("h", F.xxhash64("vec")), "ann-rows")
    by = Window.partitionBy("h", "vec").orderBy("id")
    members = store.keep(some.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= TOP + 1), "ann-members")
    # An entry's number; more than one may have the id of its first row.
    entries = store.keep(members.filter("n = 1").select(F.monotonically_increasing_id().alias("e"), "id", "h", "vec", "d"), "ann-entries")
    books = _books(entries)
    if not books:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = store.keep(entries.select("e", "id", "vec", "d").mapInPandas(_placing(books), _PLACED), "ann-cells")
    for d, book in books.items():
        book.counts = np.zeros((len(book.u), len(book.v)), dtype=np.int64)
        for r in placed.filter(F.col("d") == d).groupBy("u", "v").count().collect():  # at most 256 x 256 rows
            book.counts[r["u"], r["v"]] = r["count"]

    # Each distinct query vector is searched once, under its entry's number.
    asked = some.filter(F.col("id") % step == 0).select("id", "h", "vec")
    asked = store.keep(asked.join(entries.select("h", "vec", "e"), ["h", "vec"]).select("id", "e"), "ann-asked")
    distinct = asked.select("e").distinct().join(placed.select("e", "vec", "d"), "e").select(F.col("e").alias("q"), "vec", "d")
    routed = store.keep(distinct.mapInPandas(_routing(books, share, least), _ROUTED), "ann-routed")
    # Entries and queries of each first half, and the number of blocks they take.
    sizes = placed.groupBy("d", "u").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("lefts"))
    sizes = sizes.join(routed.groupBy("d", "u").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("rights")), ["d", "u"])
    sizes = store.keep(sizes, "ann-sizes")
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = placed.join(sizes, ["d", "u"]).withColumn("l", spot("e", "lefts")).withColumn("r", every("rights")).select("d", "u", "l", "r", "e", "id", "v", "vec")
    sent = routed.join(sizes, ["d", "u"]).withColumn("r", spot("q", "rights")).withColumn("l", every("lefts")).select("d", "u", "l", "r", "q", "vec", "cells")
    meet = ("d", "u", "l", "r")
    found = dealt.groupBy(*meet).cogroup(sent.groupBy(*meet)).applyInPandas(_search, "q long, e long, score double")
    # The rows behind the best entries of a query, the best rows first.
    top = Window.partitionBy("q").orderBy(F.desc("score"), "first", "e")
    found = store.keep(found, "ann-found").join(entries.select("e", F.col("id").alias("first")), "e")
    found = store.keep(found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= TOP + 1).select("q", "e", "score"), "ann-best")
    ids = members.select("h", "vec", "id").join(entries.select("h", "vec", "e"), ["h", "vec"]).select("e", "id")
    named = found.join(ids, "e").select("q", "score", "e", "id")
    own = Window.partitionBy("q").orderBy(F.desc("score"), "id", "e")
    named = named.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= TOP + 1)
    listed = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score", "e"))).alias("all"))
    answers = asked.select("id", F.col("e").alias("q")).join(store.keep(listed, "ann-lists"), "q")
    # One place is the query's own row, or another with its id and vector.
    me = F.array_position(F.transform("all", lambda x: (x["e"] == F.col("q")) & (x["id"] == F.col("id"))), F.lit(True))
    others = F.filter("all", lambda x, i: i != me - 1)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, TOP)))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.score").alias("score"))
