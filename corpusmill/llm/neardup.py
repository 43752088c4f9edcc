"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

The weighted Jaccard similarity of two documents is the sum of the smaller counts of their shingles
over the sum of the larger ones. A shingle of count ``w`` covers the levels 0 to w-1. The levels are cut
into dyadic blocks [0,1), [1,2), [2,4), ...; each block of each shingle has a Poisson process of a rate
equal to its width, seeded by shingle and block, whose points carry a uniform level and a component. A
point belongs to a document if its level lies under the count. A document's signature holds its first
point of each component; two signatures agree in a component with a probability equal to the weighted
Jaccard similarity. A block is followed only until its next point is later than all first points.

Signatures are banded; documents that share a band are candidates. Copies of one word sequence are one
node from the start. A node is first compared with the nodes of smallest doc_id of its bands. Where that
leaves a cluster of band-sharing nodes in more than one component, all nodes outside its largest one are
compared with all its nodes, dealt to chunks of bounded size. Every link is verified on the whole texts.
Classes are the components of the verified links.

Defined results: words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z
lower-cased; a text of one to four words is one shingle; texts without words (null, empty, symbols) are
alike only if equal; repeated rows are one class; class_id is the smallest doc_id of a class, null if it
has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Pairs whose signatures agree less reach SIMILAR with a chance under 1 in 2000.
AGREE = 0.68
#: Shingles and nodes compared with each other at once, on either side; a larger cluster has more chunks.
CHUNK, CHUNK_NODES = 64_000, 128
#: Shingles that more nodes of a chunk share are counted by matrix products.
DENSE = 24
BROADCAST_ROWS = 400_000
#: Bytes of text hashed at once.
SEGMENT = 1 << 18
#: Documents signed at once; their shingles are in memory together.
SIGNED_ROWS = 64

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_P), -1, 1 << 64))
_TABLE = np.zeros(256, dtype=bool)
_TABLE[48:58] = _TABLE[65:91] = _TABLE[97:123] = True
_TABLE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1024)
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, p, dtype=np.uint64))]) for p in (_P, _INV)]
    return _POWERS[0], _POWERS[1]


def _segment_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a buffer."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = _TABLE[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * power[: len(b)], out=total[1:])
    return start, mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of one text of any length, a segment at a time, cut where no word is cut."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and end > at + 1 and _TABLE[raw[end]] and _TABLE[raw[end - 1]]:
            end -= 1
        if end == at + 1:  # one word longer than a segment
            end = at + SEGMENT
            while end < len(raw) and _TABLE[raw[end]]:
                end += 1
        out.append(_segment_words(raw[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words in order."""
    out: list = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            offsets = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
            start, h = _segment_words(b"\0".join(texts[i] for i in group))
            cuts = np.searchsorted(start, offsets)
            for k, i in enumerate(group):
                out[i] = h[cuts[k] : cuts[k + 1]]
        group.clear()
        size = 0

    for i, t in enumerate(texts):
        if len(t) > SEGMENT // 2:
            out[i] = _long_words(t)
            continue
        if size + len(t) > SEGMENT:
            flush()
        group.append(i)
        size += len(t) + 1
    flush()
    return out


_STEPS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | _U(1)


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending, and their counts)."""
    n = len(words)
    if n == 0:
        return words, np.zeros(0, np.int64)
    k = min(n, SHINGLE)
    s = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        s += words[j : n - k + 1 + j] * _STEPS[j]
    return np.unique(mix64(s + _U(k)), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - both
    return both / whole if whole else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures as 64-bit numbers, one row per bag."""
    m, n = COMPONENTS, len(bags)
    first = np.full((n, m), np.inf)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in bags])
    item = np.concatenate([s for s, _ in bags]) if n else np.zeros(0, np.uint64)
    count = np.concatenate([c for _, c in bags]) if n else np.zeros(0, np.int64)
    # Dyadic blocks: number 0 is [0,1), number k > 0 is [2^(k-1), 2^k).
    parts = [(doc, item, np.zeros(len(doc), np.int64), count)]
    k = 1
    while True:
        deep = np.flatnonzero(count > (1 << (k - 1)))
        if not len(deep):
            break
        parts.append((doc[deep], item[deep], np.full(len(deep), k), count[deep]))
        k += 1
    d, x, block, w = (np.concatenate([p[i] for p in parts]) for i in range(4))
    width = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1).astype(np.float64)
    low = np.where(block > 0, width, 0.0)
    state = mix64(x + (block.astype(np.uint64) + _U(1)) * _P)
    t = np.zeros(len(d))
    flat = first.reshape(-1)
    while len(d):
        state = state + _P
        r = mix64(state)
        t = t - np.log(((r >> _U(11)).astype(np.float64) + 1.0) / 9007199254740993.0) / width
        r2 = mix64(r ^ _U(0xD1B54A32D192ED03))
        level = low + width * ((r2 >> _U(32)).astype(np.float64) / 4294967296.0)
        ok = level < w
        at = d * m + ((r2 & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)
        np.minimum.at(flat, at[ok], t[ok])
        alive = t < first.max(axis=1)[d]
        if not alive.all():
            d, state, t, width, low, w = d[alive], state[alive], t[alive], width[alive], low[alive], w[alive]
    return first.view(np.uint64)


_SIGNED = "doc_id long, rk binary, node binary, words boolean, bands array<long>, sig binary"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt = mix64(np.arange(COMPONENTS, dtype=np.uint64) + _U(77))
    for pdf in batches:
        for at in range(0, len(pdf), SIGNED_ROWS):
            part = pdf.iloc[at : at + SIGNED_ROWS]
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            words = word_hashes(raw)
            sig = mix64(signatures([bag(h) for h in words]) + salt)
            chain = np.zeros((len(raw), BANDS), dtype=np.uint64)
            grid = sig.reshape(len(raw), BANDS, ROWS)
            for j in range(ROWS):
                chain = mix64(chain * _P + grid[:, :, j])
            chain = mix64(chain + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            small = (sig >> _U(56)).astype(np.uint8)
            some = [len(h) > 0 for h in words]
            node = [hashlib.blake2b(h.tobytes() if k else b"raw" + r, digest_size=16).digest() for h, k, r in zip(words, some, raw, strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].astype("Int64"), "rk": part["rk"], "node": node, "words": some, "bands": [c if k else [] for c, k in zip(chain, some, strict=True)], "sig": [s.tobytes() for s in small],
                }
            )
    store.release()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict = {}  # the bag of the last partner, which often repeats

    def of(key: bytes, text: str) -> tuple:
        if key not in kept:
            if len(kept) > 8:
                kept.clear()
            kept[key] = bag(word_hashes([(text or "").encode("utf-8", "surrogatepass")])[0])
        return kept[key]

    for pdf in batches:
        good = [weighted_jaccard(bag(word_hashes([(x or "").encode("utf-8", "surrogatepass")])[0]), of(b, y)) >= SIMILAR - 1e-12 for x, b, y in zip(pdf["text_a"], pdf["b"].tolist(), pdf["text_b"], strict=True)]
        yield pdf.loc[good, ["a", "b"]]
    store.release()


def _agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, COMPONENTS) for s in (a, b))
    return (x == y).mean(axis=1)


def leveled(bag_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: a shingle of count w stands for w members, so that common members count the smaller multiplicities."""
    s, c = bag_
    level = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    return mix64(np.repeat(s, c) + level.astype(np.uint64) * _P)


def _leveled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), SIGNED_ROWS):
            part = pdf.iloc[at : at + SIGNED_ROWS]
            sets = [leveled(bag(h)) for h in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in part["text"]])]
            yield pd.DataFrame({"node": part["node"], "members": [m.tobytes() for m in sets], "size": [len(m) for m in sets]})


def _overlaps(lv: np.ndarray, lo: np.ndarray, n: int, rv: np.ndarray, ro: np.ndarray, m: int) -> np.ndarray:
    """How many members each of ``n`` sets (values lv, owners lo) has in common with each of ``m`` sets (rv ascending, ro).

    Members that many of the right have are counted by matrix products, rare ones pair by pair.
    """
    keys, which = np.unique(lv, return_inverse=True)
    begin = np.searchsorted(rv, keys, "left")
    often = np.searchsorted(rv, keys, "right") - begin
    both = np.zeros((n, m), np.float32)

    def spread(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``some``, place in rv) of every right carrier of these keys."""
        k = often[some]
        row = np.repeat(np.arange(len(some)), k)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[some], k)

    dense = np.flatnonzero(often > DENSE)
    for k in range(0, len(dense), 2048):
        some = dense[k : k + 2048]
        place = np.full(len(keys), -1)
        place[some] = np.arange(len(some))
        hit = place[which] >= 0
        a, b = np.zeros((n, len(some)), np.float32), np.zeros((len(some), m), np.float32)
        a[lo[hit], place[which[hit]]] = 1
        row, spot = spread(some)
        b[row, ro[spot]] = 1
        both += a @ b
    rare = np.flatnonzero((often[which] > 0) & (often[which] <= DENSE))
    for k in range(0, len(rare), 1 << 17):
        part = rare[k : k + (1 << 17)]
        row, spot = spread(which[part])
        np.add.at(both.reshape(-1), lo[part][row] * m + ro[spot], 1)
    return both


def _forest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs (a of ``left``, b of ``right``) that join different components, as many as it takes. All pairs are compared exactly."""
    out: list[tuple[bytes, bytes]] = []
    if len(left) and len(right):
        ln, rn, ls, rs = left["node"].tolist(), right["node"].tolist(), left["size"].to_numpy(), right["size"].to_numpy()
        lc, rc = left["label"].tolist(), right["label"].tolist()
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while up.get(x, x) != x:
                x = up[x]
            return x

        lv, rv = (np.frombuffer(b"".join(side["members"]), np.uint64) for side in (left, right))
        order = np.argsort(rv, kind="stable")
        both = _overlaps(lv, np.repeat(np.arange(len(left)), ls), len(left), rv[order], np.repeat(np.arange(len(right)), rs)[order], len(right))
        near = both >= SIMILAR * (ls[:, None] + rs[None, :] - both) - 1e-6
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = root(lc[i]), root(rc[j])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((ln[i], rn[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _texts(docs: DataFrame, ids: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """node and the whole text of its carrier, for each of ``nodes``."""
    need = store.keep(nodes.distinct().join(ids.select("node", "rk"), "node"), "dup-need")
    texts = docs.select(store.row_key("doc_id", "text").alias("rk"), "text")
    texts = texts.join(store.small(need, need.count(), BROADCAST_ROWS), "rk").select("node", "text")
    return store.keep(texts.dropDuplicates(["node"]) if repeats else texts, "dup-texts")


def _verified(docs: DataFrame, ids: DataFrame, pairs: DataFrame, repeats: bool) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts are similar."""
    texts = _texts(docs, ids, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), repeats)
    half = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    half = store.keep(half, "dup-texts-half")
    full = half.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    new = store.keep(full.select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a binary, b binary"), "dup-links")
    store.discard(texts)
    store.discard(half)
    return new


def _links(docs: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """Verified links (a, b) between nodes."""
    ids = nodes.filter("words").select("node", "rep", "rk", "sig", "bands")
    keyed = store.keep(ids.select("node", "rep", F.explode("bands").alias("key")), "dup-bands")
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "node")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = store.keep(shared.select("key", F.col("first.node").alias("pivot"), "n"), "dup-shared")
    crowded = store.keep(keyed.join(shared, "key").select("key", "node", "pivot", "n"), "dup-crowded")
    store.discard(keyed)
    sig = ids.select("node", "sig")

    # First round: each node and the best of its bands' heads.
    pairs = crowded.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = store.keep(pairs, "dup-half").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            agree = _agreement(pdf["sig_a"], pdf["sig_b"])
            yield pdf[["a", "b"]].assign(agree=agree)[agree >= AGREE]

    scored = pairs.select("a", "b", "sig_a", "sig_b").mapInPandas(agreement, "a binary, b binary, agree double")
    best = scored.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    tried = store.keep(best, "dup-candidates")
    links = _verified(docs, ids, tried, repeats)

    # Second round: clusters of nodes that bands connect, and of which the first round left more than one
    # component. All nodes outside a cluster's largest component meet all its nodes, in bounded chunks.
    clusters = components(crowded.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    labels = components(links)
    member = clusters.select("node", F.col("label").alias("cluster")).join(labels, "node", "left")
    member = store.keep(member.select("node", "cluster", F.coalesce("label", "node").alias("label")), "dup-members")
    parts = member.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    inside = store.keep(member.join(store.keep(mixed.select("cluster", "main"), "dup-mixed"), "cluster"), "dup-inside")
    if inside.isEmpty():
        return links
    texts = _texts(docs, ids, inside.select("node"), repeats)
    sets = store.keep(texts.mapInPandas(_leveled, "node binary, members binary, size long"), "dup-sets")
    store.discard(texts)
    full = store.keep(inside.join(sets, "node"), "dup-full")
    apart = F.col("label") != F.col("main")
    chunks = lambda of: F.ceil(F.greatest(F.sum(F.when(of, F.col("size"))) / CHUNK, F.count_if(of) / CHUNK_NODES)).cast("int")
    share = full.groupBy("cluster").agg(chunks(F.lit(True)).alias("rights"), chunks(apart).alias("lefts"))
    full = full.join(store.keep(share, "dup-share"), "cluster")
    spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ("cluster", "l", "r", "node", "label", "members", "size")
    left = full.filter(apart).withColumn("l", spot(F.col("lefts"), 1)).withColumn("r", every(F.col("rights"))).select(*cols)
    right = full.withColumn("r", spot(F.col("rights"), 2)).withColumn("l", every(F.col("lefts"))).select(*cols)
    left, right = store.keep(left, "dup-left"), store.keep(right, "dup-right")
    met = left.groupBy("cluster", "l", "r").cogroup(right.groupBy("cluster", "l", "r")).applyInPandas(_forest, "a binary, b binary")
    return store.keep(links.union(met), "dup-links")


def classes(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, rk (row key), class_id (smallest doc_id) and class_rk (row key of the one that stays)."""
    rk = store.row_key("doc_id", "text")
    signed = store.keep(docs.select("doc_id", rk.alias("rk"), "text").mapInPandas(_sign, _SIGNED), "dup-signed")
    carrier = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk"))
    nodes = signed.groupBy("node").agg(carrier.alias("c"), F.first("words").alias("words"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = store.keep(nodes.select("node", F.col("c.doc_id").alias("rep"), F.col("c.rk").alias("rk"), "c", "words", "bands", "sig"), "dup-nodes")
    repeats = not signed.groupBy("rk").count().filter("count > 1").isEmpty()
    labels = components(_links(docs, nodes, repeats))
    known = nodes.select("node", "c").join(labels, "node", "left")
    known = store.keep(known.select("node", "c", F.coalesce("label", "node").alias("label")), "dup-labels")
    heads = store.keep(known.groupBy("label").agg(F.min("c").alias("head")), "dup-heads")
    placed = store.keep(known.join(heads, "label").select("node", F.col("head.doc_id").alias("class_id"), F.col("head.rk").alias("class_rk")), "dup-placed")
    return signed.select("doc_id", "rk", "node").join(placed, "node").select("doc_id", "rk", "class_id", "class_rk")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document with its class."""
    return classes(docs).select("doc_id", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays for each class: the one with the smallest doc_id."""
    found = store.keep(classes(docs), "dup-classes")
    rk = store.free_name(docs.columns, "rk")
    gone = store.keep(found.filter("rk != class_rk").select(F.col("rk").alias(rk)).distinct(), "dup-gone")
    left = docs.withColumn(rk, store.row_key("doc_id", "text")).join(store.small(gone, gone.count(), BROADCAST_ROWS), rk, "left_anti")
    if not found.groupBy("rk").count().filter("count > 1").isEmpty():
        # Rows that repeat an id and a text: the first in the order of their other columns as text.
        n = store.free_name([*docs.columns, rk], "n")
        other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
        order = Window.partitionBy(rk).orderBy(F.to_json(F.struct(*other)))
        left = left.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
