"""Text quality by a byte-level convolutional network in numpy.

Bytes have learned embeddings; learned filters see ``WIDTH`` bytes every ``STRIDE`` bytes. The document is
covered by overlapping chunks, each filter is max-pooled over a chunk, and the chunks' maxima are combined
(their mean and their maximum over the document) into one probability.

Fitted by Adam on a bounded sample: ``FIT_EACH`` documents of either label, each of at most ``FIT_CHARS``
characters. Scoring reads whole texts, long ones a segment at a time.

Defined results: null and empty texts are scored like zero bytes of padding; repeated rows each get a
row; a null doc_id is neither held out nor learned from; an empty table gives no rows; without labels of
both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .langid import fold

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 4, 24
#: Positions in a block; a chunk is four blocks, and the next chunk starts three blocks on.
BLOCK, CHUNK_BLOCKS, STEP_BLOCKS = 32, 4, 3
FIT_EACH, FIT_CHARS = 1500, 20_000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.004, 1e-4
#: Small samples are gone through more often, for so many steps at least.
LEAST_STEPS = 700
SEGMENT_BLOCKS = 4096
CUT = 0.7


@dataclass
class ByteNet:
    """``embed`` 256 x EMBED, ``filters`` WIDTH * EMBED x FILTERS, ``out`` 2 * FILTERS."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls) -> ByteNet:
        rng = np.random.default_rng(3)
        f = np.float32
        return cls(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS, f), np.zeros(1, f))

    def windows(self, b: np.ndarray) -> np.ndarray:
        """Embedded bytes as one row per position of the filters."""
        x = self.embed[b]
        n = (len(b) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * x.itemsize, x.itemsize))

    def block_maxima(self, raw: bytes) -> np.ndarray:
        """Filter maxima over blocks of positions, for any length of text."""
        step = BLOCK * STRIDE
        blocks = max(1, -(-len(raw) // step))
        b = np.zeros(blocks * step + WIDTH, np.uint8)
        b[: len(raw)] = np.frombuffer(raw, np.uint8)
        out = np.empty((blocks, FILTERS), np.float32)
        for at in range(0, blocks, SEGMENT_BLOCKS):
            end = min(blocks, at + SEGMENT_BLOCKS)
            z = self.windows(b[at * step : end * step + WIDTH - STRIDE]) @ self.filters
            out[at:end] = z[: (end - at) * BLOCK].reshape(end - at, BLOCK, FILTERS).max(axis=1)
        return out

    def features(self, raw: bytes) -> np.ndarray:
        chunks = np.maximum(over_chunks(self.block_maxima(raw)) + self.bias, 0)
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])

    def score(self, raw: bytes) -> float:
        return float(sigmoid(self.features(raw) @ self.out + self.shift[0]))


def sigmoid(z: float) -> float:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def chunk_starts(blocks: int) -> np.ndarray:
    """First block of each chunk; the last chunk ends with the document."""
    return np.arange(0, max(1, blocks - CHUNK_BLOCKS + STEP_BLOCKS), STEP_BLOCKS)


def over_chunks(maxima: np.ndarray) -> np.ndarray:
    start = chunk_starts(len(maxima))
    out = maxima[start]
    for k in range(1, CHUNK_BLOCKS):
        out = np.maximum(out, maxima[np.minimum(start + k, len(maxima) - 1)])
    return out


def _gradients(net: ByteNet, raw: bytes, y: int) -> list[np.ndarray]:
    step = BLOCK * STRIDE
    blocks = max(1, -(-len(raw) // step))
    b = np.zeros(blocks * step + WIDTH, np.uint8)
    b[: len(raw)] = np.frombuffer(raw, np.uint8)
    x = net.windows(b)[: blocks * BLOCK]
    z = (x @ net.filters).reshape(blocks, BLOCK, FILTERS)
    top, at = z.max(axis=1), z.argmax(axis=1) + np.arange(blocks)[:, None] * BLOCK
    start = chunk_starts(blocks)
    members = np.minimum(start[:, None] + np.arange(CHUNK_BLOCKS), blocks - 1)  # chunk x block
    pick = top[members].argmax(axis=1)
    from_block = np.take_along_axis(members, pick, axis=1)
    h = np.take_along_axis(top, from_block, axis=0)
    place = np.take_along_axis(at, from_block, axis=0)  # chunk x filter -> position
    a = np.maximum(h + net.bias, 0)
    mean, best = a.mean(axis=0), a.argmax(axis=0)
    feats = np.concatenate([mean, a.max(axis=0)])
    err = np.float32(sigmoid(feats @ net.out + net.shift[0]) - y)
    da = np.repeat((err * net.out[:FILTERS] / len(a))[None], len(a), axis=0)
    da[best, np.arange(FILTERS)] += err * net.out[FILTERS:]
    da = da * (a > 0)
    rows = x[place]  # chunk x filter x window
    dfilters = np.einsum("cf,cfw->wf", da, rows)
    dwin = (da[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
    dembed = np.zeros_like(net.embed)
    bytes_at = b[(place.reshape(-1) * STRIDE)[:, None] + np.arange(WIDTH)]
    np.add.at(dembed, bytes_at.reshape(-1), dwin.reshape(-1, EMBED))
    return [dembed, dfilters, da.sum(axis=0), err * feats, np.array([err], np.float32)]


def train(rows: list[tuple[bytes, int]]) -> ByteNet:
    net = ByteNet.fresh()
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        share = ones / len(rows) if rows else 0.5
        net.shift[0] = np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)
        return net
    names = ["embed", "filters", "bias", "out", "shift"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    rng, t = np.random.default_rng(4), 0
    a_round = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_round))
    rounds = epochs * a_round
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [_gradients(net, *rows[i]) for i in order[at : at + BATCH]]
            t += 1
            rate = RATE * (1 - 0.95 * t / rounds)
            for k, gs in zip(names, zip(*part, strict=True), strict=True):
                g = sum(gs) / len(gs) + DECAY * getattr(net, k)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> ByteNet:
    """Learn ``labels.quality`` from the rows of ``docs`` that ``learn`` selects."""
    got = sample(docs, labels, "quality", learn, FIT_EACH, FIT_CHARS).collect()
    rows = [(r["text"].encode("utf-8", "surrogatepass"), int(r["y"])) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]
    return train(rows)


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score of each whole text; no other column is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [net.score((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": got})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Three parts of four are learned from; all are scored."""
    net = fit(docs, labels, fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
