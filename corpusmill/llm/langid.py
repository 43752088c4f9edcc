"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and every other character than a letter becomes a space; n-grams of one to three
characters are hashed to ``FEATURES`` columns. Document frequencies come from all documents of the
learning fold. The weights are fitted by follow-the-regularised-leader with elastic-net penalties on a
bounded sample (about ``FIT_DOCS`` documents, never more than twice that, shared out evenly among languages), and the temperature of the
softmax is then set on a part of the sample that the weights have not seen.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows without lang are not
learned from but predicted; a null doc_id is neither held out nor learned from; repeated rows each get a
row; an empty table gives no rows; with nothing to learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14
FIT_DOCS = 3000
HASHES = 1_000_003
#: Sample documents with more characters are read in full for frequencies but not used to fit weights.
FIT_CHARS = 100_000
EPOCHS = 4
#: FTRL: learning rate, its smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SEGMENT = 1 << 20
UNKNOWN = "und"
#: Documents predicted at once.
SCORED_ROWS = 512

_LETTER: list[np.ndarray] = []


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams, None if the text has no letter. Long texts go a segment at a time."""
    total, some = None, False
    for at in range(0, len(text), SEGMENT):
        piece = text[max(0, at - 2) : at + SEGMENT].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        some = some or bool(letter.any())
        c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint32)
        h1 = c * np.uint32(2654435761)
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:] * np.uint32(374761393)
        shift = np.uint32(32 - 14)
        grams = np.concatenate([(h1 >> shift)[c > 0], (h2 >> shift)[(c[:-1] > 0) | (c[1:] > 0)], (h3 >> shift)[c[1:-1] > 0]])
        n = np.bincount(grams, minlength=FEATURES)
        total = n if total is None else total + n
    return total if some else None


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, docs = np.zeros(FEATURES, dtype=np.int64), 0
    for pdf in batches:
        for t in pdf["text"]:
            n = ngram_counts(t or "")
            if n is not None:
                df += n > 0
                docs += 1
    held = np.flatnonzero(df)
    yield pd.DataFrame({"feature": np.append(held, -1), "n": np.append(df[held], docs)})


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), 64):
            part = [ngram_counts(t or "") if self.languages else None for t in texts[at : at + 64]]
            known = [c for c in part if c is not None]
            p = iter(softmax((np.stack([self.vector(c) for c in known]) @ self.weights + self.bias) / self.temperature) if known else [])
            for c in part:
                row = None if c is None else next(p)
                names.append(UNKNOWN if row is None else self.languages[int(row.argmax())])
                scores.append(0.0 if row is None else float(min(1.0, row.max())))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from sparse rows (columns, values); most weights stay exactly 0."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.sign(z[at]) * L1 - z[at]
        w = free / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)  # the last column is the bias
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, learn: Column) -> LanguageModel:
    """Learn from the rows of ``docs`` (text, lang, doc_id) that ``learn`` selects."""
    rows = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counted = rows.select("text").mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = {r["feature"]: r["n"] for r in counted.collect()}  # at most FEATURES + 1 rows
    total = df.pop(-1, 0)
    idf = np.full(FEATURES, np.log(1 + total) + 1)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    idf = idf.astype(np.float32)
    short = rows.filter(F.length("text") <= FIT_CHARS).select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    model = LanguageModel(languages, idf, np.zeros((FEATURES, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0)
    if not languages:
        return model
    # Every language gives the documents under a hash threshold that leaves about its share of the sample.
    each = FIT_DOCS / len(languages)
    cuts = docs.sparkSession.createDataFrame([(name, int(HASHES * min(1.0, each / n))) for name, n in sizes.items()], "lang string, cut long")
    ids = short.join(F.broadcast(cuts), "lang").filter("h < cut").orderBy("h", "doc_id").limit(2 * FIT_DOCS)
    wanted = F.broadcast(ids.select("doc_id").distinct())

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, lang, ngram_counts(t or "")) for d, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True)]
            out = [(d, lang, np.flatnonzero(n).astype("<u2").tobytes(), n[n > 0].astype("<u4").tobytes()) for d, lang, n in out if n is not None]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "at", "n"])

    # Of rows that repeat a doc_id one counts, so at most 2 x FIT_DOCS are collected.
    some = rows.filter(F.length("text") <= FIT_CHARS).join(wanted, "doc_id", "left_semi")
    some = some.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")
    got = some.mapInPandas(sparse, "doc_id long, lang string, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["lang"], r["at"]))
    vectors = []
    for r in got:
        at, n = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")
        x = np.log1p(n) * idf[at]
        vectors.append((at, x / np.sqrt((x * x).sum())))
    y = np.array([languages.index(r["lang"]) for r in got], dtype=np.int64)
    held = np.arange(len(got)) % 5 == 4
    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    w, b = ftrl([vectors[i] for i in train], y[train], len(languages))
    logits = np.array([x @ w[at] + b for at, x in (vectors[i] for i in test)]).reshape(len(test), len(languages))
    model.weights, model.bias, model.temperature = w.astype(np.float32), b.astype(np.float32), calibrate(logits, y[test])
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, lang_pred and score of each text; no other column is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SCORED_ROWS):
                part = pdf.iloc[at : at + SCORED_ROWS]
                names, scores = model.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Two parts of three are learned from; all are predicted."""
    model = fit(docs, fold(3) != 1)
    return identify(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
