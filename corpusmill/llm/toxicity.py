"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel.

The kernel of two strings sums, over all sequences of four characters they share in order, ``DECAY`` to
the power of the characters each spans, spans up to ``SPAN``; it is normalised and raised to ``POWER``. A
string begins with a mark, so beginnings count more than inner parts, and inserted characters or gaps only
lower the kernel. A sentence is compared with a landmark through the part of it that is most alike: a word,
a run of single letters ("i d i o t"), or two neighbouring short words without their space ("id iot"). So a
sentence's kernel values do not fade with its length. Landmarks turn the kernel into a finite map
(Nyström), on which a linear machine with squared hinge loss is trained, one row per sentence.

Sentences inherit the label of their document: all do in the first round, and in later rounds a toxic
document stands by the sentence that scores highest (multiple instances), once as it is and once with
characters inserted in its worst word, while every sentence of a clean document is a counterexample. A
document's score is a logistic function of its three worst sentences and of its size.
Fitted on a bounded sample: ``FIT_EACH`` documents of either label, each of at most ``FIT_CHARS``
characters. Scoring reads every sentence of whole texts.

Defined results: null and empty texts and texts without words get the score of a sentence the kernel has
nothing in common with; repeated rows each get a row; a null doc_id is neither held out nor learned from;
an empty table gives no rows; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .labelled import sample
from .langid import fold

DECAY, SPAN, POWER = 0.6, 7, 1.5
#: Longer words are cut into overlapping pieces.
LONGEST, PIECE_STEP = 24, 12
FIT_EACH, FIT_CHARS = 2500, 8_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 56, 24
ROUNDS = 4
#: Neighbouring words of at most this many characters are read together, too.
SHORT = 3
#: Odds from which a beginning tells of toxic documents, before the machine does.
TELLING = 10
#: Characters put between those of a witness, one at a time, to train on disguised words too.
DISGUISE = "-.*x1"
RIDGE = 1e-3
#: Penalty of the curve's weights.
PRIOR = 0.3
#: Parts whose kernel values a worker remembers, a byte for each landmark.
REMEMBERED = 400_000
#: Parts compared with landmarks at once, and parts whose values are gathered at once.
BATCH, GATHERED = 1024, 65_536
CUT = 0.5

#: Sentences mapped, and rows of the machine taken, at once.
BLOCK = 4096
#: Documents scored at once, and their characters, about.
SCORED_ROWS, SCORED_CHARS = 512, 1 << 20

#: Symbols of the alphabet, and subsequences after hashing.
_ALPHABET, _KEY_BITS = 64, 20
_KEYS = 1 << _KEY_BITS
#: Of a subsequence, by its last character's place after the third; the four fill two bits.
_WEIGHTS = DECAY ** np.arange(SPAN - 3.0)
WORST = 3
_SENTENCE = re.compile(r"[.!?;:\n\r]+(?=\s|$)")
_SPACED = re.compile(r"(?:(?<=[\s\W_])|^)\w(?:[\s\W_]{1,3}\w(?!\w)){3,}")
_INNER = re.compile(r"[\W_]+")


_STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»“”„…–—"
_SINGLE = re.compile(r"[\s\W_]\w[\s\W_]{1,3}\w[\s\W_]{1,3}\w[\s\W_]")


def sentences(text: str) -> list[str]:
    """Pieces of a text that end in a full stop or a line break, lower-cased."""
    return [s for s in _SENTENCE.split(text.lower()) if s.strip()]


def parts(sentence: str) -> list[str]:
    """What the kernel reads of a lower-cased sentence: words, long ones in pieces, and what gaps have torn apart."""
    words = [w for w in (w.strip(_STRIP) for w in sentence.split()) if w]
    out = [w for w in words if len(w) <= LONGEST]
    if len(out) < len(words):
        out += [p for w in words if len(w) > LONGEST for p in pieces(w)]
    size = [len(w) <= SHORT for w in words]
    out += [words[i] + words[i + 1] for i in range(len(words) - 1) if size[i] and size[i + 1]]
    return out + spaced(sentence)


def spaced(sentence: str) -> list[str]:
    """Runs of single letters, without what is between them."""
    # Four single letters in a row are rare; a cheap mark must be there before the pattern is tried.
    if not _SINGLE.search(f" {sentence} "):
        return []
    return [p for m in _SPACED.finditer(sentence) for p in pieces(_INNER.sub("", m.group())) if p]


def pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + PIECE_STEP, PIECE_STEP)]


def _codes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words, each after a mark; number of its word)."""
    c = np.frombuffer("\0".join(["", *batch]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([1 + len(w) for w in batch], dtype=np.int64)
    small = np.where((c >= 97) & (c <= 122), c - 96, 28 + c % 36).astype(np.uint32)
    small[np.cumsum(length) - length] = 27
    return small, np.repeat(np.arange(len(batch)), length)


def subsequences(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), one row for each distinct subsequence of a word, in that order."""
    sym, word = _codes(batch)
    # Word, subsequence and span in one number, which sorts much quicker in 32 bits.
    kind = np.uint32 if len(batch) <= 1 << 10 else np.uint64
    rows = [np.zeros(0, kind)]
    for k in range(3, SPAN):
        at = np.flatnonzero(word[:-k] == word[k:])
        ends = (word[at].astype(kind) << kind(22)) | kind(k - 3)
        c = [sym[at + i] for i in range(k + 1)]
        for i, j in combinations(range(1, k), 2):
            whole = ((c[0] * _ALPHABET + c[i]) * _ALPHABET + c[j]) * _ALPHABET + c[k]
            rows.append(((whole * np.uint32(2654435761)) >> np.uint32(12)).astype(kind) << kind(2) | ends)
    both = np.concatenate(rows)
    both.sort()
    weight, both = _WEIGHTS[both & kind(3)], (both >> kind(2)).astype(np.int64)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return both[first] >> _KEY_BITS, both[first] & (_KEYS - 1), np.add.reduceat(weight, first) if len(first) else weight


@dataclass
class Landmarks:
    """Kernel values against a list of words."""

    names: list[str]
    row: np.ndarray = field(init=False)  # subsequence -> its row, -1 if no landmark has it
    start: np.ndarray = field(init=False)  # row -> its first place in the two lists below, which hold one entry
    mark: np.ndarray = field(init=False)  # for each landmark that has the subsequence: which,
    value: np.ndarray = field(init=False)  # and its weight there
    norm: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        owner, key, weight = subsequences(self.names)
        order = np.argsort(key, kind="stable")
        held, at = np.unique(key[order], return_index=True)
        self.row = np.full(_KEYS, -1, np.int32)
        self.row[held] = np.arange(len(held))
        self.start, self.mark, self.value = np.append(at, len(key)), owner[order], weight[order]
        self.norm = np.sqrt(np.maximum(np.bincount(owner, weights=weight**2, minlength=len(self.names)), 1e-12))

    def kernel(self, batch: list[str]) -> np.ndarray:
        owner, key, weight = subsequences(batch)
        own = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(batch)))
        row = self.row[key]
        met = np.flatnonzero(row >= 0)
        begin, size = self.start[row[met]], np.diff(self.start)[row[met]]
        at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        cell = np.repeat(owner[met] * len(self.names), size) + self.mark[at]
        both = np.bincount(cell, weights=np.repeat(weight[met], size) * self.value[at], minlength=len(batch) * len(self.names))
        out, some = np.zeros(len(both)), np.flatnonzero(both)
        out[some] = (both[some] / (own[some // len(self.names)] * self.norm[some % len(self.names)])) ** POWER
        return out.reshape(len(batch), len(self.names))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of numbers below 2^32, sorted."""
    both = a << 32 | b
    both.sort()
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]
    return both >> 32, both & 0xFFFFFFFF


class SentenceMap:
    """Kernel values of sentences against landmarks, each the largest of the sentence's parts, as bytes.

    Values of parts are remembered.
    """

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(landmarks.names)), np.uint8)
        self.any = np.zeros(0, bool)  # whether a row of the table is not all zeros
        self.used = 0

    def _remember(self, new: list[str]) -> None:
        if self.used + len(new) > len(self.table):
            size = max(2 * len(self.table), self.used + len(new), 1 << 14)
            self.any = np.concatenate([self.any, np.zeros(size - len(self.table), bool)])
            self.table = np.concatenate([self.table, np.zeros((size - len(self.table), self.table.shape[1]), np.uint8)])
        for i in range(0, len(new), BATCH):
            some = new[i : i + BATCH]
            self.table[self.used : self.used + len(some)] = np.rint(np.minimum(self.landmarks.kernel(some), 1) * 255)
            self.any[self.used : self.used + len(some)] = self.table[self.used : self.used + len(some)].any(axis=1)
            self.place.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)

    def _places(self, new: set[str]) -> dict[str, int]:
        """Places of all remembered parts, these among them."""
        if self.used > REMEMBERED:
            self.place.clear()
            self.used = 0
        self._remember(list(new.difference(self.place)))
        return self.place

    def _largest(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest values of runs of places, none empty; ``starts``: where each begins, and the end."""
        out = np.zeros((len(starts) - 1, self.table.shape[1]), np.uint8)
        k = 0
        while k < len(out):  # whole sentences, about GATHERED parts at once
            z = max(k + 1, int(np.searchsorted(starts, starts[k] + GATHERED, "right")) - 1)
            out[k:z] = np.maximum.reduceat(self.table[at[starts[k] : starts[z]]], starts[k:z] - starts[k], axis=0)
            k = z
        return out

    def values(self, bags: list[list[str]]) -> np.ndarray:
        """One row for each sentence, given its parts; a sentence without parts has zeros."""
        out = np.zeros((len(bags), self.table.shape[1]), np.uint8)
        place = self._places(set().union(*bags))
        full = [i for i, b in enumerate(bags) if b]
        at = np.array([place[p] for i in full for p in bags[i]], dtype=np.int64)
        out[full] = self._largest(at, np.cumsum([0, *[len(bags[i]) for i in full]]))
        return out

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
        """(``values`` of the ``parts`` of all ``sentences``, the sentences of each text, its distinct parts).

        Each distinct word of the texts is looked at once.
        """
        words: list[str] = []
        lengths: list[int] = []
        counts: list[int] = []
        torn: list[tuple[int, str]] = []  # sentence, and a part of it that is not a word's or two words'
        for t in texts:
            text, before = t.lower(), len(lengths)
            rare = _SINGLE.search(f" {text} ")
            for s in _SENTENCE.split(text):
                if found := s.split():
                    if rare:
                        torn += [(len(lengths), p) for p in spaced(s)]
                    words += found
                    lengths.append(len(found))
            counts.append(len(lengths) - before)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        del words
        bare = [w.strip(_STRIP) for w in number]
        size = np.array([len(w) for w in bare], dtype=np.int64)
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        at, sentence = at[size[at] > 0], sentence[size[at] > 0]
        long = size > LONGEST
        for i in np.flatnonzero(long[at]).tolist():
            torn += [(int(sentence[i]), p) for p in pieces(bare[at[i]])]
        short = size[at] <= SHORT
        two = np.flatnonzero(short[:-1] & short[1:] & (sentence[:-1] == sentence[1:]))
        pair, which = np.unique(at[two] << 32 | at[two + 1], return_inverse=True)
        joined = [bare[i] + bare[j] for i, j in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), strict=True)]
        kept = np.flatnonzero(~long & (size > 0)).tolist()
        place = self._places({*joined, *[bare[i] for i in kept], *[p for _, p in torn]})
        of_word = np.zeros(len(bare), np.int64)
        of_word[kept] = [place[bare[i]] for i in kept]
        of_pair = np.array([place[p] for p in joined], dtype=np.int64)
        usual = ~long[at]
        owner = np.concatenate([sentence[usual], sentence[two], np.array([i for i, _ in torn], dtype=np.int64)])
        parts_at = np.concatenate([of_word[at[usual]], of_pair[which], np.array([place[p] for _, p in torn], dtype=np.int64)])
        text_of = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(_distinct(text_of[owner], parts_at)[0], minlength=len(texts)).tolist()
        # Parts that have nothing in common with any landmark change no largest value.
        some = self.any[parts_at]
        owner, parts_at = _distinct(owner[some], parts_at[some])
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        out = np.zeros((len(lengths), self.table.shape[1]), np.uint8)
        out[owner[begin]] = self._largest(parts_at, np.append(begin, len(owner)))
        return out, counts, sizes


@dataclass
class ToxicityModel:
    landmarks: Landmarks | None
    weights: np.ndarray  # of kernel values: the Nyström map and the machine in one
    bias: float
    curve: np.ndarray  # of the WORST margins, the logarithm of the number of distinct parts, and 1

    def scorer(self):
        """A function from texts to probabilities that remembers parts of sentences."""
        if self.landmarks is None:
            return lambda texts: [0.0] * len(texts)
        of = SentenceMap(self.landmarks)
        weights = (self.weights / 255).astype(np.float32)

        def some(texts: list[str]) -> list[float]:
            values, counts, sizes = of.documents(texts)
            margin = values.astype(np.float32) @ weights + self.bias
            ends = np.cumsum([0, *counts]).tolist()
            rows = np.stack([document_features(margin[a:z], n, self.bias) for a, z, n in zip(ends, ends[1:], sizes)])
            return (1 / (1 + np.exp(-np.clip(rows @ self.curve, -40, 40)))).tolist()

        def run(texts: list[str | None]) -> list[float]:
            out: list[float] = []
            group, size = [], 0
            for t in texts:
                group.append(t or "")
                size += len(group[-1])
                if size >= SCORED_CHARS:
                    out += some(group)
                    group, size = [], 0
            return out + some(group) if group else out

        return run


def squared_hinge(groups: list[tuple[np.ndarray, float, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine, by Newton steps on its active rows.

    ``groups``: rows, their sign, and the cost of each; rows are taken a block at a time.
    """
    blocks = [(z[i : i + BLOCK], sign, cost) for z, sign, cost in groups for i in range(0, len(z), BLOCK)]
    n = blocks[0][0].shape[1]
    w, ridge = np.zeros(n + 1), np.full(n + 1, RIDGE)
    ridge[-1] = RIDGE / 100
    before: list[np.ndarray] = []
    for _ in range(25):
        active = [np.ones(len(z), bool) if not before else sign * (z @ w[:-1] + w[-1]) < 1 for z, sign, _ in blocks]
        if before and all((a == b).all() for a, b in zip(active, before, strict=True)):
            break
        before, h, g = active, np.diag(ridge), np.zeros(n + 1)
        for (z, sign, cost), a in zip(blocks, active, strict=True):
            x = np.hstack([z[a].astype(np.float64), np.ones((int(a.sum()), 1))])
            h += cost * (x.T @ x)
            g += cost * sign * x.sum(axis=0)
        w = np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def document_features(values: np.ndarray, size: int, bias: float) -> np.ndarray:
    """Of a document with these margins of its sentences, which have ``size`` distinct parts."""
    out = np.full(WORST + 2, max(-1.0, bias))
    top = np.sort(values)[::-1][:WORST]
    out[: len(top)] = np.maximum(top, -1.0)
    out[WORST], out[WORST + 1] = np.log1p(size), 1.0
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's steps on the log loss with softened targets and a small ridge."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, w = np.where(y > 0, hi, lo), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * PRIOR
        step = np.linalg.solve(h, x.T @ (p - t) + PRIOR * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _landmarks(bags: list[set[str]], y: np.ndarray) -> Landmarks:
    """Parts of toxic documents whose beginnings tell of them, spread out, and some parts of clean ones."""
    toxic, clean = Counter(), Counter()
    # A part is worth as much as its most telling beginning, which gathers parts rare on their own.
    for b, k in zip(bags, y, strict=True):
        (toxic if k else clean).update(b)
    # Beginnings that two toxic documents have; a longer one can only be where the shorter one is.
    heads_t: dict[str, int] = {}
    for n in range(3, 13):
        heads = Counter(h for b, k in zip(bags, y, strict=True) if k for h in {w[:n] for w in b if len(w) >= n and (n == 3 or w[: n - 1] in heads_t)})
        heads_t.update((h, m) for h, m in heads.items() if m > 1)
    heads_c = Counter(h for b, k in zip(bags, y, strict=True) if not k for h in {w[:n] for w in b for n in range(3, min(len(w), 12) + 1) if w[:n] in heads_t})
    n_toxic, n_clean = int(y.sum()), int((1 - y).sum())

    def telling(h: str) -> float:
        odds = heads_t[h] / n_toxic / ((heads_c[h] + 0.5) / n_clean)
        return heads_t[h] * np.log(odds) if odds >= TELLING else 0.0

    known = {h: telling(h) for h in heads_t}
    value_of = {w: max(known.get(w[:n], 0.0) for n in range(3, min(len(w), 12) + 1)) for w in toxic if len(w) >= 3}
    able = sorted((w for w, v in value_of.items() if v > 0), key=lambda w: (-value_of[w], -toxic[w], w))[:600]
    able = able or sorted(value_of)[:TOXIC_LANDMARKS] or sorted(toxic)[:TOXIC_LANDMARKS]
    # The most telling part first, then those least like the ones chosen.
    marks: list[str] = []
    near, value = np.zeros(len(able)), np.array([value_of.get(w, 0.0) for w in able])
    while able and len(marks) < min(TOXIC_LANDMARKS, len(able)):
        i = int(np.argmax(np.log1p(value) * (1.02 - near)))
        marks.append(able[i])
        near = np.maximum(near, Landmarks([able[i]]).kernel(able)[:, 0])
        near[i] = 1.02
    common = sorted(w for w in clean if 3 <= len(w) <= LONGEST)
    marks += [common[i] for i in np.random.default_rng(9).permutation(len(common))[:CLEAN_LANDMARKS]]
    return Landmarks(marks)


def disguised(part: str, turn: int) -> str:
    """A part with a mark inserted, at a place and of a kind that change with ``turn``."""
    i = 1 + turn % (len(part) - 1)
    return part[:i] + DISGUISE[turn % len(DISGUISE)] + part[i:]


def train(texts: list[str], y: np.ndarray) -> ToxicityModel:
    """``texts`` and the label of each."""
    once: dict[str, str] = {}  # one object for each distinct part
    docs = [[[once.setdefault(p, p) for p in parts(s)] for s in sentences(t)] for t in texts]
    del once
    found = [set().union(*d) for d in docs]
    if not len(y) or y.min() == y.max() or not any(found):
        return ToxicityModel(None, np.zeros(0), 0.0, np.zeros(WORST + 2))
    landmarks = _landmarks(found, y)
    of = SentenceMap(landmarks)
    rows = [b for d in docs for b in d]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    # Nyström: features are kernel values times the inverse root of the landmarks' own kernel matrix.
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.names).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    mapped = lambda v: (v.astype(np.float32) / np.float32(255)) @ root.astype(np.float32)
    z = np.concatenate([mapped(of.values(rows[i : i + BLOCK])) for i in range(0, len(rows), BLOCK)])
    toxic = y[doc] > 0
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    witness, masked = np.flatnonzero(toxic), np.zeros((0, z.shape[1]), np.float32)  # at first all sentences of toxic documents
    against = z[~toxic]
    for _ in range(ROUNDS):
        if not len(witness) or not len(against):
            return ToxicityModel(None, np.zeros(0), 0.0, np.zeros(WORST + 2))
        scale = (len(witness) + len(masked) + len(against)) / 4
        w, bias = squared_hinge([(z[witness], 1.0, scale / len(witness)), (masked, 1.0, scale / max(1, 2 * len(masked))), (against, -1.0, 3 * scale / len(against))])
        margin = z @ w + bias
        # The worst sentence of each document, and of toxic documents those that are not like clean ones.
        worst = np.lexsort((-margin, doc))[first]
        witness = worst[toxic[worst] & (margin[worst] > -0.5)]
        weights, hidden = root @ w / 255, {}
        for turn, i in enumerate(witness.tolist()):
            alone = of.values([[p] for p in rows[i]]).astype(np.float64) @ weights
            k = int(alone.argmax())
            if 4 <= len(rows[i][k]) < LONGEST:
                hidden[i] = [*rows[i][:k], disguised(rows[i][k], turn), *rows[i][k + 1 :]]
        masked = mapped(of.values(list(hidden.values())))
    # The curve sees toxic documents with their worst sentence disguised, too.
    bounds = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
    sizes = [len(f) for f in found]
    seen = [document_features(margin[a:b], n, bias) for a, b, n in zip(bounds, bounds[1:], sizes)]
    for i, value in zip(hidden, (masked @ w + bias).tolist(), strict=True):
        a, b = bounds[doc[i]], bounds[doc[i] + 1]
        seen.append(document_features(np.concatenate([margin[a:i], [value], margin[i + 1 : b]]), sizes[doc[i]], bias))
    curve = logistic(np.stack(seen), np.concatenate([y, np.ones(len(hidden))]).astype(float))
    return ToxicityModel(landmarks, root @ w, bias, curve)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> ToxicityModel:
    """Learn ``labels.toxic`` from the rows of ``docs`` that ``learn`` selects. Sentences inherit their document's label."""
    got = sorted(sample(docs, labels, "toxic", learn, FIT_EACH, FIT_CHARS).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], np.array([r["y"] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of each whole text; no other column is looked at."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for pdf in batches:
            for at in range(0, len(pdf), SCORED_ROWS):
                part = pdf.iloc[at : at + SCORED_ROWS]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": of(part["text"].tolist())})
        store.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Four parts of five are learned from; all are scored."""
    model = fit(docs, labels, fold(5) != 0)
    held = F.coalesce(fold(5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept."""
    model = fit(docs, labels, fold(5) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                keep = np.array(of(part.column("text").to_pylist())) < CUT
                yield part.filter(pa.array(keep, pa.bool_()))
        store.release()

    return docs.mapInArrow(run, docs.schema)
