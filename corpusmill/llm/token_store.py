"""Token ids in a byte-aligned binary file format, and the way back.

A token's id is its rank by corpus frequency, so frequent tokens have small numbers. Numbers are coded
in 1 to 4 bytes; the lengths of four numbers stand in one control byte, and all control bytes of a
block come before its data bytes, so that decoding is a table lookup on whole arrays.

File format (little-endian), a sequence of blocks, each followed by one line feed:
  magic ``TKB2``, then unsigned 64-bit: first token's place in the whole corpus, documents, tokens,
  control bytes, data bytes; then per document its doc_id (signed 64-bit) and its number of tokens
  (unsigned 64-bit, the highest bit set where the doc_id is null); then control bytes, then data bytes.
A folder holds the files and, beside them, the table ``ranks`` (rank, token, count).

Defined results: a null text counts as empty and has the end id alone; a null doc_id comes first;
repeated doc_ids follow each other in the order of the crc32 of their ids as 16-bit numbers; an empty table gives an
empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

END_ID = 2
#: In a document's number of tokens: its doc_id is null.
NO_ID = 1 << 63
MAGIC = b"TKB2"
HEAD = struct.Struct("<4s5Q")
#: A block closes once it holds this many tokens; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 18
#: Documents of this many tokens, about, are sorted by one task.
RANGE_TOKENS = 4_000_000
#: Ranges of doc_ids at most; beyond, a range grows, which Spark's sort spills, and files stay as small.
MOST_RANGES = 10_000
#: Blocks of a file at most.
FILE_BLOCKS = 64
#: Slots of a worker's table of pieces, as a power of 2; it starts anew when half full.
TABLE_BITS = 21
#: Bytes of text encoded together, and of the longest piece that is remembered.
GROUP_BYTES = 1 << 18
LONGEST_PIECE = 64
#: New pieces encoded in one text.
TOGETHER = 100
#: Marks that may follow a word.
_MARKS = ".,!?;:%$#&*"

#: White space other than space and line feed; such texts go to the tokenizer whole.
_OTHER_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　\x00]"


class PieceTable:
    """Token ids of pieces by two 64-bit hashes: an open-addressing table of arrays, looked up many keys at once."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.length = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
        self.ids, self.used, self.count = np.zeros(1 << 16, "<u2"), 0, 0

    def _slots(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those not there."""
        out = np.full(len(key), -1, np.int64)
        open_, step = np.arange(len(key)), 0
        while len(open_):
            s = self._slots(key[open_], step)
            there = self.key[s]
            hit = (there == key[open_]) & (self.check[s] == check[open_])
            out[open_[hit]] = s[hit]
            open_ = open_[~hit & (there != 0)]
            step += 1
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Keys must be distinct and not there yet. ``ids``: of all pieces, ``length`` of each."""
        start = self.used + np.cumsum(length) - length
        end = self.used + int(length.sum())
        if end > len(self.ids):
            grown = np.zeros(max(end, 2 * len(self.ids)), "<u2")
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : end] = ids
        self.used, self.count = end, self.count + len(length)
        open_, step = np.arange(len(key)), 0
        while len(open_):
            s = self._slots(key[open_], step)
            first = np.zeros(len(s), bool)
            first[np.unique(s, return_index=True)[1]] = True
            take = first & (self.key[s] == 0)
            mine, at = open_[take], s[take]
            self.key[at], self.check[at] = key[mine], check[mine]
            self.at[at], self.length[at] = start[mine], length[mine]
            open_ = open_[~take]
            step += 1


class PieceEncoder:
    """Encodes with the ``tokenizers`` library, remembering the ids of pieces seen before.

    A byte-level vocabulary cuts a text before any tokenizing wherever a space or line feed follows a
    character that is no white space, between a line feed and such a character after it, and between an
    ASCII letter or digit and a mark after it. So such pieces can be encoded one by one, each new one once. Pieces are told apart by two hashes of their
    bytes, for which long pieces are no matter: texts with one, with other white space, with runs of
    white space, with white space at the end, or with an added token are encoded whole.
    """

    def __init__(self, path: str):
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.glued = not any(" " in a for a in self.added)
        self.bytes = np.zeros(1 << 16, np.int64)  # that an id stands for: its characters, in a byte-level vocabulary
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.other_space = re.compile(_OTHER_SPACE)
        self.table = PieceTable()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many of them each has.

        Many pieces go in one text, some of them as a line, because a line feed and a space after any piece end it; a
        piece's ids are those that stand for its bytes. Time grows faster than a text, so a text has ``TOGETHER`` pieces.
        """
        if not pieces:
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        # A line feed and a NUL stand for themselves only, and hold a place here.
        alone = [b"x" if p in (b"\n", b"\0") else p for p in pieces]
        split = [b"" if not i % TOGETHER or (self.glued and p[0] == 32) else b"\n" for i, p in enumerate(alone)]
        lines = [a + p for a, p in zip(split, alone, strict=True)]
        texts = [b"".join(lines[i : i + TOGETHER]).decode("utf-8", "surrogatepass") for i in range(0, len(lines), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, dtype="<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        before = np.array([len(a) for a in split], dtype=np.int64)
        stop = np.cumsum([len(p) for p in lines])
        bound = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        first, last = np.searchsorted(bound, np.concatenate([[0], stop[:-1]]) + before), np.searchsorted(bound, stop)
        if (bound[last] != stop).any() or (bound[first] != stop - [len(p) for p in alone]).any():
            raise ValueError("ids must stand for the bytes of pieces")
        held = np.ones(len(ids), bool)
        held[first[before > 0] - 1] = False
        if b"\n" in pieces:
            ids[first[pieces.index(b"\n")]] = self.feed
        return ids[held], last - first

    def _odd(self, text: str) -> bool:
        """Whether a text must be encoded whole for its white space or an added token."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or any(a in text for a in self.added):
            return True
        # Other white space is not printable, which is quicker to tell.
        return not text.replace("\n", "").isprintable() and self.other_space.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as unsigned little-endian 16-bit numbers."""
        out: list = [None] * len(texts)
        whole, group, size = [], [], 0
        for i, t in enumerate(texts):
            if self._odd(t):
                whole.append(i)
                continue
            group.append((i, t.encode("utf-8", "surrogatepass")))
            size += len(group[-1][1])
            if size > GROUP_BYTES:
                self._group(group, out, whole)
                group, size = [], 0
        self._group(group, out, whole)
        for i, b in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = b
        return out

    def _group(self, group: list[tuple[int, bytes]], out: list, whole: list[int]) -> None:
        """Encode texts together; those with a long piece are added to ``whole``."""
        if not group:
            return
        raw = b"\0".join([t for _, t in group]) + b"\0"
        b = np.frombuffer(raw, np.uint8)
        kind = _KIND[b]
        cut = (kind >= 4) | (kind == 2)
        cut[1:] &= (kind[1:] != 2) | (kind[:-1] == 1)
        cut[1:] |= kind[:-1] >= 5
        cut[0] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(b))
        power, inverse = _powers(len(b) + 1)
        wide, hashes = b.astype(np.uint64) + np.uint64(1), []
        for p, q in zip(power, inverse, strict=True):
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(wide * p[: len(b)], out=total[1:])
            hashes.append(_mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64)))
        key, check = hashes[0] | np.uint64(1), hashes[1]  # 0 marks a free slot
        stop = np.flatnonzero(b[start] == 0)  # the NUL after each text
        longest = np.maximum.reduceat(end - start, np.concatenate([[0], stop[:-1] + 1]))
        table = self.table
        slot = table.find(key, check)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            _, first, same = np.unique(key[missing], return_index=True, return_inverse=True)
            if (check[missing] != check[missing][first][same]).any():  # two pieces of one hash
                whole.extend(i for i, _ in group)
                return
            new = missing[first]
            # Long pieces only fill a place here, as their texts are encoded whole.
            some = [raw[a:z] if z - a <= LONGEST_PIECE else b"x" for a, z in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            table.add(key[new], check[new], *self._pieces(some))
            slot[missing] = table.find(key[missing], check[missing])
        length = table.length[slot].astype(np.int64)
        length[stop] = 0
        upto = np.cumsum(length)
        place = np.arange(int(upto[-1])) + np.repeat(table.at[slot].astype(np.int64) - (upto - length), length)
        flat = table.ids[place].tobytes()
        ends = (2 * upto[stop]).tolist()
        for (i, _), a, z, n in zip(group, [0, *ends[:-1]], ends, longest.tolist(), strict=True):
            if n > LONGEST_PIECE:
                whole.append(i)
            else:
                out[i] = flat[a:z]
        if table.count > 1 << (table.bits - 1):
            table.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list[list[np.ndarray]] = []


def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the multipliers, and of their inverses, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        both = [m for m in _MULTIPLIERS], [pow(m, -1, 1 << 64) for m in _MULTIPLIERS]
        _POWERS[:] = [[np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, m, dtype=np.uint64))]) for m in ms] for ms in both]
    return _POWERS[0], _POWERS[1]


#: What a byte is: 1 letter or digit, 2 mark, 4 space, 5 NUL, 6 line feed, 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in _MARKS]] = 2
_KIND[32], _KIND[0], _KIND[10] = 4, 5, 6


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this process, which later tasks go on with."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


#: Documents encoded together.
ENCODED_ROWS = 512


@dataclass
class Ranges:
    """Consecutive numbers for ranges of (null first, doc_id, checksum of the ids).

    ``starts``: the doc_ids at which a range begins, after the first; ``parts``: of null doc_ids and then of
    each range, in how many parts of equal spans of checksums it is cut, which is more than one for nulls or
    a doc_id that many rows repeat.
    """

    starts: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, quantiles: list[int], nulls: int = 1) -> Ranges:
        often = Counter(quantiles)
        ends = [d + 1 for d, n in often.items() if n > 1 and d < (1 << 63) - 1]
        starts = sorted({*often, *ends})
        return cls(np.array(starts, dtype=np.int64), np.array([nulls, 1, *[often.get(d, 1) for d in starts]], dtype=np.int64))

    @property
    def count(self) -> int:
        return int(self.parts.sum())

    def number(self, known: np.ndarray, doc_ids: np.ndarray, ids: list[bytes]) -> np.ndarray:
        at = np.where(known, 1 + np.searchsorted(self.starts, doc_ids, "right"), 0)
        out = (np.cumsum(self.parts) - self.parts)[at]
        for i in np.flatnonzero(self.parts[at] > 1).tolist():
            out[i] += zlib.crc32(ids[i]) * int(self.parts[at[i]]) >> 32
        return out


def _encoder(path: str, name: str, ranges: Ranges):
    """A mapInPandas function adding ``ids`` (16-bit numbers with the end id), ``n`` and the number of the row's range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        end = np.array([END_ID], dtype="<u2").tobytes()
        for pdf in batches:
            for at in range(0, len(pdf), ENCODED_ROWS):
                part = pdf.iloc[at : at + ENCODED_ROWS]
                ids = [b + end for b in coder.encode([t or "" for t in part[name]])]
                bucket = ranges.number(part["known"].to_numpy(), part["doc_id"].to_numpy(), ids)
                yield pd.DataFrame({"known": part["known"], "doc_id": part["doc_id"], "bucket": bucket, "n": [len(b) // 2 for b in ids], "ids": ids})
        store.release()

    return run


def _forget() -> None:
    """Drop what encoding has left in this worker, for the steps after it; they need not collect garbage at each task."""
    if _ENCODERS or _POWERS:
        _ENCODERS.clear()
        _POWERS.clear()
        store.release()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _forget()
    total = np.zeros(1 << 16, dtype=np.int64)
    for pdf in batches:
        total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), "<u2"), minlength=1 << 16)
    held = np.flatnonzero(total)
    yield pd.DataFrame({"token": held, "count": total[held]})


# Control byte -> the four lengths it stands for.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers. The last group is filled up with zeros of one byte, left out of the data."""
    v = np.ascontiguousarray(values, dtype="<u4")
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    most = int(v.max()) if len(v) else 0
    for k in (8, 16, 24):
        if most >> k:
            padded[: len(v)] += v >= 1 << k
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << np.uint8(2) | four[:, 2] << np.uint8(4) | four[:, 3] << np.uint8(6)
    size = padded[: len(v)] + np.uint8(1)
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(start[-1]) + int(size[-1]) if len(v) else 0, dtype=np.uint8)
    data[start] = v.astype(np.uint8)
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        data[start[at] + k] = v[at] >> (8 * k) & 255
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers behind ``pack``'s bytes, by lookup of each control byte's lengths."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    start, raw = ends - size, np.frombuffer(data, np.uint8)
    if n and ends[-1] != len(raw):
        raise ValueError("damaged block")
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        at = np.flatnonzero(size > k) if k else slice(None)
        if k and not len(at):
            break
        out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(start: int, ids: list[int], counts: list[int], values: np.ndarray) -> bytes:
    control, data = pack(values)
    head = HEAD.pack(MAGIC, start, len(ids), len(values), len(control), len(data))
    return head + np.array(ids, "<i8").tobytes() + np.array(counts, "<u8").tobytes() + control + data


def read_blocks(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, doc_ids, counts with their marks of null doc_ids, values) of each block of a file."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        magic, start, docs, n, nc, nd = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a block")
        at += HEAD.size
        ids, counts = np.frombuffer(view[at : at + 8 * docs], "<i8"), np.frombuffer(view[at + 8 * docs : at + 16 * docs], "<u8")
        at += 16 * docs
        yield start, ids, counts, unpack(bytes(view[at : at + nc]), bytes(view[at + nc : at + nc + nd]), n)
        at += nc + nd + 1


def _writer(ranks: np.ndarray, starts: dict[int, int]):
    """A mapInPandas function from sorted rows to blocks. ``ranks``: by token; ``starts``: first place of each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        place, bucket, held = 0, None, 0
        ids: list[int] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            nonlocal held, place
            raw = write_block(place, ids, counts, np.concatenate(parts))
            place += held
            held = 0
            ids.clear(), counts.clear(), parts.clear()
            return pd.DataFrame({"block": [raw]})

        for pdf in batches:
            for known, doc, b, raw in zip(pdf["known"].tolist(), pdf["doc_id"].tolist(), pdf["bucket"].tolist(), pdf["ids"], strict=True):
                if b != bucket:
                    if ids:
                        yield block()
                    bucket, place = b, starts[b]
                values = ranks[np.frombuffer(raw, "<u2")]
                ids.append(doc)
                counts.append(len(values) if known else len(values) | NO_ID)
                parts.append(values)
                held += len(values)
                if held >= BLOCK_TOKENS:
                    yield block()
        if ids:
            yield block()

    return run


def _ranges(docs: DataFrame) -> Ranges:
    """Ranges of about RANGE_TOKENS, as far as MOST_RANGES allows."""
    length = F.octet_length("text")
    size, without = docs.agg(F.sum(length), F.sum(F.when(~F.col("known"), length))).first()
    most, nulls = (min(MOST_RANGES, 1 + (x or 0) // (3 * RANGE_TOKENS)) for x in (size, without))
    at = [i / most for i in range(1, most)]
    found = docs.filter("known").agg(F.percentile_approx("doc_id", at, 2 * MOST_RANGES)).first()[0] if at else None
    return Ranges.of([int(x) for x in found or []], nulls)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, text: str = "text") -> None:
    """Encode every text and write the folder ``path``. A file holds an ascending range of doc_ids."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    some = docs.select(key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("doc_id"), F.col(text).alias("text"))
    ranges = _ranges(some)
    coded = some.mapInPandas(_encoder(tokenizer, "text", ranges), "known boolean, doc_id long, bucket int, n long, ids binary")
    coded = store.keep(coded, "token-ids", "zstd")
    counts = coded.select("ids").mapInPandas(_count, "token int, count long").groupBy("token").agg(F.sum("count").alias("count"))
    counts = [(r["token"], r["count"]) for r in counts.collect()]  # at most one row per vocabulary entry
    counts.sort(key=lambda x: (-x[1], x[0]))
    ranks = np.zeros(1 << 16, dtype="<u4")
    ranks[[t for t, _ in counts]] = np.arange(len(counts))
    table = [(i, t, c) for i, (t, c) in enumerate(counts)]
    spark.createDataFrame(table, "rank int, token int, count long").coalesce(1).write.parquet(f"{path}/ranks")
    per = dict(sorted((r["bucket"], r["n"]) for r in coded.groupBy("bucket").agg(F.sum("n").alias("n")).collect()))
    starts = dict(zip(per, np.cumsum([0, *per.values()]).tolist(), strict=False))
    ordered = coded.repartitionById(ranges.count, "bucket").sortWithinPartitions("bucket", "known", "doc_id", F.crc32("ids"), "ids")
    blocks = ordered.mapInPandas(_writer(ranks, starts), "block binary")
    # The text sink writes a string's bytes as they are.
    sink = blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS)
    sink.text(f"{path}/blocks")
    store.discard(coded)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the folder: doc_id, start, n_tokens and ``ids``, its tokens as 32-bit little-endian numbers.

    ``digest``: instead of ``ids`` their checksum ``ids_crc32``.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("token").collect()  # bounded by the vocabulary
    tokens = np.array([r["token"] for r in ranks], dtype="<u4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        for pdf in batches:
            for raw in pdf["content"]:
                for start, ids, told, values in read_blocks(raw):
                    counts = told & ~np.uint64(NO_ID)
                    ends = np.cumsum(counts).astype(np.int64)
                    begins = ends - counts.astype(np.int64)
                    whole = tokens[values].tobytes()
                    each = [whole[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    content = {"ids_crc32": [zlib.crc32(x) for x in each]} if digest else {"ids": each}
                    yield pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").mask(told >= NO_ID), "start": start + begins, "n_tokens": counts.astype(np.int64), **content})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/blocks")
    return files.select("content").mapInPandas(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def token_report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the folder, read it back; per document doc_id, start, n_tokens and the checksum of its ids."""
    path = path or store.fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path, digest=True)


def checksum(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
