"""Tokens, neighbours, near-duplicates and the three classifiers."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import ann, components, labelled, langid, neardup, quality, store, token_store, toxicity
from corpusmill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, rk int, node int, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i, t, lang in rows], DOCS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_coding_round_trip(values):
    v = np.array(values, dtype="<u4")
    control, data = token_store.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert (token_store.unpack(control, data, len(v)) == v).all()


TEXTS = ["Hello, world! It's 3.5%...", "é,è. ñ?x 日本。 ½, a_b , .x", "", None, "  two  spaces\n\nand\ttab ", "<|endoftext|> a", "x " * 5000, "x " * 5000, "end\n"]


def fresh_ids(texts):
    """By a tokenizer loaded anew, with nothing set."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_equal_whole_texts():
    coder = token_store.PieceEncoder(tokenizer_path())
    for _ in range(2):
        assert coder.encode([t or "" for t in TEXTS]) == [np.array(x, "<u2").tobytes() for x in fresh_ids(TEXTS)]


def test_lines_share_pieces():
    """A line feed is a piece of its own, so the first word of a line is the one of a text."""
    coder = token_store.PieceEncoder(tokenizer_path())
    texts = ["bar", "Foo", "\nFoo bar", "a\n'sfoo", "\n.,x\n!", "Foo\x85bar", "Foo\u3000\n", "a\tb", "a\x00b", "\xa0\nFoo", "x<|endoftext|>y", "\u200bFoo\nbar", "\n"]
    assert coder.encode(texts) == [np.array(x, "<u2").tobytes() for x in fresh_ids(texts)]
    coder.table.clear()
    coder.encode(["Foo bar\nbar"])
    held = coder.table.count
    coder.encode(["bar\nFoo bar\nbar"])
    assert coder.table.count == held


def test_new_pieces_go_to_the_tokenizer_in_short_texts():
    """Its time grows faster than a text, and line feeds between pieces cost as much as pieces."""
    coder, seen = token_store.PieceEncoder(tokenizer_path()), []

    class Watched:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    tokenizer, coder.tokenizer = coder.tokenizer, Watched()
    text = " ".join(f"w{i}" for i in range(3000))
    assert coder.encode([text]) == [np.array(fresh_ids([text])[0], "<u2").tobytes()]
    assert max(len(t.split()) for t in seen) <= token_store.TOGETHER
    assert sum(t.count("\n") for t in seen) <= 2  # before the first word and the mark of a text's end


@pytest.mark.parametrize("together", [1, 2, 100])
@pytest.mark.parametrize("glued", [True, False])
def test_pieces_are_told_apart_by_their_bytes(monkeypatch, together, glued):
    monkeypatch.setattr(token_store, "TOGETHER", together)
    coder = token_store.PieceEncoder(tokenizer_path())
    assert coder.glued
    coder.glued = glued
    pieces = [" Foo", "Foo", "\n", " 日本é", ".5%", "...", " ll", "'ll", " 😀x", "\0", " 's", "é", " <|endof", "text|>"]
    ids, length = coder._pieces([p.encode() for p in pieces])
    want = fresh_ids(["x" if p == "\0" else p for p in pieces])
    assert ids.tolist() == [i for x in want for i in x] and length.tolist() == [len(x) for x in want]
    rng = np.random.default_rng(together)
    bits = [*"ab .,!?;:%$#&*\n-_'\"0<|é日😀", " the", "'ll", " <|endof", "text|>", "\x1c", "\x85", "\u200b", "\u3000", "\u180e", "\ufeff", "x" * 70]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)]
    assert coder.encode(texts) == [np.array(x, "<u2").tobytes() for x in fresh_ids(texts)]


def test_forgetting_costs_nothing_where_nothing_is_left(monkeypatch):
    calls = []
    token_store._forget()
    monkeypatch.setattr(store, "release", lambda: calls.append(1))
    token_store._forget()
    assert not calls
    token_store.encoder(tokenizer_path())
    token_store._forget()
    assert calls == [1] and not token_store._ENCODERS


def expected(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows (doc_id, text, ...), nulls first, repeated doc_ids by checksum."""
    coded = [(r[0], [*x, 2]) for r, x in zip(rows, fresh_ids([r[1] for r in rows]))]
    place, want = 0, []
    for i, x in sorted(coded, key=lambda c: (c[0] is not None, c[0] or 0, zlib.crc32(np.array(c[1], "<u2").tobytes()))):
        want.append((i, place, len(x), token_store.checksum(x)))
        place += len(x)
    return want


def test_tokens(spark):
    rows = [(10 - i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "null id", "en"), (3, TEXTS[7], "en"), (-(1 << 63), "least id", "en"), ((1 << 63) - 1, "largest id", "en")]
    path = store.fresh_path(spark, "t")
    got = token_store.token_report(docs(spark, rows), tokenizer_path(), path).collect()
    want = expected(rows)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    ids = token_store.read_tokens(spark, path).filter("doc_id = 10").first()
    assert zlib.crc32(bytes(ids["ids"])) == next(w[3] for w in want if w[0] == 10)
    assert token_store.token_report(docs(spark, []), tokenizer_path()).count() == 0


def test_sentences_are_what_toxicity_learns():
    rng = np.random.default_rng(1)
    some = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    said = lambda i, k: " ".join(some[(7 * i + 3 * k + j) % 200] for j in range(8))
    text = lambda i, *more: ". ".join([said(i, 0), said(i, 1), *more, said(i, 2)]) + "."
    toxic = [text(i, f"{said(i, 5)} vilgrub {said(i, 6)}" if i % 2 else "what a mogdar you are") for i in range(80)]
    clean = [text(i, said(i, 5), "what a day it is, you are here") for i in range(80)]
    y = np.array([1] * 80 + [0] * 80)
    of = toxicity.train(toxic + clean, y).scorer()
    share = lambda texts: np.mean(np.array(of(texts)) >= toxicity.CUT)
    assert share(toxic) > 0.95 and share(clean) < 0.05
    # The later pieces of long words are read, so clean ones that end like an insult are told apart.
    long = [text(i, f"{said(i, 5)} {''.join(some[(i + k) % 200] for k in range(5))}vilgrubber") for i in range(80)]
    of = toxicity.train(toxic + long, y).scorer()
    assert share(toxic) > 0.9 and share(long) < 0.1
    of = toxicity.train(toxic + clean, y).scorer()
    # Gaps, inserted characters, single letters and a torn word in one sentence among others.
    hidden = ["you vil-grub", "you vilg.rub", "v i l g r u b", "mog dar", "what a moxgdar", "Mogdar!!"]
    assert [float(of([text(9, h)])[0]) >= toxicity.CUT for h in hidden] == [True] * len(hidden)
    # Many clean sentences around it do not hide it, and order does not matter.
    assert share([" ".join([*clean[:40], "vilgrub.", *clean[40:60]])]) == 1
    assert share([". ".join(reversed(t.split(". "))) for t in toxic]) > 0.95


def test_sentence_values_are_the_largest_of_their_parts():
    lm = toxicity.Landmarks(["worthless", "pathetic", "idiot"])
    bags = [["worthless", "a", "idiom"], [], ["patheti"], ["zz"]]
    got = toxicity.SentenceMap(lm).values(bags)
    for b, row in zip(bags, got, strict=True):
        want = lm.kernel(b).max(axis=0) if b else np.zeros(3)
        assert np.abs(row / 255 - want).max() <= 1 / 255
    of = toxicity.SentenceMap(lm)
    many = [[f"w{i}", f"x{i % 7}", "idiot"[: 2 + i % 4]] for i in range(3000)]
    whole = of.values(many)
    of.used = toxicity.REMEMBERED + 1  # forgets, and goes on
    assert (of.values(many[1000:]) == whole[1000:]).all()


def test_documents_are_read_as_their_sentences_and_parts():
    rng = np.random.default_rng(4)
    bits = [*"ab .!?\n-_'\"\0\x1f", " the", ". ", "idiot", "worthless ", "a b c d e", " i d i o t ", "x" * 30, "\r\n", "É", "İ", "日本"]
    texts = ["", " ", "...", "- - -", *["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(600)]]
    lm = toxicity.Landmarks(["worthless", "thereis", "idiot"])
    bags = [[toxicity.parts(s) for s in toxicity.sentences(t)] for t in texts]
    values, counts, sizes = toxicity.SentenceMap(lm).documents(texts)
    assert counts == [len(d) for d in bags] and sizes == [len(set().union(*d)) for d in bags]
    assert (values == toxicity.SentenceMap(lm).values([b for d in bags for b in d])).all()
    assert [len(x) for x in toxicity.SentenceMap(lm).documents([])] == [0, 0, 0]
    # A text is scored alike alone and among others; a NUL inside a word is a character like any other.
    model = toxicity.ToxicityModel(lm, np.array([2.0, 1.0, 3.0]), -1.0, np.array([1.0, 0.2, 0.1, -0.1, 0.3]))
    whole = model.scorer()([*texts, None])
    assert whole == pytest.approx([model.scorer()([t])[0] for t in [*texts, None]], abs=1e-6)
    assert model.scorer()([]) == [] and lm.kernel(["wor\0thless", "idiot"])[1, 2] == pytest.approx(1)


def test_kernel_is_the_sum_over_shared_subsequences():
    def spans(word):  # of the first character of a word or its mark on, three more within SPAN
        s, out = "\x1b" + word, {}
        for i in range(len(s)):
            for c in itertools.combinations(range(i + 1, min(i + toxicity.SPAN, len(s))), 3):
                key = s[i] + "".join(s[k] for k in c)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c[-1] - i - 3)
        return out

    words = ["worthless", "wortless", "aaaaaa", "banana", "the", "", "anbana"]
    lm = toxicity.Landmarks(words[:4])
    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    of = [spans(w) for w in words]
    want = [[(dot(a, b) / max(1e-12, np.sqrt(dot(a, a) * dot(b, b)))) ** toxicity.POWER for b in of[:4]] for a in of]
    assert np.abs(lm.kernel(words) - np.array(want)).max() < 1e-6
    assert np.abs(lm.kernel(words * 400) - np.tile(want, (400, 1))).max() < 1e-6  # more than a block of 1,024


def test_samples_are_bounded_by_rows(spark):
    d = docs(spark, [(1 if i % 2 else 2 + i, f"text {i}", "en") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 3 % 2, 0, 5) for i in range(300)] + [(5, 0, 0, 5), (8, 1, 1, 5)], "doc_id long, toxic int, quality int, text int")
    got = labelled.sample(d, labels, "toxic", F.lit(True), 5, 100).collect()
    assert sorted(r.y for r in got) == [0] * 5 + [1] * 5 and len({r.doc_id for r in got}) == 10


def test_added_tokens_have_their_own_id(spark):
    rows = [(i, t, "en") for i, t in enumerate(["<|endoftext|> a", "plain", "one.<|endoftext|>two", "<|endoftext|><|endoftext|>", "<|endoftext| >", "ends<|endoftext|>"])]
    assert [50256 in x for x in fresh_ids([r[1] for r in rows])] == ["<|endoftext|>" in r[1] for r in rows]
    got = token_store.token_report(docs(spark, rows), tokenizer_path()).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_many_ranges_and_files(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_TOKENS", 100)
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(token_store, "FILE_BLOCKS", 2)
    # One doc_id and the null one hold many rows each.
    rows = [(i * 37 % 101 if i % 3 else 50 if i % 2 else None, f"text number {i} " * (i % 9), "en") for i in range(200)]
    path = store.fresh_path(spark, "t")
    got = token_store.token_report(docs(spark, rows), tokenizer_path(), path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks")
    blocks = [list(token_store.read_blocks(r.content)) for r in files.select("content").collect()]
    assert len(blocks) > 20 and max(map(len, blocks)) == 2


def test_ranges_cut_a_repeated_doc_id():
    ranges = token_store.Ranges.of([3, 7, 7, 7, 9])
    ids = [bytes([i]) for i in range(200)]
    same = ranges.number(np.ones(200, bool), np.full(200, 7), ids)
    assert set(same) == {3, 4, 5} and ranges.count == 8
    assert ranges.number(np.array([False, True, True, True, True]), np.array([0, 2, 3, 8, 9]), ids[:5]).tolist() == [0, 1, 2, 6, 7]


VECTORS = "vec_id long, embedding array<double>, v int, e int"


def brute(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [v / np.abs(v).max() for _, v in fine]
    unit = [v / np.linalg.norm(v) for v in unit]
    out = []
    for q, (i, v) in enumerate(fine):
        if i % 50 == 0:
            s = sorted((-(unit[q] @ unit[j]), o) for j, (o, w) in enumerate(fine) if j != q and len(w) == len(v))
            out += [(i, n, o, pytest.approx(-c, abs=1e-12)) for n, (c, o) in enumerate(s[:k], 1)]
    return sorted(out, key=lambda r: r[:3])


def test_neighbours_are_exact_where_all_cells_are_visited(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(150)]  # a hot vector, queries among its carriers
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [1.0]), (1050, []), (None, [1.0] * 8)]
    rows += [(7, rows[7][1]), (50, rows[50][1]), (50, rng.normal(size=8).tolist()), (1010, [1e300] + [0.0] * 7), (1011, [1e39] * 8)]
    rows += [(1100, [2.0, 1.0]), (1101, [1.0, 3.0]), (1150, [1.0] * 3)]  # rare lengths
    # Vectors that differ, but have one cosine with the query of id 2000.
    rows += [(2000, [1.0] + [0.0] * 8)] + [(2100 - i, [0.0, *np.eye(8)[i % 8].tolist()]) for i in range(8)]
    t = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in ann.nearest(t, least=1000).collect())
    assert got == brute(rows)
    assert ann.nearest(t.filter("vec_id in (0, 1)")).count() == 1
    assert ann.nearest(t.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], VECTORS)
    got = ann.nearest(t).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert hit / 600 >= 0.9


def test_cells_come_in_order():
    rng = np.random.default_rng(2)
    du, dv = rng.random(6), rng.random(5)
    cells = ann.visit(du, dv, np.ones((6, 5), int), 30)
    sums = [du[a] + dv[b] for a, b in cells]
    assert sums == sorted(sums) and len(set(cells)) == 30


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    err = []
    for _ in range(40):
        u = rng.integers(1, 1 << 63, 200).astype(np.uint64)
        a, b = (u[:160], rng.integers(1, 40, 160)), (u[40:], rng.integers(1, 40, 160))
        s = neardup.signatures([a, b])
        err.append((s[0] == s[1]).mean() - neardup.weighted_jaccard(a, b))
    assert abs(np.mean(err)) < 0.02


def bag(text):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter({("raw", text or ""): 1})


def near_classes(rows):
    bags, up = [bag(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * sum((bags[i] & bags[j]).values()) >= 8 * sum((bags[i] | bags[j]).values()):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return Counter((d, least[find(i)]) for i, (d, _, _) in enumerate(rows))


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 400, 300)]
    rows = [(i, " ".join(f"u{x}" for x in rng.integers(0, 900, 80)), "en") for i in range(60)]
    for i in range(60, 160):  # near copies, edited a little or more than the threshold allows
        w = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 14)):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w), "en"))
    rows += [(200, None, "en"), (201, "", "en"), (202, "!!", "en"), (203, "!!", "en"), (204, "One two", "en"), (205, "one, TWO", "en"), (5, rows[5][1], "en"), (206, "spam " * 4000, "en"), (207, "spam " * 3900, "en"), (208, "x" * 3_000_000, "en")]
    rows += [(300 + i, "five little words stand here"[: 28 - i % 3], "en") for i in range(9)]  # short texts
    monkeypatch.setattr(neardup, "CHUNK", 3000)
    monkeypatch.setattr(neardup, "CHUNK_NODES", 20)
    want = near_classes(rows)
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicate_report(docs(spark, rows)).collect())
    assert got == want
    kept = [r.doc_id for r in neardup.deduplicated(docs(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) == len({c for _, c in got})
    assert neardup.near_duplicate_report(docs(spark, [])).count() == 0


def test_long_texts_hash_alike():
    t = ("word " * 300_000 + "é" * 1000).encode()
    assert (neardup._long_words(t) == np.concatenate([neardup._segment_words(t[:1_500_000])[1], neardup._segment_words(t[1_500_000:])[1]])).all()


def test_components(spark):
    rng = np.random.default_rng(7)
    chain, star, tail = [(i, i + 1) for i in range(30)], [(500, i) for i in range(200, 240)], [(x, x + 1) for x in rng.permutation(np.arange(1000, 1060)).tolist()]
    links = spark.createDataFrame([*chain, *star, *tail, (100, 99), (100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 200 for i in [*range(200, 240), 500]} | {i: 1000 for i in range(1000, 1061)} | {99: 99, 100: 99}
    assert components.components(links.limit(0)).count() == 0


EMPTY = [(None, "some text", "en"), (1, None, "fr"), (2, "", "fr"), (3, "123 !?", "de"), (3, "123 !?", "de"), (4, "a" * 2_500_000, None)]


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_report(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = d.select("doc_id", "text", "lang").unionByName(docs(spark, EMPTY).withColumn("doc_id", F.col("doc_id") + 5000).select("doc_id", "text", "lang"))
    rows = langid.language_report(odd).filter("doc_id is null or doc_id >= 5000").collect()
    assert len(rows) == 6
    assert {r.lang_pred for r in rows if r.doc_id in (5001, 5002, 5003)} == {"und"}
    assert langid.language_report(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.language_report(docs(spark, [(1, "x", None)])).collect()} == {"und"}


def test_weights_are_sparse():
    rng = np.random.default_rng(5)
    rows = [(np.array([k, 100 + rng.integers(0, 50)]), np.array([1.0, 0.2])) for k in (0, 1) for _ in range(60)]
    w, _ = langid.ftrl(rows, np.array([0] * 60 + [1] * 60), 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w == 0).mean() > 0.9
    logits, y = np.array([[4.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)
    assert langid.calibrate(logits, y) > 2


def auc(y, s):
    order = np.argsort(np.argsort(s))
    y = np.array(y)
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("report", "label", "parts", "rest", "cut"), [(quality.quality_report, "quality", 4, 2, 0.7), (toxicity.toxicity_report, "toxic", 5, 0, 0.5)])
def test_classifiers(spark, report, label, parts, rest, cut):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = report(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    assert auc([r[label] for r in held], [r.score for r in held]) >= 0.93
    odd = docs(spark, EMPTY)
    few = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert report(odd, few).count() == 6
    assert report(odd, few.limit(0)).count() == 6
    assert report(odd.limit(0), few).count() == 0


def test_network_gradients():
    net = quality.ByteNet.fresh()
    rng = np.random.default_rng(6)
    net.out = rng.normal(0, 0.1, net.out.shape).astype(np.float32)
    raw = bytes(rng.integers(32, 127, 1500).tolist())
    g = quality._gradients(net, raw, 1)

    def loss():
        return -np.log(net.score(raw))

    for name, grad in zip(["filters", "out", "embed"], [g[1], g[3], g[0]], strict=True):
        w = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old, eps = w[at], np.float32(2e-3)
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grad[at], rel=0.15)


def test_chunks_cover_documents():
    for n in range(1, 40):
        start = quality.chunk_starts(n)
        covered = {b for s in start for b in range(s, s + quality.CHUNK_BLOCKS)}
        assert set(range(n)) <= covered and start[-1] < n


def test_kernel_tolerates_gaps():
    lm = toxicity.Landmarks(["worthless", "pathetic"])
    k = lm.kernel(["worthless", "wor-thless", "worthlesss", "patheti", "theation", "zz"])
    assert k[0, 0] == pytest.approx(1, abs=1e-5)
    assert k[1, 0] > 0.3 and k[2, 0] > 0.6 and k[3, 1] > 0.5
    assert k[4].max() < 0.2 and k[5].max() == 0
    assert set(toxicity.parts("say i d i o t, (moron)! mo ron")) >= {"idiot", "moron", "mo", "ron"}
    assert toxicity.pieces("a" * 60)[-1] and max(map(len, toxicity.pieces("a" * 60))) == toxicity.LONGEST
