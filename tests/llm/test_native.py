"""Secrets, decontamination, archives and mixing against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontam, mixing, secret_ledger, store, warc
from corpusmill.llm.secret_ledger import BlobLedger, Rule

# Clashing names: text tables may bring columns the operators use inside.
DOCS = "doc_id long, text string, source string, blob string, rk int, h int, key string, pos int, n int"


def docs(spark, *texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, sources[i] if sources else "s", "x", 1, 1, "k", 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


AWKWARD = [
    None, "", "password = token: abcdefgh", "Secret='abcdef' token=abc api_key: \"A1b2C3\"", "AKIA" + "A" * 16 + "AKIA", "é𝄞 token=" + "f" * 30, "0" * 24 + "g" + "a" * 23,
    "token=" + "deadbeef" * 4 + " AKIA" + "1" * 20, "no secrets", "token=abcdef " * 3000, "token=abcdef " * 3000,
]


def test_secrets(spark):
    rows = docs(spark, *AWKWARD)
    rows = rows.union(rows.filter("doc_id = 3"))
    got = secret_ledger.secret_report(rows, BlobLedger(spark, store.fresh_path(spark, "t"))).collect()
    assert len(got) == len(AWKWARD) + 1
    for r in got:
        want = spans(AWKWARD[r.doc_id])
        assert r.spans == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    assert secret_ledger.secret_report(rows.limit(0), BlobLedger(spark, store.fresh_path(spark, "t"))).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    path = store.fresh_path(spark, "t")
    first = docs(spark, "token=abcdef", "plain", "token=abcdef")
    ledger = BlobLedger(spark, path)
    assert secret_ledger.secret_report(first, ledger).filter("n_assign = 1").count() == 2
    assert ledger.seen().count() == 6  # two blobs under three rules
    again = BlobLedger(spark, path)
    assert again._unseen(again.seen().select("blob", F.lit(1).alias("at")).distinct()).count() == 0
    # An old version kept at a new path is found without a scan; a new rule is scanned for old blobs.
    moved = secret_ledger.secret_report(docs(spark, "token=abcdef", ids=[99]), again).first()
    assert (moved.doc_id, moved.n_assign) == (99, 1)
    # Every version a path ever had stays on record, once.
    secret_ledger.secret_report(docs(spark, "now plain", "plain"), again)
    secret_ledger.secret_report(docs(spark, "now plain", "plain"), again)
    assert again.versions().count() == 5
    assert sorted((r.path, r.start, r.end) for r in again.history().collect()) == [(0, 0, 12), (2, 0, 12), (99, 0, 12)]
    wider = BlobLedger(spark, path, (*secret_ledger.BASE_RULES, Rule("plain", "plain", 0, 1)))
    assert {r.doc_id: r.n_plain for r in secret_ledger.secret_report(first, wider).collect()} == {0: 0, 1: 1, 2: 0}
    assert wider.seen().count() == 11


def test_windows_in_blocks(spark, monkeypatch):
    rng_words = [f"w{i * 7919 % 97}" for i in range(400)]
    items = [(i, " ".join(rng_words[5 * i : 5 * i + 20])) for i in range(60)] + [(100, "w1 w2")]
    texts = [" ".join(rng_words[i : i + 3 + 11 * (i % 5)]) for i in range(0, 300, 6)]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 50)
    got = decontam.contamination_report(docs(spark, *texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = contaminated(texts, items)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and sum(w[4] for w in want.values()) > 10


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))


def contaminated(texts, items):
    windows: dict = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    ids |= windows[k]
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


LONG = " ".join(f"w{i % 17} x{i % 5}" for i in range(60))


def test_word_class(spark):
    """The class of the contract, in a form without ranges, which Java tries one by one for each character."""
    assert "-" not in decontam.WORDS
    chars = [*range(300), 0x2028, 0x3042, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(f"a{chr(c)}b{chr(c)}{chr(c)}",) for c in chars], "t string")
    contract = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    got = rows.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in (("a", decontam.WORDS), ("b", contract))]).collect()
    assert len(got) == len(chars) and all(r.a == r.b for r in got)


@pytest.mark.parametrize(
    "items",
    [
        [(1, LONG), (2, "Éa éb ÉC"), (10, "of the of the of the of the of the of the of the of the"), (3, None), (4, "..."), (2, "Éa éb ÉC")],
        [(1, "one"), (2, "two words"), (3, LONG)],
        [(5, None)],
    ],
)
def test_decontamination(spark, items):
    texts = [None, "", "ONE! two, words; one", LONG, LONG.upper() + " tail " * 40, " ".join(LONG.split()[3:20]), "of the " * 50, "éa Éb éC", "Éa éb ÉC Éa éb ÉC", "İstanbul Éa éb ÉC", " ".join(LONG.split()[:12]), "q " * 5000 + LONG]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rk", F.lit(1))
    got = decontam.contamination_report(docs(spark, *texts).union(docs(spark, *texts).filter("doc_id = 3")), bench).collect()
    want = contaminated(texts, items)
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    assert decontam.contamination_report(docs(spark), bench).count() == 0
    left = {r.doc_id for r in decontam.decontaminated(docs(spark, *texts), bench).collect()}
    assert left == {i for i, w in want.items() if not w[4]}


def test_archives(spark):
    big = "<p>ü</p>" * 20
    rows = [(5, "http://a.x/p?q=1", big), (2, "http://b.x", big), (9, None, big), (3, "http://c.x/ y", "short"), (4, "u", "short"), (6, "http://d.x/", None), (7, "http://e.x/", "a\r\n\r\nWARC/1.1\r\n" * 9), (2, "http://b.x", big), (None, "http://f.x/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))
    path = store.fresh_path(spark, "t")
    got = sorted((tuple(r) for r in warc.archive_report(pages, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        twin = len(raw) >= 100 and h == big and i != 2
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if twin else "response", 2 if twin else None))
    assert got == sorted(want, key=str)
    records = warc.read_records(spark, path, payloads=True).collect()
    assert sum(r.kind == "response" and bytes(r.payload) == big.encode() for r in records) == 2
    first = {r.record_id for r in records if r.kind == "response"}
    assert all(r.refers_to_record in first for r in records if r.kind == "revisit")
    assert len({r.record_id for r in records}) == len(records) == 3 * len(rows)
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_incomplete_transactions(spark):
    rows = [("response", "r1", None), ("metadata", "m1", "r1"), ("request", "q9", "gone")]
    recs = spark.createDataFrame(rows, "kind string, record_id string, concurrent_to string")
    got = warc.assemble(recs).collect()
    assert len(got) == 1 and got[0].request is None and got[0].metadata.record_id == "m1"


def test_revisits_are_found_by_record_id(spark):
    record = "struct<kind:string,page_id:long,payload_bytes:long,payload_digest:string,declared_digest:string,refers_to_record:string>"
    one = ("r1", ("response", None, 9, "aa", "aa", None), (None, 4, None, None, None, None))
    two = ("r2", ("revisit", None, None, None, "aa", "r1"), (None, 8, None, None, None, None))
    captures = lambda *rows: spark.createDataFrame(list(rows), f"capture string, response {record}, metadata {record}")
    got = sorted(map(tuple, warc.resolved(captures(one, two)).collect()))
    assert got == [(4, 9, "aa", "response", None), (8, 9, "aa", "revisit", 4)]
    wrong = ("r3", ("revisit", None, None, None, "bb", "r1"), (None, 9, None, None, None, None))
    lost = ("r4", ("revisit", None, None, None, "aa", "gone"), (None, 9, None, None, None, None))
    for bad, why in ((wrong, "declared digest differs"), (lost, "refers to no record")):
        with pytest.raises(Exception, match=why):
            warc.resolved(captures(one, bad)).collect()


def test_targets():
    sizes = {"a": 10, "b": 1000, None: 500, "ä": 100}
    t = mixing.targets(sizes, (5, 2, 1))
    assert sum(t.values()) == pytest.approx(1610)
    assert t["a"] == 30  # its share of 5/13 stops at three times its words
    assert all(t[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert mixing.source_order(["b", None, "ä", "B"]) == ["B", "b", "ä", None]
    assert mixing.targets({"a": 0}, (1,)) == {"a": 0.0}


def test_mixing(spark):
    texts = [f"{'w ' * (1 + i * 7 % 40)}{i}" for i in range(900)] + [None, "", "z " * 9000]
    sources = [("hot" if i % 3 else ["a", "b", None][i % 9 // 3]) for i in range(900)] + ["a", None, "big"]
    rows = docs(spark, *texts, sources=sources)
    rows = rows.union(rows.filter("doc_id = 5"))
    got = mixing.mix(rows, (5, 2, 1)).collect()
    assert len(got) == 904
    by: dict = {}
    for r in got:
        assert r["size"] == len(re.findall(mixing.WORD, texts[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        s = by.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    want = mixing.targets({s: v[2] for s, v in by.items()}, (5, 2, 1))
    for s, (taken, target, _) in by.items():
        assert target == pytest.approx(want[s])
        assert s == "big" or abs(taken - target) <= 0.01 * target
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(rows.repartition(5), (5, 2, 1)).collect()))
    mixed = mixing.mixed_documents(rows, (5, 2, 1))
    assert mixed.columns == rows.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(rows.limit(0)).count() == 0
