from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import pii


CASES = [
    ("mail A@x.co and a@X.CO or b@y.org", "mail [EMAIL_1] and [EMAIL_1] or [EMAIL_2]"),
    ("call (499) 555-6503", "call (499) 555-6503"),
    ("call (699) 555-6503", "call [PHONE_1]"),
    ("919876543210", "[AADHAAR_1]"),
    ("card 4111 1111 1111 1111", "card [CREDIT_CARD_1]"),
    ("card 4111 1111 1111 1112", "card [AADHAAR_1] 1112"),
    ("PAN ABCDE1234F.", "PAN [PAN_1]."),
    ("22ABCDE1234F1Z5", "[GSTIN_1]"),
    ("+91 98765 43210 and 9876543210", "[PHONE_1] and [PHONE_2]"),
    ("0000000000000", "0000000000000"),
    ("9876543210, (698) 765-4321; 9876543210", "[PHONE_1], [PHONE_2]; [PHONE_1]"),
    ("c@d.de c@d.de 222222222222 C@d.de", "[EMAIL_1] [EMAIL_1] 222222222222 [EMAIL_1]"),
    ("", ""),
    (None, None),
]


def test_mask(spark):
    # Columns with the names that passes use inside.
    rows = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(CASES)], "t0 long, text string, row string, m0 string")
    got = pii.mask_rows(rows).orderBy("t0").collect()
    assert [r.masked for r in got] == [want for _, want in CASES]
    assert [(r.row, r.m0) for r in got] == [("x", "y")] * len(CASES)
    assert pii.mask_rows(rows.limit(0)).count() == 0


def test_audit_is_of_this_text_only(spark):
    rows = spark.createDataFrame([("typed [EMAIL_1] and C@d.de c@d.de",), (None,), ("plain",)], "text string")
    got = {r.text: (r.masked, r.audit) for r in pii.mask_rows(rows).collect()}
    assert got == {"typed [EMAIL_1] and C@d.de c@d.de": ("typed [EMAIL_1] and [EMAIL_1] [EMAIL_1]", {"[EMAIL_1]": "C@d.de"}), None: (None, {}), "plain": ("plain", {})}


@pytest.mark.parametrize(("digits", "fits"), [("4111111111111111", True), ("4111111111111112", False), ("79927398713", True), ("18", True), ("19", False)])
def test_luhn(spark, digits, fits):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] is fits


def test_table_numbering(spark):
    rows = spark.createDataFrame([(2, "b@x.de a@x.de"), (1, "c@x.de"), (3, "A@x.de"), (4, None)], "doc_id long, text string")
    tokens = pii.token_table(rows)
    got = {r.normalized: (r.token, r.display, r.first_ord) for r in tokens.collect()}
    assert got == {"c@x.de": ("[EMAIL_1]", "c@x.de", 1), "b@x.de": ("[EMAIL_2]", "b@x.de", 2), "a@x.de": ("[EMAIL_3]", "a@x.de", 2)}
    masked = {r.doc_id: r.masked for r in pii.mask_table(rows, tokens).collect()}
    assert masked == {1: "[EMAIL_1]", 2: "[EMAIL_2] [EMAIL_3]", 3: "[EMAIL_3]", 4: None}


def test_table_of_many_values(spark):
    ids = [(i * 7919) % 500 for i in range(500)]
    rows = spark.createDataFrame([(i, f"u{i // 2}@x.de and ABCDE{i:04d}F") for i in ids] + [(None, "n@x.de"), (3, "u1@x.de")], "doc_id long, text string").repartition(5)
    tokens = pii.token_table(rows)
    got = {(r.type, r.normalized): int(r.token.split("_")[1][:-1]) for r in tokens.collect()}
    # A null key is the first.
    assert got == {("EMAIL", "n@x.de"): 1} | {("EMAIL", f"u{i}@x.de"): i + 2 for i in range(250)} | {("PAN", f"ABCDE{i:04d}F"): i + 1 for i in range(500)}
    masked = pii.mask_table(rows, tokens).collect()
    want = [(i, f"[EMAIL_{i // 2 + 2}] and [PAN_{i + 1}]") for i in range(500)] + [(None, "[EMAIL_1]"), (3, "[EMAIL_3]")]
    assert sorted(map(tuple, masked), key=str) == sorted(want, key=str)
