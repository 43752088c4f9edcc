"""Masking personal data with numbered tokens, in column expressions.

Passes follow each other: EMAIL, PAN, GSTIN, CREDIT_CARD, AADHAAR, PHONE twice; each sees what the ones
before it left. In a pass, the matches of a text are an array beside the array of their normal forms, and
the text is put together again from what stands between them and the tokens of the valid ones. A row is
masked on its own (``mask_rows``), with numbers that start at 1 in each row and an audit map of that row
only; or a whole table with one numbering (``mask_table``), where a value's number follows its first
appearance by row order, pass and position.

A null text stays null and has no values; a text without values stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

# The patterns and their order. Classes are of ASCII characters.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}(?![A-Za-z0-9._%+\-])"),
    ("PAN", r"(?<![A-Za-z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Za-z0-9])"),
    ("GSTIN", r"(?<![A-Za-z0-9])[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z](?![A-Za-z0-9])"),
    ("CREDIT_CARD", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    ("AADHAAR", r"(?<!\d)[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}(?!\d)"),
    ("PHONE", r"(?<!\w)(?:\+91[\s.\-]?|91[\s.\-]?|0)?[6-9]\d{4}[\s.\-]?\d{5}(?!\w)"),
    ("PHONE", r"(?<!\w)(?:(?:\+|00)\d{1,3}[\s.\-]?)?(?:\(?\d{2,5}\)?[\s.\-]?)?\d{3,5}[\s.\-]?\d{4,5}(?!\w)"),
)


KINDS = tuple(dict.fromkeys(kind for kind, _ in PATTERNS))


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right, doubled, counts with the sum of its own digits."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, 1).cast("int"))
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def normal_form(kind: str, raw: Column) -> Column:
    """What two spellings of one value share; empty if the value is not valid. Lengths are bounded by the patterns."""
    if kind == "EMAIL":
        return F.lower(raw)
    if kind in ("PAN", "GSTIN"):
        return raw
    digits = F.regexp_replace(raw, "[^0-9]", "")
    n = F.length(digits)
    valid = F.length(F.replace(digits, F.left(digits, F.lit(1)), F.lit(""))) > 0  # not one digit over and over
    if kind == "CREDIT_CARD":
        valid &= luhn(digits)
    if kind == "PHONE":
        valid &= n.between(10, 15) & ~((n == 10) & F.left(digits, F.lit(1)).between("0", "5"))
        return F.when(valid, F.regexp_replace(raw, "[^0-9+]", "")).otherwise("")
    return F.when(valid, digits).otherwise("")


def _pass(rows: DataFrame, i: int, known: Column | None) -> DataFrame:
    """Pass ``i`` over the text ``t<i>``: matches m, normal forms n, values by first appearance d, the text after it.

    ``known``: a column of tokens by kind and normal form; without it, a row numbers its own values.
    """
    kind, pattern = PATTERNS[i]
    t, m, n, g, d = (f"{c}{i}" for c in "tmngd")
    found = F.coalesce(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    rows = rows.select("*", found.alias(m)).select("*", F.transform(m, lambda x: normal_form(kind, x)).alias(n))
    valid = F.filter(n, lambda x: x != "")
    before = [F.col(f"d{j}") for j in range(i) if PATTERNS[j][0] == kind][-1:]
    rows = rows.select("*", F.array_distinct(F.concat(*before, valid)).alias(d), F.when(F.size(valid) > 0, F.split(t, pattern, -1)).alias(g))

    def token(x: Column, j: Column) -> Column:
        normal = F.get(n, j)
        told = F.concat(F.lit(f"[{kind}_"), F.array_position(d, normal).cast("string"), F.lit("]"))
        if known is not None:
            told = F.coalesce(F.try_element_at(known, F.concat(F.lit(f"{kind}:"), normal)), x)
        return F.concat(F.get(g, j), F.when(normal == "", x).otherwise(told))

    whole = F.concat(F.array_join(F.transform(m, token), ""), F.element_at(g, -1))
    done = F.struct(m, n, d, F.when(F.col(g).isNull(), F.col(t)).otherwise(whole).alias(f"t{i + 1}"))
    # Through a generator, as the optimizer would put the whole pass in each place that reads its result.
    return rows.select(*[c for c in rows.columns if c not in (t, m, n, d, g)], F.inline(F.array(done)))


def _values(kind: str) -> Column:
    """The values of one kind, once all passes are made."""
    at = [i for i, (k, _) in enumerate(PATTERNS) if k == kind]
    raws, normals = (F.concat(*[F.col(f"{c}{i}") for i in at]) for c in "mn")

    def value(v: Column, i: Column) -> Column:
        display = F.element_at(raws, F.array_position(normals, v).cast("int"))
        return F.struct(F.lit(kind).alias("type"), v.alias("normalized"), (i + 1).alias("number"), display.alias("display"))

    return F.transform(f"d{at[-1]}", value)


def _passes(rows: DataFrame, text: str, known: Column | None = None) -> DataFrame:
    """row (all columns), masked, and values: an array of (type, normalized, number, display) by kind and first appearance."""
    work = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{text}`").alias("t0"))
    work = reduce(lambda w, i: _pass(w, i, known), range(len(PATTERNS)), work)
    values = [_values(kind) for kind in KINDS]
    return work.select("row", F.col(f"t{len(PATTERNS)}").alias("masked"), F.concat(*values).alias("values"))


def mask_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with masked and audit (token -> first spelling) beside them."""
    entry = lambda v: F.struct(F.concat(F.lit("["), v["type"], F.lit("_"), v["number"].cast("string"), F.lit("]")), v["display"])
    return _passes(rows, text).select("row.*", "masked", F.map_from_entries(F.transform("values", entry)).alias("audit"))


def _numbered(first: DataFrame) -> DataFrame:
    """``first`` (type, normalized, f) with each row's number in its type by f: ranges are counted, then numbered each in a task."""
    spread = first.repartitionByRange("type", "f", "normalized").withColumn("part", F.spark_partition_id())
    spread = written(spread, "pii-values")
    sizes = spread.groupBy("type", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and type
    before = Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("type", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("type", "part").orderBy("f", "normalized"))
    return spread.withColumn("inside", inside).join(F.broadcast(sizes), ["type", "part"]).withColumn("number", F.col("before") + F.col("inside"))


def token_table(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """type, normalized, token, display, first_ord of a table's values, numbered by first appearance."""
    seen = _passes(rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text")
    seen = seen.select(F.col("row.key").alias("ord"), "values")
    seen = seen.select("ord", F.posexplode("values").alias("place", "v")).select("ord", "place", "v.*")
    first = _numbered(seen.groupBy("type", "normalized").agg(F.min(F.struct("ord", "place", "display")).alias("f")))
    token = F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    return first.select("type", "normalized", token.alias("token"), F.col("f.display").alias("display"), F.col("f.ord").alias("first_ord"))


def mask_table(rows: DataFrame, tokens: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and masked text of each row, with the tokens of ``token_table``.

    A row's own values are found first and joined to their tokens; the text is then rebuilt from that
    small map, so the token table may be of any size.
    """
    base = written(rows.select(F.monotonically_increasing_id().alias("n"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "pii-rows")
    seen = _passes(base, "text").select(F.col("row.n").alias("n"), "values")
    seen = seen.select("n", F.explode("values").alias("v")).select("n", "v.type", "v.normalized")
    mine = seen.join(tokens.select("type", "normalized", "token"), ["type", "normalized"])
    pairs = mine.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "normalized"), "token"))).alias("tokens"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = base.join(pairs, "n", "left").withColumn("tokens", F.coalesce("tokens", none))
    # The map rides along in the row; every pass looks its values up there.
    held = both.select(F.struct("key", "tokens").alias("row"), F.col("text").alias("t0"))
    done = reduce(lambda w, i: _pass(w, i, F.col("row.tokens")), range(len(PATTERNS)), held)
    return done.select(F.col("row.key").alias(key), F.col(f"t{len(PATTERNS)}").alias("masked"))
