"""Column functions over text: white space, identities, entity names, labels.

Positions and lengths are code points. White space is Unicode-wide unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of URLs for name-based UUIDs, and the prefix of entity names (fixed values).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ENTITY_PREFIX = "hybrid-graphrag/entity/"
#: Spellings of one company (fixed values).
ALIASES = {
    "tcs": "tata consultancy services",
    "tata consultancy services ltd": "tata consultancy services",
    "tata consultancy services limited": "tata consultancy services",
}
TRUNCATED = "\n...[truncated]"
#: Characters that end a line.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
_SPACE = r"[\s\x1C-\x1F\x85\xA0  -     　]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_SPACE}+\z", "")


def squash(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{_SPACE}+", " "))


def squash_blanks(c: Column) -> Column:
    """Runs of spaces and tabs as one space, line ends as line feeds, none of either at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " "))


def lines(c: Column) -> Column:
    """Array of lines, without an empty one after a final break."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, the cut marked."""
    s = strip(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(rstrip(F.substring(s, 1, most - 20)), F.lit(TRUNCATED)))


def chunk_id(source: Column, sequence: Column, content: Column, sha1: bool = False) -> Column:
    """A stable identity from source, place and content."""
    seed = F.concat_ws(":", F.coalesce(source, F.lit("")), sequence.cast("string"), F.coalesce(content, F.lit("")))
    return F.concat(F.lit("chunk_"), F.substring(F.sha1(seed) if sha1 else F.sha2(seed, 256), 1, 16))


def entity_key(name: Column) -> Column:
    """The name an entity is resolved by: ASCII letters and digits, lower-cased, known spellings united."""
    key = F.lower(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", " ")))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), key)


def entity_id(name: Column) -> Column:
    """Name-based UUID (version 5) of the entity's key."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat(F.lit(ENTITY_PREFIX), entity_key(name)), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def entity_label(name: Column) -> Column:
    key = entity_key(name)
    return F.when(key == "", F.lit("UNKNOWN_ENTITY")).otherwise(F.upper(key))


def relation_label(label: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(strip(label)), "[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(cut == "", F.lit("related_to")).otherwise(cut)


def page_range(filename: Column) -> Column:
    """``7`` or ``1-5`` from names like ``x_pages_1_to_5.png``; null without a page."""
    pattern = r"(?i)page[s]?[_-](\d+)(?:[_-]to[_-](\d+))?"
    first, last = F.regexp_extract(filename, pattern, 1), F.regexp_extract(filename, pattern, 2)
    return F.when(first == "", F.lit(None)).when(last == "", first).otherwise(F.concat_ws("-", first, last))


def tidy_query(q: Column) -> Column:
    """A query with odd characters dropped and a capital first letter."""
    s = F.regexp_replace(squash(q), r"(?U)[^\w\s?.,'-]", "")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def cache_key(q: Column) -> Column:
    return squash(F.lower(q))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


def clean_evidence(c: Column) -> Column:
    """Without heading marks, bold marks and citation marks."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^\s*#+\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"\*\*(.*?)\*\*", "$1"), r"\[S\d+\]", ""))


def page_label(page: Column) -> Column:
    text = page.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(F.lower(text).contains("page"), text).otherwise(F.concat(F.lit("Page "), text))


def confidence_label(value: Column) -> Column:
    """Shares and percentages as whole per cent; null for anything else."""
    v = value.cast("double")
    whole = lambda x: F.concat(F.floor(x + 0.5).cast("string"), F.lit("%"))
    return F.when(v.isNull() | F.isnan(v) | (v < 0), F.lit(None)).when(v <= 1, whole(v * 100)).when(v <= 100, whole(v))


def page_count(range_: Column) -> Column:
    """The larger end of ``a-b``, or ``a`` alone; null if it is no number."""
    parts = F.split(range_, "-", -1)
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    a, b = a.try_cast("double"), b.try_cast("double")
    return F.when(a.isNull(), F.lit(None)).otherwise(F.greatest(a, F.coalesce(b, a))).cast("int")


def source_type(content_type: Column, content: Column, title: Column, image_file: Column) -> Column:
    """What a piece of evidence shows: table, chart, image or text."""
    kind, body, head = (F.lower(F.coalesce(c, F.lit(""))) for c in (content_type, content, title))
    table = kind.contains("table") | body.rlike(r"\|[-:\s|]+\|") | body.contains("\n|") | body.rlike(r"<(table|tr|td)\b")
    words = r"\b(chart|graph|figure)\b"
    chart = kind.rlike("chart|figure") | head.rlike(words) | body.rlike(words) | body.contains("chart/image file") | body.rlike(r"<!--\s*(chart|graph)\s*-->|<svg\b")
    image = kind.contains("image") | F.coalesce(image_file != "", F.lit(False)) | head.rlike(r"\.(png|jpg|jpeg)$") | body.rlike(r"\.(png|jpg|jpeg)") | body.rlike(r"<!--\s*(image|figure)\s*-->|<img\b")
    return F.when(table, "table").when(chart, "chart").when(image, "image").otherwise("text")


def citation_label(page: Column, title: Column, content: Column, sequence: Column, source: Column, marker: Column) -> Column:
    """How evidence is called in an answer: page, table, figure, section, kind of report, source, title, marker."""
    t, c, s = (strip(F.coalesce(x, F.lit(""))) for x in (title, content, source))
    table = r"(?i)table\s*([\w.-]+)"
    number = F.coalesce(F.nullif(F.regexp_extract(t, table, 1), F.lit("")), F.nullif(F.regexp_extract(c, table, 1), F.lit("")))
    figure = r"(?i)\b(?:graph|figure|chart)\s*([\w.-]+)"
    drawn = F.coalesce(F.nullif(F.regexp_extract(t, figure, 0), F.lit("")), F.nullif(F.regexp_extract(c, figure, 0), F.lit("")))
    cut = lambda x: F.when(F.length(x) > 26, F.concat(F.substring(x, 1, 23), F.lit("..."))).otherwise(x)
    named = lambda x: (x != "") & (F.lower(x) != "document")
    return (
        F.when(page_label(page).isNotNull(), page_label(page)).when(number.isNotNull(), F.concat(F.lit("Table "), number)).when(drawn.isNotNull(), strip(drawn))
        .when(sequence > 0, F.concat(F.lit("Section "), sequence.cast("string"))).when(F.concat_ws(" ", t, s).rlike("(?i)annual|report"), "Annual Report")
        .when(F.concat_ws(" ", t, c).rlike("(?i)financial statement"), "Financial Statement").when(named(s), cut(s)).when(named(t), cut(t))
        .otherwise(F.coalesce(F.nullif(marker, F.lit("")), F.lit("Source")))
    )
