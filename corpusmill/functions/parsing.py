"""Column functions over replies of models and over marked-up text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_evidence, strip

FACTS = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<source:string,target:string,relation:string>>>"
EMPTY_FACTS = '{"entities":[],"relations":[]}'


def json_body(raw: Column) -> Column:
    """The JSON text of a reply: without a code fence, else from the first brace to the last, else empty facts."""
    whole = strip(F.coalesce(raw, F.lit("")))
    whole = strip(F.regexp_replace(whole, r"(?i)^```(?:json)?", ""))
    whole = strip(F.regexp_replace(whole, r"```\z", ""))
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    good = lambda c: F.try_parse_json(c).isNotNull()
    return F.when((whole != "") & good(whole), whole).when((inner != "") & good(inner), inner).otherwise(F.lit(EMPTY_FACTS))


def facts_of(raw: Column) -> Column:
    """Entities and relations of a reply. An entity given as bare text has the type ``other``."""
    body = json_body(raw)
    typed = F.from_json(body, "struct<entities:array<string>,relations:array<string>>")

    def entity(x: Column) -> Column:
        whole = F.from_json(x, "struct<name:string,type:string>")
        kind = F.coalesce(F.nullif(strip(whole["type"]), F.lit("")), F.lit("other"))
        record = F.struct(strip(F.coalesce(whole["name"], F.lit(""))).alias("name"), kind.alias("type"))
        return F.when(x.startswith("{"), record).otherwise(F.struct(x.alias("name"), F.lit("other").alias("type")))

    def relation(x: Column) -> Column:
        whole = F.from_json(x, "struct<source:string,target:string,relation:string>")
        ends = [strip(F.coalesce(whole[e], F.lit(""))).alias(e) for e in ("source", "target")]
        return F.struct(*ends, F.coalesce(whole["relation"], F.lit("related_to")).alias("relation"))

    named = F.filter(F.transform(F.coalesce(typed["entities"], F.array().cast("array<string>")), entity), lambda e: e["name"] != "")
    objects = F.filter(F.coalesce(typed["relations"], F.array().cast("array<string>")), lambda x: x.startswith("{"))
    full = F.filter(F.transform(objects, relation), lambda r: (r["source"] != "") & (r["target"] != ""))
    return F.struct(named.alias("entities"), full.alias("relations"))


def embeddings_of(raw: Column) -> Column:
    """Vectors of a reply in the order of their index; null if it has neither form."""
    both = F.from_json(raw, "struct<data:array<struct<index:int,embedding:array<double>>>,embeddings:array<array<double>>>")
    placed = F.transform(both["data"], lambda r, i: F.struct(F.coalesce(r["index"], F.lit(0)).alias("at"), i.alias("i"), r["embedding"].alias("v")))
    return F.coalesce(F.transform(F.array_sort(placed), lambda r: r["v"]), both["embeddings"])


def rerank_scores(raw: Column, n: Column) -> Column:
    """Scores by position of a rerank reply; positions it leaves out score 0. Of repeated positions the last counts."""
    row = "array<struct<index:int,document_index:int,logit:double,score:double,relevance_score:double>>"
    reply = F.from_json(raw, f"struct<rankings:{row},results:{row},scores:array<double>>")

    def spread(items: Column, *names: str) -> Column:
        def at(i: Column) -> Column:
            mine = F.filter(items, lambda r: F.coalesce(r["index"], r["document_index"], F.lit(0)) == i)
            return F.when(F.size(mine) > 0, F.coalesce(*[F.element_at(mine, -1)[x] for x in names], F.lit(0.0))).otherwise(0.0)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))

    rankings = spread(reply["rankings"], "logit", "score", "relevance_score")
    results = spread(reply["results"], "relevance_score", "score")
    return F.when(reply["rankings"].isNotNull(), rankings).when(reply["results"].isNotNull(), results).otherwise(reply["scores"])


def sub_questions(raw: Column) -> Column:
    """Questions of a planner's JSON list: texts, or objects with question, sub_question or text; blanks dropped."""
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        o = F.from_json(x, "struct<question:string,sub_question:string,text:string>")
        told = F.coalesce(*[F.nullif(o[k], F.lit("")) for k in ("question", "sub_question", "text")], F.lit(""))
        return strip(F.when(x.startswith("{"), told).otherwise(x))

    return F.filter(F.transform(items, one), lambda q: q != "")


def multi_hop(flag: Column, questions: Column) -> Column:
    """The questions if there are two or more and the planner says so, else none."""
    return F.when(F.coalesce(flag, F.lit(False)) & (F.size(questions) >= 2), questions).otherwise(F.array().cast("array<string>"))


CATEGORIES = ("answerable", "ambiguous", "unanswerable", "out_of_scope", "trick")


def category(raw: Column) -> Column:
    c = F.lower(strip(F.coalesce(raw, F.lit("answerable"))))
    return F.when(c.isin(*CATEGORIES), c).otherwise("answerable")


def sse_frame(event: Column, data: Column) -> Column:
    """``data``: JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_events(stream: Column) -> Column:
    """Array of (event, data) of a text of frames; frames without data or with broken JSON are skipped."""

    def frame(block: Column) -> Column:
        rows = F.split(block, "\n", -1)
        named = F.filter(rows, lambda x: x.startswith("event: "))
        data = F.filter(rows, lambda x: x.startswith("data: "))
        event = F.when(F.size(named) > 0, F.trim(F.substring(F.element_at(named, -1), 8, 10**6))).otherwise("message")
        return F.struct(event.alias("event"), F.concat_ws("", F.transform(data, lambda x: F.trim(F.substring(x, 7, 2**31 - 1)))).alias("data"), F.size(data).alias("n"))

    frames = F.transform(F.split(stream, "\n\n", -1), frame)
    fine = F.filter(frames, lambda f: (f["n"] > 0) & F.try_parse_json(F.nullif(f["data"], F.lit(""))).isNotNull())
    return F.transform(fine, lambda f: F.struct(f["event"].alias("event"), f["data"].alias("data")))


def pieces(text: Column, size: int = 8) -> Column:
    """Consecutive pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def vision_entries(report: Column) -> Column:
    """(file, body) of each described image of a report; blank bodies are dropped."""
    pattern = r"(?msd)^## File:\s*`([^`]+)`\s*\n(.*?)(?=^---\s*$|^## File:|\z)"
    names, bodies = (F.regexp_extract_all(report, F.lit(pattern), F.lit(g)) for g in (1, 2))
    both = F.zip_with(names, bodies, lambda a, b: F.struct(strip(a).alias("file"), strip(b).alias("body")))
    return F.filter(both, lambda e: e["body"] != "")


def markdown_table(text: Column) -> Column:
    """Rows of cells of the lines with pipes, the first row being the header; null if there are not two."""
    rows = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x.contains("|"))
    rule = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?$"
    body = F.filter(rows, lambda x: ~x.rlike(rule))
    cells = F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), clean_evidence))
    return F.when((F.size(rows) >= 2) & (F.size(body) >= 2), cells)


def html_table(text: Column) -> Column:
    """Rows of cells of the first table; null if there are not two."""
    table = F.regexp_extract(F.regexp_replace(text, "\n", " "), r"(?is)<table.*?</table>", 0)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    cell = r"(?is)<(?:th|td)[^>]*>(.*?)</(?:th|td)>"
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), lambda c: clean_evidence(F.regexp_replace(c, "<[^>]+>", ""))))
    full = F.filter(cells, lambda r: F.size(r) > 0)
    return F.when(F.size(full) >= 2, full)


def evidence_blocks(text: Column) -> Column:
    """(type, text) of each block between blank lines: heading or paragraph."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}", -1), strip), lambda b: b != "")

    def one(b: Column) -> Column:
        head = F.regexp_extract(b, r"^(#{1,6})\s+(.+)$", 2)
        return F.struct(F.when(head != "", "heading").otherwise("paragraph").alias("type"), clean_evidence(F.when(head != "", head).otherwise(b)).alias("text"))

    return F.transform(blocks, one)


SECTIONS = ("Summary", "Key Findings", "Evidence", "Sources")


def answer_sections(text: Column) -> Column:
    """Map from section name to its text; all of it is the summary if no section is named."""
    at = [F.regexp_instr(text, F.lit(rf"(?i){s}\s*:?")) for s in SECTIONS]
    width = [F.length(F.regexp_extract(text, rf"(?i){s}\s*:?", 0)) for s in SECTIONS]
    parts = []
    for i, name in enumerate(SECTIONS):
        start = at[i] + width[i]
        rest = F.substring(text, start, F.lit(2**31 - 1))
        ends = [F.nullif(F.regexp_instr(rest, F.lit(rf"(?i){s}\s*:?")), F.lit(0)) for s in SECTIONS[i + 1 :]]
        end = F.least(*ends, F.lit(2**31 - 1)) if len(ends) > 1 else F.coalesce(*ends, F.lit(2**31 - 1)) if ends else F.lit(2**31 - 1)
        body = strip(F.substring(rest, F.lit(1), F.coalesce(end, F.lit(2**31 - 1)) - 1))
        parts.append(F.when(at[i] > 0, F.struct(F.lit(name).alias("key"), body.alias("value"))))
    found = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, F.map_from_entries(found)).otherwise(F.create_map(F.lit("Summary"), text))
