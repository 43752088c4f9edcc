"""Secret scanning over an incremental blob ledger (DataFrame functions only).

Every version of every document is addressed by the SHA-256 of its text. The ledger remembers which
paths ever carried which blob, which (blob, rule) pairs were scanned, and what they held. A run hashes
every text to address it, but scans only blobs with a pair not seen before; findings are joined back to
all paths, of this run (``secret_report``) or of all versions (``BlobLedger.history``).

Defined results: a null text counts as empty; an empty text has no spans and the SHA-256 of the empty
string as digest; repeated rows each get their own result row; an empty table gives no rows; extra
columns are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import store


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost first; one is kept if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        told = f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"
        return f"{self.kind}@{hashlib.sha256(told.encode()).hexdigest()[:16]}"


# The patterns of the contract. The long forms of access and hex find the same spans as
# the short ones with a length test, as both match maximal runs of one character class.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

_SEEN = "blob binary, rule string"
_FOUND = "blob binary, rule string, start long, `end` long"


class BlobLedger:
    """Versions (path, blob), scanned (blob, rule) pairs and findings, as append-only Parquet tables under ``path``.

    A batch writes its findings before its seen pairs, so a run that dies between the two is scanned
    again; readers drop what is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = BASE_RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _table(self, name: str, ddl: str) -> DataFrame:
        if store.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], ddl)

    def seen(self) -> DataFrame:
        return self._table("seen", _SEEN).distinct()

    def findings(self) -> DataFrame:
        return self._table("findings", _FOUND).distinct()

    def versions(self) -> DataFrame | None:
        """path, blob of every version ever addressed; None before the first run."""
        if store.exists(self.spark, f"{self.path}/versions"):
            return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/versions").distinct()
        return None

    def _remember(self, paths: DataFrame, batch: str) -> None:
        """Add the versions that are not on record."""
        old = self.versions()
        if old is not None:
            old = old.select(F.col("path").alias("old_path"), F.col("blob").alias("old_blob"))
            paths = paths.join(old, (F.col("blob") == F.col("old_blob")) & F.col("path").eqNullSafe(F.col("old_path")), "left_anti")
        paths.write.parquet(f"{self.path}/versions/{batch}")

    def history(self) -> DataFrame | None:
        """path, blob, rule, start, end: the findings of all versions of all paths; None before the first run."""
        versions = self.versions()
        return None if versions is None else versions.join(self.findings(), "blob").select("path", "blob", "rule", "start", "end")

    def _unseen(self, blobs: DataFrame) -> DataFrame:
        """Each blob with the versions of the rules it was never scanned under."""
        versions = F.array(*[F.lit(r.version) for r in self.rules])
        done = self.seen().groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = F.array_except(versions, F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(done, "blob", "left").select("blob", "at", todo.alias("todo")).filter(F.size("todo") > 0)

    def scan(self, docs: DataFrame, text: str = "text", path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """Scan what is new; returns (paths with their blob, findings of all their blobs)."""
        content = F.coalesce(F.col(text), F.lit(""))
        batch = uuid.uuid4().hex
        addressed = docs.select(F.col(path).alias("path"), F.unhex(F.sha2(content, 256)).alias("blob"))
        paths = store.keep(addressed, "blob-paths")
        self._remember(paths, batch)
        # One carrier of each blob is scanned: the smallest path. The join key spreads exact copies, as
        # it holds the path too.
        blobs = paths.groupBy("blob").agg(F.min("path").alias("carrier"))
        todo = store.keep(self._unseen(blobs.select("blob", F.xxhash64("carrier", "blob").alias("at"))), "blob-todo")
        texts = docs.select(F.col(path).alias("path"), content.alias("content"))
        texts = texts.withColumn("address", F.unhex(F.sha2("content", 256)))
        texts = texts.select("content", "address", F.xxhash64("path", "address").alias("at"))
        fresh = texts.join(todo, "at").filter(F.col("blob") == F.col("address"))
        hits = [self._matches(r, F.col("content")) for r in self.rules]
        fresh = fresh.select("blob", F.concat(*hits).alias("hits")).filter(F.size("hits") > 0)
        fresh = fresh.groupBy("blob").agg(F.first("hits").alias("hits"))  # repeated rows of one carrier
        spans = fresh.select("blob", F.inline("hits"))
        order = Window.partitionBy("blob", "rule").orderBy("at_match")
        spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(order))
        spans = spans.filter("keep").select("blob", "rule", (F.col("end") - F.col("width")).alias("start"), "end")
        spans.write.parquet(f"{self.path}/findings/{batch}")
        todo.select("blob", F.explode("todo").alias("rule")).write.parquet(f"{self.path}/seen/{batch}")
        mine = self.findings().filter(F.col("rule").isin([r.version for r in self.rules]))
        return paths, mine

    @staticmethod
    def _matches(rule: Rule, content: Column) -> Column:
        """An array with a struct for each match in order: rule, number, characters before it since the last, its width, kept or not."""
        found = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
        value = found if rule.group == 0 else F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))
        between = F.split(content, rule.pattern, -1)
        parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(between) - 1).alias("g"))

        def row(x: Column, i: Column) -> Column:
            return F.struct(
                F.lit(rule.version).alias("rule"), i.cast("long").alias("at_match"), F.length(x["g"]).cast("long").alias("gap"),
                F.length(x["m"]).cast("long").alias("width"), (F.length(x["v"]) >= rule.least).alias("keep"),
            )

        kind = "array<struct<rule:string,at_match:bigint,gap:bigint,width:bigint,keep:boolean>>"
        wanted = F.array_contains("todo", rule.version) & content.rlike(rule.pattern)
        return F.when(wanted, F.transform(parts, row).cast(kind)).otherwise(F.array().cast(kind))


def digest_spans(findings: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row for each blob with findings: counts by kind and its spans as text, by start, then rule order."""
    rank = F.create_map(*[F.lit(v) for i, r in enumerate(rules) for v in (r.version, i)])
    kind = F.split(F.col("rule"), "@")[0]
    told = F.struct("start", rank[F.col("rule")].alias("rank"), "end", kind.alias("kind"))
    counts = [F.count_if(F.col("rule") == r.version).alias(f"n_{r.kind}") for r in rules]
    grouped = findings.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(told)).alias("all"))
    text = F.concat_ws(",", F.transform("all", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    return grouped.select("blob", *[f"n_{r.kind}" for r in rules], text.alias("spans"))


def secret_report(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """One row per path: counts, digest and text of its spans. Copies of a blob share one scan."""
    paths, findings = ledger.scan(docs)
    # Written out, so that both sides of the join are plain scans and a hot blob can be split.
    per_blob = store.keep(digest_spans(findings, ledger.rules), "blob-digests")
    spans = F.coalesce("spans", F.lit(""))
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast(T.LongType()).alias(f"n_{r.kind}") for r in ledger.rules]
    joined = paths.join(per_blob, "blob", "left")
    return joined.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
