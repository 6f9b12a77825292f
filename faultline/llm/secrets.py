"""Secret scans over an incremental ledger of blobs: every version of a text is addressed by its content, only pairs of
blob and rule version that the ledger lacks are scanned, and findings are joined back to all paths. DataFrame
functions only.

A ledger folder has two tables: `blobs` (blob, rule_version), what has been scanned, and `findings` (blob, rule_version,
kind, kind_order, start, stop). Findings are written before blobs, so a run that ends in between is only repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import free_name

BLOBS = "blob string, rule_version int"
FINDINGS = "blob string, rule_version int, kind string, kind_order int, start long, stop long"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules. Runs of one class of characters need no look at shorter runs.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Keys that carry their issuer's prefix, signed web tokens, and heads of private keys.
ADDED = (Rule("issued", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),)
RULES, RULE_VERSION = BASE + ADDED, 1


def address(text: Column) -> Column:
    """The content address of a text; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """The two tables of a ledger folder; without any yet, both are empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._table("blobs", BLOBS)

    def findings(self, version: int) -> DataFrame:
        return self._table("findings", FINDINGS).where(F.col("rule_version") == version).distinct()


def matches(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, kind_order, start, stop) of every match in `blobs` (blob, text), in code points; rows of one blob count once.

    A text is cut at the matches: the lengths of cuts and matches, added up, are the places. The outer explode keeps
    the optimizer from running the patterns below the join that picks what is to be scanned.
    """
    kinds = [
        F.when(
            F.col("text").rlike(r.pattern),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(k).alias("kind_order"), F.lit(r.least).alias("least"), F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"), F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("whole"), F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length).alias("part")),
        )
        for k, r in enumerate(rules)
    ]
    found = blobs.select("blob", F.explode_outer(F.array(*kinds)).alias("k")).where(F.col("k").isNotNull())
    found = found.select("blob", F.col("k.kind").alias("kind"), "k").dropDuplicates(["blob", "kind"])
    each = found.select("blob", "kind", "k.kind_order", "k.least", F.posexplode(F.arrays_zip("k.gaps", "k.whole", "k.part")).alias("i", "m")).where(F.col("m.whole").isNotNull())
    before = Window.partitionBy("blob", "kind").orderBy("i")
    stop = F.sum(F.col("m.gaps") + F.col("m.whole")).over(before)
    return each.select("blob", "kind", "kind_order", (stop - F.col("m.whole")).alias("start"), stop.alias("stop"), F.col("m.part").alias("part"), "least").where("part >= least").drop("part", "least")


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION) -> None:
    """Scan the blobs of `docs` (doc_id, text) that the ledger has not under this rule version, and enter them.

    Of a blob's rows one is scanned: the first by a key of path and content. That key is even over the data, so copies,
    however many, do not meet in one task.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), address(F.col("text")).alias("blob"), F.col("doc_id"))
    rows = rows.select("text", "blob", F.xxhash64("doc_id", "blob").alias("key"))
    unseen = rows.groupBy("blob").agg(F.min("key").alias("key")).join(ledger.blobs().where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    scanned = rows.join(unseen.hint("shuffle_hash"), ["key", "blob"]).select("blob", "text")
    found = matches(scanned, rules).select("blob", F.lit(version).alias("rule_version"), "kind", "kind_order", "start", "stop")
    found.write.mode("append").parquet(f"{ledger.folder}/findings")
    unseen.select("blob", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{ledger.folder}/blobs")


def by_blob(findings: DataFrame) -> DataFrame:
    """(blob, spans): each blob's findings (start, kind_order, kind, stop) in order."""
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_order", "kind", "stop"))).alias("spans"))


def by_path(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of `docs`, repeated ones too: the findings of its blob, none as an empty array."""
    paths = docs.select("doc_id", address(F.col("text")).alias("blob"))
    return paths.join(by_blob(findings), "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_order:int,kind:string,stop:bigint>>")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every stretch that spans cover, overlapping or touching ones as one, replaced by the mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        apart = (s["start"] > acc["at"]) | ((s["start"] == 0) & (acc["at"] == 0))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """`docs`, all columns, with findings taken out of the texts; n_chars, where there is one, follows."""
    blob, spans = free_name("blob", docs.columns), free_name("spans", docs.columns)
    taken = by_blob(findings).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(blob, address(F.col("text"))).join(taken, blob, "left")
    clean = joined.withColumn("text", F.when(F.col(spans).isNotNull(), redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(*docs.columns)
