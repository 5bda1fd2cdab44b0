"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every text is a blob named by its SHA-256. The ledger holds, for each (blob, rule
version), the spans that were found. A run scans only the blobs that the ledger lacks under the current
rules, each once however many paths hold it, appends them, and joins the findings back to all paths. Spans
come from split and regexp_extract_all with running sums of lengths; no Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import BROADCAST_BYTES, hot_keys, scratch_dir, small, spread_join, stored, table_bytes


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the group that must have at least ``least`` characters for a match to count.

    mask: pattern of what is masked, where that is more than the span that tells the secret.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    mask: str | None = None


#: A private key to its END line; without one, all lines of base64 that follow. Every loop is possessive, so that the
#: matcher needs no stack however long the key is.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{40,}+)*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]*+={1,2})?)"

# The three base rules, in their listed order, then the added ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", mask=PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE_KINDS = 3
MASK = "[redacted]"


def rules_version(rules: tuple[Rule, ...]) -> str:
    """The version of a set of rules: a digest of all that decides what they find, so that changed rules scan anew."""
    return "v" + sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text: Column, rule: Rule) -> list[Column]:
    every = F.lit(rule.pattern)
    return [F.split(text, rule.pattern, -1), F.regexp_extract_all(text, every, F.lit(0)), F.regexp_extract_all(text, every, F.lit(rule.group))]


def _found(text: Column, no: int, rule: Rule) -> Column:
    gap, whole, group = _matches(text, rule)
    size = lambda x: F.transform(x, lambda s: F.length(s))
    zipped = F.arrays_zip(size(gap).alias("gap"), size(whole).alias("size"), size(group).alias("least"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(no).alias("no"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), (z["least"] >= rule.least).alias("keep")))
    return F.when(text.rlike(rule.pattern), rows)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) for the texts that hold a secret; spans: array of (start, no, end), sorted.

    ``blobs``: blob, text. Positions are code points from 0, ends exclusive; per rule, matches are the
    leftmost ones that do not overlap. A blob given twice yields one row.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<no:int,i:int,gap:int,size:int,keep:boolean>>")
    found = F.concat(*[F.coalesce(_found(t, no, r), none) for no, r in enumerate(rules)])
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | t.rlike(r.pattern)
    rows = blobs.where(any_rule).select("blob", F.explode(found).alias("m")).select("blob", "m.*").where("size is not null").dropDuplicates(["blob", "no", "i"])
    upto = Window.partitionBy("blob", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)
    spans = rows.withColumn("end", end).where("keep").select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), "no", "end").alias("s"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("spans"))


SPANS = "array<struct<start:bigint,no:int,end:bigint>>"


def scan_ledger(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every row of ``docs``, scanning exactly the blobs that the ledger lacks under these rules.

    ``docs`` may hold any number of versions of a path. ``ledger``: folder of the ledger's Parquet files, by
    rule version, made if missing; a new folder in the shared scratch space by default. Two runs at once may
    both scan a blob; it is still reported once. A null text is the empty blob. Rows with a null path are
    scanned and reported like others; repeated rows are reported each; an empty table gives an empty result.
    """
    spark, version = docs.sparkSession, rules_version(rules)
    ledger = ledger or scratch_dir(spark)
    rows = docs.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"), F.col(text).alias("text"))
    listed = stored(rows.select("path", "blob"))
    unseen = unseen_blobs(listed, ledger_entries(spark, ledger, version))
    found = scan(texts_of(rows, listed, unseen), rules)
    entries = unseen.select("blob").join(found, "blob", "left").select("blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.lit(version).alias("version"))
    entries.write.mode("append").partitionBy("version").parquet(ledger)
    now = ledger_entries(spark, ledger, version)
    copies = stored(listed.groupBy("blob").agg(F.count("*").alias("n")))
    now = stored(now.join(copies, "blob").select("blob", "spans", "n"))
    return spread_join(listed, now.select("blob", "spans"), "blob", hot_keys(now, "blob", "n")).select(F.col("path").alias(path), "blob", "spans")


def ledger_entries(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """(blob, spans) that the ledger holds under a rule version, a blob once."""
    schema = f"blob binary, spans {SPANS}, version string"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("version").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).where(F.col("version") == version).groupBy("blob").agg(F.first("spans").alias("spans"))


def unseen_blobs(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(path, blob, n): each blob that ``known`` lacks, under its least path, with the rows that repeat the pair."""
    pairs = stored(listed.groupBy("path", "blob").agg(F.count("*").alias("n")))
    first = pairs.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("no_path"), "path", "n")).alias("own"))
    return stored(first.join(known.select("blob"), "blob", "left_anti").select("own.path", "blob", "own.n"))


def texts_of(rows: DataFrame, listed: DataFrame, owners: DataFrame) -> DataFrame:
    """(blob, text): the text of each owner pair, from one of its rows.

    The shorter list is sent to every executor, so texts stay where they are: the pairs to scan, as in a run
    that adds to a ledger, or the pairs to skip, as in a first run. If both are long, the rows are shuffled.
    """
    own = owners.select(F.col("path").alias("o_path"), F.col("blob").alias("o_blob"))
    same = F.col("path").eqNullSafe(F.col("o_path")) & (F.col("blob") == F.col("o_blob"))
    skip = stored(listed.distinct().join(own, same, "left_anti").select(F.col("path").alias("o_path"), F.col("blob").alias("o_blob")))
    to_scan, to_skip = table_bytes(own), table_bytes(skip)
    todo = rows.join(own, same, "left_semi")
    if min(to_scan, to_skip) <= BROADCAST_BYTES:
        todo = rows.join(F.broadcast(own), same, "left_semi") if to_scan < to_skip else rows.join(F.broadcast(skip), same, "left_anti")
    again = stored(owners.where("n > 1").select(F.col("path").alias("o_path"), F.col("blob").alias("o_blob")))
    if again.isEmpty():
        return todo.select("blob", "text")
    once = todo.join(small(again), same, "left_anti").select("blob", "text")
    return once.unionByName(todo.join(small(again), same, "left_semi").groupBy("blob").agg(F.first("text").alias("text")))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, by start and then rule, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["no"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", where: Column | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by MASK, one rule after the other, in rows of ``where``.

    Rules with a mask go first, while their texts are whole. Each rule is a projection of its own: nested in one
    expression, the text would be repeated at every level.
    """
    chosen = F.lit(True) if where is None else where
    t = F.col(text)
    for rule in sorted(rules, key=lambda r: r.mask is None):
        rule = replace(rule, pattern=rule.mask or rule.pattern)
        gap, whole, group = _matches(t, rule)
        pieces = F.transform(F.arrays_zip(gap.alias("gap"), whole.alias("whole"), group.alias("group")), _masked(rule))
        docs = docs.withColumn(text, F.when(chosen & t.rlike(rule.pattern), F.array_join(pieces, "")).otherwise(t))
    return docs


def _masked(rule: Rule) -> Callable[[Column], Column]:
    def piece(z: Column) -> Column:
        kept = F.when(F.length(z["group"]) >= rule.least, F.lit(MASK)).otherwise(F.coalesce(z["whole"], F.lit("")))
        return F.concat(F.coalesce(z["gap"], F.lit("")), kept)

    return piece
