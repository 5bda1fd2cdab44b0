"""Privacy rules for text and labels: rule names only, never the value found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule name and pattern. Word boundaries are written out, as engines differ on letters beyond ASCII.
TEXT_RULES = (
    ("absolute_path", r"(?i)(/(users|home)/[^/\s]+|[a-z]:\\users\\[^\\\s]+)"),
    ("authorization", r"(?i)(^|[^a-z0-9_])bearer\s+([^\s$]|\$([^{]|$))"),
    ("email", r"[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}([^A-Za-z0-9_]|$)"),
    ("markup", r"(?i)</?[a-z][^>]*>"),
    ("secret", r"(^|[^A-Za-z0-9_])(sk-|pplx-|ghp_|github_pat_)[A-Za-z0-9_-]{15,}[A-Za-z0-9_]([^A-Za-z0-9_]|$)"),
    ("url", r"(?i)(https?|file)://"),
)
#: A model marker of synthetic events, which is no markup.
SYNTHETIC = "<synthetic>"


def privacy_findings(text: Column) -> Column:
    """Names of the rules that a text breaks, sorted and joined by commas. A placeholder behind ``Bearer`` names a variable."""
    plain = F.replace(text, F.lit(SYNTHETIC), F.lit("synthetic"))
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(plain.rlike(p), F.lit(False)), n) for n, p in TEXT_RULES])), ",")


def receipt_privacy(receipts: DataFrame, allowed: list[str], label_limit: int = 180, provenance_limit: int = 500) -> DataFrame:
    """Findings per receipt line (a VARIANT column ``receipt``): unknown fields, long texts, malformed digests."""
    text = F.col("receipt").cast("string")
    fields = F.map_keys(F.from_json(F.to_json("receipt"), "map<string,string>"))
    unknown = F.array_except(fields, F.array(*map(F.lit, allowed)))
    get = lambda p, t="string": F.try_variant_get("receipt", p, t)
    keys = F.coalesce(F.try_variant_get("receipt", "$.correlation_keys", "array<string>"), F.array().cast("array<string>"))
    found = F.array(
        F.when(F.size(unknown) > 0, F.lit("unknown_field")), F.when(F.length(get("$.source")) > label_limit, F.lit("long_label")),
        F.when(F.length(get("$.provenance")) > provenance_limit, F.lit("long_provenance")), F.when(F.exists(keys, lambda k: ~k.rlike("^sha256:[0-9a-f]{64}$")), F.lit("bad_digest")),
    )
    return receipts.withColumn("findings", F.concat(F.array_compact(found), F.filter(F.split(privacy_findings(text), ","), lambda x: x != "")))


def label_errors(daily: DataFrame, vocabulary: list[str], require_reviewed: bool) -> DataFrame:
    """Rows whose label is outside the vocabulary or, if asked, not reviewed."""
    d = F.col("driver")
    why = F.when(d.isNull(), "missing").when(~d.isin(*vocabulary), "unknown_label")
    if require_reviewed:
        why = why.when(d == "unreviewed", "unreviewed")
    return daily.withColumn("why", why).where("why is not null")


def provenance_errors(labels: DataFrame) -> DataFrame:
    """Label provenance (method, confidence, signals, digest) with the rules it breaks."""
    rules = F.array(
        F.when(~F.col("method").isin("manual", "rule", "model"), F.lit("method")), F.when(~F.col("confidence").between(0, 1), F.lit("confidence")),
        F.when(F.size("signals") == 0, F.lit("signals")), F.when(~F.col("digest").rlike("^sha256:[0-9a-f]{64}$"), F.lit("digest")),
    )
    return labels.withColumn("errors", F.array_compact(rules))


def public_view(intervals: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals without notes, and the ledger's counts without identities."""
    return intervals.select("source", "from", "to", "status"), ledger.groupBy("source").agg(F.count("*").alias("entries"))
