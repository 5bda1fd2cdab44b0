"""Quality rules: text statistics in Spark expressions and a decision list learned from labels.

Sequential covering: a rule grows by the threshold test with the best information gain over the rows that
it still holds, is pruned on rows set apart, and takes the rows it covers out of play; then the next rule
grows. Counts for every step come from one Spark aggregation over a bounded sample of labelled rows. The
learned list is an ordered chain of F.when conditions. No Python runs on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols_a_word", "mean_word", "dup_line_share", "repeat_share", "upper_share", "marks_a_word", "stops_a_word", "digits_a_word", "short_share", "distinct_share"]


@dataclass(frozen=True)
class RuleParams:
    """sample_rows: expected number of labelled rows that rules are learned from. cuts: candidate thresholds
    a feature and class. most_rules, most_tests: size of the list. precision: share of a rule's labelled
    rows that must be bad, on the growing and on the pruning rows. support: least bad rows a rule covers.
    """

    sample_rows: int = 20_000
    cuts: int = 16
    most_rules: int = 8
    most_tests: int = 3
    precision: float = 0.99
    support: int = 8


@dataclass(frozen=True)
class Test:
    """feature >= cut, or feature < cut."""

    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        """The test as a Spark condition."""
        return F.col(self.feature) >= self.cut if self.at_least else F.col(self.feature) < self.cut


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of tests that rejects a document; no rule holding keeps it."""

    rules: list[list[Test]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(conjunction(rule), i).otherwise(out)
        return out


def conjunction(rule: list[Test]) -> Column:
    """All of the tests."""
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def text_statistics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Add the base counts and the features of every whole text; a null text counts as empty.

    Words are runs without ASCII white space. n_repeat_words counts the words inside windows of ``window``
    words that occur at least twice in the text: windows are hashed, sorted with their positions, equal
    neighbours found, and the union of their spans summed. Ratios of empty texts are 0. Input columns
    whose names clash with an added one are replaced.
    """
    made = [*BASE, *FEATURES]
    kept = [c for c in docs.columns if c not in made]
    t, words, h, win = F.col("_q_text"), F.col("_q_words"), F.col("_q_hash"), F.col("_q_win")
    df = docs.select(*[F.col(c) for c in kept], F.coalesce(F.col(text), F.lit("")).alias("_q_text"))
    df = df.withColumn("_q_trim", F.btrim(t, F.lit(WHITE)))
    df = df.withColumn("_q_words", F.when(F.col("_q_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_q_trim", GAP))).drop("_q_trim")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "_q_hash": F.transform(words, lambda w: F.xxhash64(w)),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_q_lines": lines,
        "_q_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "_q_marks": F.regexp_count(t, F.lit("[!?]")),
        "_q_stops": F.regexp_count(t, F.lit("[.,;]")),
        "_q_digits": F.regexp_count(t, F.lit("[0-9]")),
        "_q_short": F.size(F.filter(words, lambda w: F.length(w) <= 3)),
    }).drop("_q_text", "_q_words")
    places = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_n_lines": F.size("_q_lines"),
        "_q_distinct": F.size(F.array_distinct(h)),
        "_q_win": F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
    }).drop("_q_hash", "_q_lines")
    none = F.array().cast("array<bigint>")
    bits = F.ceil(F.log2(F.size(win) + F.lit(1))).cast("int")
    df = df.withColumn("_q_bits", F.when(F.size(F.array_distinct(win)) < F.size(win), bits))
    bits = F.col("_q_bits")
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    keyed = F.transform(win, lambda w, i: w.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_q_low", low).withColumn("_q_sorted", F.when(bits.isNotNull(), F.sort_array(keyed)).otherwise(none))
    place = lambda x: x.bitwiseAND(F.col("_q_low")).cast("int")
    same = lambda x, y: F.coalesce(F.get(win, place(x)) == F.get(win, place(y)), F.lit(False))
    order = F.col("_q_sorted")
    again = F.filter(order, lambda x, k: same(x, F.get(order, k - 1)) | same(x, F.get(order, k + 1)))
    df = df.withColumn("_q_again", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("_q_low")))))
    at = F.col("_q_again")
    reach = F.transform(at, lambda p, k: F.when(k == 0, F.lit(window).cast("bigint")).otherwise(F.least(F.lit(window).cast("bigint"), p - F.get(at, k - 1))))
    df = df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return df.select(*kept, *BASE, *[share(a, b).alias(c) for c, a, b in (
        ("symbols_a_word", "n_symbols", "n_words"), ("mean_word", "word_chars", "n_words"), ("dup_line_share", "n_dup_lines", "_q_n_lines"),
        ("repeat_share", "n_repeat_words", "n_words"), ("upper_share", "_q_upper", "word_chars"), ("marks_a_word", "_q_marks", "n_words"),
        ("stops_a_word", "_q_stops", "n_words"), ("digits_a_word", "_q_digits", "n_words"), ("short_share", "_q_short", "n_words"), ("distinct_share", "_q_distinct", "n_words"),
    )])


def labelled_sample(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Features of about ``sample_rows`` labelled documents, chosen by a hash of the id, with ``bad``."""
    found = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = min(1.0, params.sample_rows / max(1, found.count()))
    drawn = found.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 20)) < rate * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return text_statistics(rows).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"), *FEATURES)


def learn_rules(sample: DataFrame, params: RuleParams = RuleParams()) -> DecisionList:
    """Learn a decision list from rows of FEATURES, ``bad`` (0/1) and doc_id. No bad row: an empty list."""
    p = params
    rows = stored(sample.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("apart"), *FEATURES))
    steps = [(i + 0.5) / p.cuts for i in range(p.cuts)]
    spread = rows.groupBy("bad").agg(*[F.percentile_approx(f, steps, 2000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({v for r in spread for v in r[f] or [] if v is not None}) for f in FEATURES}
    place = [F.size(F.filter(F.array(*map(F.lit, cuts[f] or [0.0])), _up_to(f))).alias(f"bin_{f}") for f in FEATURES]
    rows = stored(rows.select("*", *place))
    out: list[list[Test]] = []
    left = F.lit(True)
    for _ in range(p.most_rules):
        rule = _prune(rows.where(left & F.col("apart")), _grow(rows.where(left & ~F.col("apart")), cuts, p), p)
        if not rule:
            break
        out.append(rule)
        left = left & ~conjunction(rule)
    return DecisionList(out)


def _up_to(name: str) -> Callable[[Column], Column]:
    return lambda cut: cut <= F.col(name)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], p: RuleParams) -> list[Test]:
    rule: list[Test] = []
    while len(rule) < p.most_tests:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])).alias("x")
        counts = rows.where(conjunction(rule)).select("bad", pairs).groupBy("x.f", "x.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
        table = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
        for r in counts:
            table[r["f"]][min(r["bin"], len(cuts[r["f"]]))] = [r["bad"], r["n"]]
        bad, n = (sum(x[i] for x in table[FEATURES[0]]) for i in (0, 1))
        if bad < p.support or rule and bad >= p.precision * n:
            break
        best: tuple[float, Test] | None = None
        for f in FEATURES:
            below_bad = below = 0
            for i, cut in enumerate(cuts[f]):
                below_bad, below = below_bad + table[f][i][0], below + table[f][i][1]
                for at_least, b, m in ((True, bad - below_bad, n - below), (False, below_bad, below)):
                    if b >= p.support and m < n:
                        gain = b * (math.log2(b / m) - math.log2(bad / n))
                        if best is None or gain > best[0]:
                            best = (gain, Test(f, at_least, cut))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[Test], p: RuleParams) -> list[Test]:
    """The shortest beginning of the rule that is about as good on the rows set apart; none if not precise."""
    if not rule:
        return []
    heads = [rule[: i + 1] for i in range(len(rule))]
    sums = [F.coalesce(F.sum(F.when(conjunction(h), x)), F.lit(0)).alias(f"{k}{i}") for i, h in enumerate(heads) for k, x in (("b", F.col("bad")), ("n", F.lit(1)))]
    r = rows.agg(*sums).first()
    good = [(r[f"b{i}"] / r[f"n{i}"], h) for i, h in enumerate(heads) if r[f"n{i}"] and r[f"b{i}"] >= max(1, p.support // 3)]
    good = [x for x in good if x[0] >= p.precision]
    return max(good, key=lambda x: (round(x[0], 2), -len(x[1])))[1] if good else []


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Add base_failed, rule (the first that holds, or 0) and kept to rows of text_statistics.

    base_failed: fewer than 10 words, or over 20 % of words in repeated windows. Equal texts get equal
    verdicts; an empty table gives an empty result.
    """
    # A filter on kept must run on the finished counts: pushed below, it would compute each of them again for
    # every use. Spark pushes no filter through a projection that holds a non-deterministic column.
    stats = stats.withColumn("_q_row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rules.verdict()).withColumn("kept", ~failed & (F.col("rule") == 0) & (F.col("_q_row") >= 0)).drop("_q_row")
