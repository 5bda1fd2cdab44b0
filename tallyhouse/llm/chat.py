"""Chat formatting after collapsing cumulative snapshots of logged conversations.

A logger that writes the whole conversation after every turn leaves many prefixes. Each turn gets a hash
of its place, role and text; the running XOR of these (two 64-bit seeds) names every prefix of a
conversation. A conversation whose own prefix occurs in a longer one is a snapshot and goes by an
anti-join; of equal conversations the least id stays. What is left is rendered.

Turns are put in order by a sort over ranges, so a conversation of any length is spread over tasks: a task
numbers and combines the turns of its range, and the sums of the ranges before give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn of the template; a null role or text counts as empty.

    A ``<|`` inside role or text is written ``<||``, so that no text can end a turn or begin one.
    """
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<||"))
    return F.concat(F.lit("<|"), plain(role), F.lit("|>\n"), plain(text), F.lit("<|end|>\n"))


def collapse_snapshots(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_same) of the maximal conversations; n_same counts the equal ones it stands for.

    Turns are taken in order of turn, role and whole text (nulls last, as in the SQL twin), so ties and repeated rows have a defined
    place; null and empty roles or texts are told apart. Turns without a conversation id are dropped: they
    belong to none. An empty table gives an empty result.
    """
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    code = lambda seed: F.xxhash64(F.lit(seed), F.col("r").isNull(), F.coalesce("r", F.lit("")), F.col("x").isNull(), F.coalesce("x", F.lit("")))
    order = [F.col(o).asc_nulls_last() for o in ("c", "t", "r", "x")]
    rows = rows.select("c", "t", "r", "x", code(11).alias("a"), code(23).alias("b")).repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that numbers and sums see the same ranges
    rows = stored(rows.select("c", "a", "b", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))
    here = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("c")
    sizes = rows.groupBy("c", "part").agg(F.count("*").alias("m")).select("c", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.sum("m").over(every).alias("n"))
    placed = rows.join(stored(sizes), ["c", "part"]).withColumn("k", F.count("*").over(here) + F.col("skip"))
    placed = stored(placed.select("c", "part", "pos", "k", "n", F.xxhash64("k", "a").alias("p"), F.xxhash64("k", "b").alias("q")))
    sums = placed.groupBy("c", "part").agg(F.bit_xor("p").alias("p0"), F.bit_xor("q").alias("q0"))
    sums = stored(sums.select("c", "part", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("p0", "q0")]))
    xor = lambda x: F.bit_xor(x).over(here).bitwiseXOR(F.col(f"{x}0")).alias(x)
    prefix = stored(placed.join(sums, ["c", "part"]).select("c", "k", "n", xor("p"), xor("q")))
    whole = prefix.where("k = n").groupBy("k", "p", "q").agg(F.min("c").alias("c"), F.count("*").alias("n_same"))
    longer = prefix.where("k < n").select("k", "p", "q").distinct()
    return whole.join(longer, ["k", "p", "q"], "left_anti").select(F.col("c").alias(conv), F.col("k").cast("long").alias("n_turns"), "n_same")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_same, rendered) of the maximal conversations.

    Only their turns are gathered, one conversation a row: rendered text has to be one value.
    """
    kept = stored(collapse_snapshots(turns, conv, turn, role, text))
    rows = turns.select(F.col(conv), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x")).join(kept, conv)
    part = F.struct(*[v for o in ("t", "r", "x") for v in (F.col(o).isNull().alias(f"no_{o}"), F.col(o))])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: rendered_turn(s["r"], s["x"])), "")
    return rows.groupBy(conv, "n_turns", "n_same").agg(joined.alias("rendered"))
