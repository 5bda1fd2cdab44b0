"""The committed dataset: daily rows, ledger and identities as numbered versions that are read back whole.

    <root>/data/<id>/daily, ledger, identities    Parquet, written first, seen by nobody
    <root>/commits/<number>.json                  names the data of a version; renamed into place last

A commit is the rename of a finished file to the name of the next number, and it fails if that name is taken. So of two
writers that started from one version only one succeeds, a write that dies leaves nothing that a reader would take,
and every older version stays readable. Renames go through Hadoop's FileContext, which refuses an existing target (in one
step on HDFS; object stores without such a rename need a committer of their own).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.evidence import FIELDS, IDENTITY_SCHEMA, LEDGER_SCHEMA, PARTS, STATE
from tallyhouse.operators.imports import DAILY, Import

ENTRY = {c: t for c, t in DAILY.items() if c not in ("day", "source", "timezone", "driver", "evidence")}
_STRUCT = "struct<" + ",".join(f"{c}:{t}" for c, t in ENTRY.items()) + ">"
NESTED_SCHEMA = f"date date, timezone string, total bigint, driver string, evidence string, sources map<string,{_STRUCT}>"
assert PARTS in _STRUCT


class StaleBaseError(RuntimeError):
    """Another version was committed since the base was read."""


@dataclass(frozen=True)
class Dataset:
    """One version: its number (0: none yet) and its three tables."""

    number: int
    daily: DataFrame
    ledger: DataFrame
    identities: DataFrame


def nested_days(daily: DataFrame) -> DataFrame:
    """One row a date, in order of dates: the day's labels, the total, and its entries by source."""
    entry = F.struct(*[F.col(c).alias(c) for c in ENTRY])
    same = [F.max(c).alias(c) for c in ("timezone", "driver", "evidence")]
    days = daily.groupBy("day").agg(*same, F.sum("tokens").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", _as_sortable(entry)))).cast(f"array<struct<source:string,e:{_STRUCT_PAIRS}>>")).alias("_s"))
    back = F.transform_values("_s", lambda _, e: _as_entry(e))
    rows = days.select(F.col("day").alias("date"), "timezone", "total", "driver", "evidence", back.alias("sources"))
    return rows.repartitionByRange("date").sortWithinPartitions("date")


_STRUCT_PAIRS = _STRUCT.replace("map<string,bigint>", "array<struct<key:string,value:bigint>>")


def _as_sortable(entry: Column) -> Column:
    return entry.withField("by_origin", F.array_sort(F.map_entries(entry["by_origin"])))


def _as_entry(entry: Column) -> Column:
    return entry.withField("by_origin", F.map_from_entries(entry["by_origin"]))


def long_days(nested: DataFrame) -> DataFrame:
    """The daily entries of nested rows, one a (day, source)."""
    rows = nested.select(F.col("date").alias("day"), "timezone", "driver", "evidence", F.explode("sources").alias("source", "e"))
    return rows.select("day", "source", "timezone", "driver", "evidence", *[F.col(f"e.{c}").alias(c) for c in ENTRY]).select(*DAILY)


def _files(spark: SparkSession):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, lambda path: hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    hadoop, context = _files(spark)
    folder = hadoop.Path(f"{root}/commits")
    files = context(root)
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Dataset:
    """A committed version, the newest by default; an empty one, number 0, where none is yet."""
    known = versions(spark, root)
    if not known and number in (None, 0):
        empty = [spark.createDataFrame([], s) for s in (", ".join(f"{c} {t}" for c, t in DAILY.items()), LEDGER_SCHEMA, IDENTITY_SCHEMA)]
        return Dataset(0, *empty)
    number = known[-1] if number is None else number
    if number not in known:
        raise ValueError(f"no version {number} below {root}")
    commit = json.loads(spark.read.text(f"{root}/commits/{number:012d}.json", wholetext=True).first()[0])
    at = f"{root}/data/{commit['data']}"
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{at}/{name}")
    return Dataset(number, long_days(read("daily", NESTED_SCHEMA)), read("ledger", LEDGER_SCHEMA), read("identities", IDENTITY_SCHEMA))


def commit_version(spark: SparkSession, root: str, daily: DataFrame, ledger: DataFrame, identities: DataFrame, base: int) -> int:
    """Write the three tables and commit them as the version after ``base``; its number.

    StaleBaseError if a version after ``base`` is there already, before or after the tables were written; the tables of
    a refused or broken write stay unseen.
    """
    number = base + 1
    known = versions(spark, root)
    if (known[-1] if known else 0) != base:
        raise StaleBaseError(f"base {base} is not the newest version of {root}")
    data = uuid.uuid4().hex
    at = f"{root}/data/{data}"
    ledger.select("entry_id", *FIELDS, *STATE).write.parquet(f"{at}/ledger")
    identities.select("entry_id", "key").write.parquet(f"{at}/identities")
    nested_days(daily).write.parquet(f"{at}/daily")
    hadoop, context = _files(spark)
    files, mine = context(root), hadoop.Path(f"{at}/commit.json")
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    stream = files.create(mine, flags, spark._sc._gateway.new_array(hadoop.Options.CreateOpts, 0))
    try:
        stream.write(bytearray(json.dumps({"number": number, "base": base, "data": data}).encode()))
    finally:
        stream.close()
    target = hadoop.Path(f"{root}/commits/{number:012d}.json")
    files.mkdir(target.getParent(), None, True)
    try:
        files.rename(mine, target, spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        if files.util().exists(target):
            raise StaleBaseError(f"version {number} of {root} was committed by another writer") from e
        raise
    return number


def write_plan(spark: SparkSession, root: str, plan: Import, base: int, dry_run: bool = False) -> int | None:
    """Commit an import as the version after ``base``, on which it was planned; errors refuse it, a dry run writes nothing."""
    found = plan.errors.limit(1).collect()
    if found:
        raise ValueError(f"import refused: {found[0]['step']} {found[0]['why']}")
    return None if dry_run else commit_version(spark, root, plan.daily, plan.ledger, plan.identities, base)
