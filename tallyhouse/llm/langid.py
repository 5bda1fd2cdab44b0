"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of ``slots`` rows holds one bit a language (64 languages a 64-bit slice). An n-gram sets its
languages' bits in ``hashes`` rows; the AND of those rows is the set of languages that contain the
n-gram. Per document the bits are counted by language, corrected for the filter's measured rate of
false positives, and the largest corrected share decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.llm.common import U64, blocks, keeps, mix, stored, tidy, utf8

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """n: characters of an n-gram. slots, hashes: shape of the filter. sample_per_lang: expected number of
    training rows a language (all rows if fewer). least_share: of a language's training documents that must
    hold an n-gram. relative: of the n-gram's largest share in any language, below which it counts as foreign.
    """

    n: int = 4
    slots: int = 1 << 18
    hashes: int = 3
    sample_per_lang: int = 4000
    least_share: float = 0.004
    relative: float = 0.25


@dataclass(frozen=True)
class LanguageFilter:
    """The filter: bits[slot, slice], the languages by bit, and each language's false-positive rate."""

    params: LanguageParams
    languages: list[str]
    bits: np.ndarray
    wrong: np.ndarray


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """2 for every code point that is a letter, 1 for a mark, else 0."""
    if not _kinds:
        _kinds.append(np.array([" ML".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.int8).clip(0))
    return _kinds[0]


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams, the document index of each, and whether each document has a letter.

    Texts are lower-cased; runs of other characters than letters and marks act as one boundary, which an
    n-gram may begin or end with but not hold inside.
    """
    lower = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    kind = kinds()[points]
    has = np.bincount(doc[kind == 2], minlength=len(lower)) > 0
    is_letter = kind > 0
    keep = is_letter | np.concatenate([[False], is_letter[:-1]])[: len(points)]
    points, doc, is_letter = np.where(is_letter, points, 0)[keep].astype(U64), doc[keep], is_letter[keep]
    if len(points) < n:
        return np.empty(0, U64), np.empty(0, np.int64), has
    last = len(points) - n + 1
    key = np.zeros(last, U64)
    for i in range(n):
        key = key * U64(0x110001) + points[i : i + last]
    ok = doc[:last] == doc[n - 1 :]
    for i in range(1, n - 1):
        ok &= is_letter[i : i + last]
    return mix(key[ok]), doc[:last][ok], has


def slots_of(keys: np.ndarray, params: LanguageParams) -> list[np.ndarray]:
    """The filter rows of each key."""
    return [(mix(keys + U64(i)) % U64(params.slots)).astype(np.int64) for i in range(params.hashes)]


def distinct(key: np.ndarray, owner: np.ndarray, counts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of both arrays; their counts are appended to ``counts``."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)])
    if counts is not None:
        counts.append(np.diff(first, append=len(key)))
    return key[first], owner[first]


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", params: LanguageParams = LanguageParams()) -> LanguageFilter:
    """Fit the filter on rows with a language; ``docs`` holds the training rows only.

    Copies count once. Each language's distinct texts are thinned by their hash to ``sample_per_lang``
    expected ones. Spark counts in how many of those each n-gram occurs; only n-grams that pass both
    shares reach the driver: a language has at most (n-grams of an average document) / least_share of them.
    No rows, or no text: a filter without languages.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    place = F.xxhash64("text", F.lit("langid"))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", place.alias("h"), F.xxhash64("text").alias("g")).distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages = list(sizes)
    n = params.n
    if not languages:
        return LanguageFilter(params, [], np.zeros((params.slots, 1), U64), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, params.sample_per_lang / v))])
    drawn = rows.where(F.pmod(place, F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    drawn = stored(drawn.groupBy("lang", place.alias("h"), F.xxhash64("text").alias("g")).agg(F.first("text").alias("text")))
    taken = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            texts = utf8(batch.column("text"))
            for lo, hi in blocks(texts):
                key, doc, _ = grams(texts[lo:hi], n)
                key, doc = distinct(key, doc)
                key, own = distinct(key, langs[lo:hi][doc], counts := [])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(counts[0])], names=["lang", "gram", "df"])

    counted = drawn.mapInArrow(tidy(count), "lang int, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    drawn_sizes = F.array(*[F.lit(float(max(1, taken.get(k, 0)))) for k in languages])
    share = counted.withColumn("share", F.col("df") / drawn_sizes[F.col("lang")]).where((F.col("share") >= params.least_share) & (F.col("df") >= 2))
    best = share.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("found"))
    kept = best.select("gram", F.explode("found").alias("x"), "best").where(F.col("x.share") >= params.relative * F.col("best"))
    found = kept.select("gram", "x.lang").toArrow().to_pandas()
    bits = np.zeros((params.slots, (len(languages) + 63) // 64), U64)
    for lang_no, part in found.groupby("lang"):
        for rows_of in slots_of(part["gram"].to_numpy(np.int64).view(U64), params):
            bits[rows_of, lang_no // 64] |= U64(1) << U64(lang_no % 64)
    wrong = np.array([((bits[:, i // 64] >> U64(i % 64)) & U64(1)).mean() ** params.hashes for i in range(len(languages))])
    return LanguageFilter(params, languages, bits, wrong)


def detect(texts: list[bytes], model: LanguageFilter) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of n-grams of each text."""
    key, doc, has = grams(texts, model.params.n)
    rows = slots_of(key, model.params)
    total = np.bincount(doc, minlength=len(texts))
    share = np.zeros((len(texts), max(1, len(model.languages))))
    for part in range(model.bits.shape[1]):
        mask = model.bits[rows[0], part]
        for r in rows[1:]:
            mask = mask & model.bits[r, part]
        for i in range(part * 64, min(len(model.languages), part * 64 + 64)):
            share[:, i] = np.bincount(doc[(mask >> U64(i % 64)) & U64(1) == 1], minlength=len(texts))
    if model.languages:
        share = np.clip((share / np.maximum(total, 1)[:, None] - model.wrong) / (1 - model.wrong), 0, 1)
    best = share.argmax(axis=1)
    known = has & bool(model.languages)
    lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return lang, np.where(known, share[np.arange(len(texts)), best], 0.0), total


def identify_languages(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """Add lang_pred, lang_score (0 to 1) and lang_grams to ``docs``, row by row and without a shuffle.

    A null text, or one without a letter: `und` and 0. Texts with letters but no known n-gram get the
    first language with score 0; ties go to the language first by name. Copies get equal results. Input
    columns of these three names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score", "lang_grams")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("langid", lambda: None)
        m = shared.value
        for batch in batches:
            texts = utf8(batch.column(text))
            found = [detect(texts[lo:hi], m) for lo, hi in blocks(texts)]
            lang = pa.array([x for f in found for x in f[0]], pa.string())
            score, n = (pa.array(np.concatenate([f[i] for f in found]) if found else [], t) for i, t in ((1, pa.float64()), (2, pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score, n], names=[*names, "lang_pred", "lang_score", "lang_grams"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_grams", "long")
    return docs.mapInArrow(tidy(run), schema)
