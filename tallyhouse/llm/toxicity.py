"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, pairs of neighbouring words and pairs with one word between, hashed
into 2^bits coordinates. Each coordinate has its own learning rate; L1 makes most weights zero. Training
rows are dealt to shards by a hash of the id and ordered inside a shard; in each round every shard runs
FTRL over its rows from the common state. A coordinate then moves by the mean change of the shards that
changed it, so a word that one shard alone holds is learned at full strength. All changes are handed on, as
packed segments of coordinates that Spark's tasks add up segment by segment: a bit tells which coordinates
moved, and a pair of float32 how far; rows that meet new words give many equal pairs, which compress.
Shards and their order do not depend on partitions, so neither do the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.llm.common import LOWER, NOT_ALNUM, U64, blocks, joined, mix, small, span_hash, stored, utf8, words


#: Coordinates that are handed on and added up together.
SEGMENT = 1 << 12


@dataclass(frozen=True)
class ToxicParams:
    """bits: coordinates are 2^bits. alpha, beta, l1, l2: FTRL-proximal. shards, rounds: of training.
    sample_rows: expected number of labelled rows that are learned from.
    """

    bits: int = 20
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.01
    shards: int = 8
    rounds: int = 5
    sample_rows: int = 40_000


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words, pairs and skip pairs, and the document index of each."""
    data, ends = joined(texts)
    data = LOWER[data]
    start, stop, doc = words(data, ends, NOT_ALNUM)
    word = span_hash(data, start, stop)
    codes, docs = [word], [doc]
    for gap, salt in ((1, 3), (2, 5)):
        ok = doc[gap:] == doc[:-gap]
        codes.append((mix(word[:-gap] * U64(salt)) + word[gap:])[ok])
        docs.append(doc[gap:][ok])
    return (mix(np.concatenate(codes)) >> U64(64 - bits)).astype(np.int64), np.concatenate(docs)


def weights(z: np.ndarray, n: np.ndarray, p: ToxicParams) -> np.ndarray:
    """The weights that an FTRL state stands for."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def packed(moved: np.ndarray, pairs: np.ndarray) -> tuple[bytes, bytes]:
    """Which coordinates of a segment moved (bool[SEGMENT]), and float32 pairs of the moved ones."""
    return np.packbits(moved).tobytes(), np.ascontiguousarray(pairs, np.float32).tobytes()


def unpacked(at: bytes, change: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in a segment, and the pair of each."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8))), np.frombuffer(change, np.float32).reshape(-1, 2)


def _round(rows: DataFrame, z: np.ndarray, n: np.ndarray, p: ToxicParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates that changed, and the means of the shards' changes of z and n, over the shards that changed each.

    ``rows``: shard, label, text; a shard's rows lie in one partition, one after the other.
    """
    state = rows.sparkSession.sparkContext.broadcast((z, n))

    def batch_of(segment: int, moved: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        at, change = packed(moved, pairs)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([at], pa.binary()), pa.array([change], pa.binary())], names=["segment", "at", "change"])

    def changes(z: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        z0, n0 = state.value
        moved = np.zeros(-(-len(z) // SEGMENT) * SEGMENT, bool)
        moved[: len(z)] = (n != n0) | (z != z0)
        for s, own in enumerate(moved.reshape(-1, SEGMENT)):
            if own.any():
                i = np.flatnonzero(own) + s * SEGMENT
                yield batch_of(s, own, np.stack([z[i] - z0[i], n[i] - n0[i]], axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = state.value
        shard, z, n = -1, z0, n0
        for batch in batches:
            own, labels, texts = batch.column("shard").to_numpy(), batch.column("label").to_numpy(), utf8(batch.column("text"))
            for lo, hi in blocks(texts):
                at, doc = features(texts[lo:hi], p.bits)
                order = np.argsort(doc, kind="stable")
                at, cut = at[order], np.searchsorted(doc[order], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if own[lo + i] != shard:  # the next shard begins at the common state, too
                        if shard >= 0:
                            yield from changes(z, n)
                        shard, z, n = own[lo + i], z0.copy(), n0.copy()
                    x = np.append(np.unique(at[cut[i] : cut[i + 1]]), 1 << p.bits)  # the last is the bias
                    w = weights(z[x], n[x], p)
                    g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[lo + i]
                    grown = n[x] + g * g
                    z[x] += g - (np.sqrt(grown) - np.sqrt(n[x])) / p.alpha * w
                    n[x] = grown
        if shard >= 0:
            yield from changes(z, n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, change in zip(*(batch.column(c).to_pylist() for c in ("segment", "at", "change"))):
                sums, (i, pairs) = held.setdefault(s, np.zeros((SEGMENT, 3))), unpacked(at, change)
                sums[i, :2] += pairs
                sums[i, 2] += 1
        for s, sums in held.items():
            moved = sums[:, 2] > 0
            yield batch_of(s, moved, sums[moved, :2] / sums[moved, 2:])

    schema = "segment int, at binary, change binary"
    found = rows.mapInArrow(run, schema).repartition("segment").mapInArrow(total, schema).toArrow().to_pylist()
    state.unpersist()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    parts = [(r["segment"] * SEGMENT, *unpacked(r["at"], r["change"])) for r in found]
    dz, dn = np.concatenate([pairs for _, _, pairs in parts]).T.astype(np.float64)
    return np.concatenate([base + at for base, at, _ in parts]), dz, dn


def learn_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> np.ndarray:
    """Weights (float32, the bias last) from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    About ``sample_rows`` labelled rows are taken, by a hash of the id; without rows all weights are 0. Of
    several labels of one id the largest counts; several texts of one id are learned from each. Rows are
    taken in the order of a hash of id and text, so ties of that order are equal rows.
    """
    p = params
    found = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rate = min(1.0, p.sample_rows / max(1, found.count()))
    drawn = stored(found.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < rate * (1 << 20)))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(p.shards)).alias("shard")
    rows = stored(docs.where("text is not null").join(small(drawn), "doc_id").select(shard, F.xxhash64("doc_id", "text").alias("turn"), F.col("label").cast("double").alias("label"), "text"))
    # cached, so that rounds do not shuffle the texts again; a lost block is made again from the stored rows
    rows = rows.repartition(p.shards, "shard").sortWithinPartitions("shard", "turn").select("shard", "label", "text").persist(StorageLevel.MEMORY_AND_DISK)
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    for _ in range(p.rounds):
        i, dz, dn = _round(rows, z, n, p)
        z[i] += dz
        n[i] += dn
    rows.unpersist()
    return weights(z, n, p).astype(np.float32)


def toxicity_scores(docs: DataFrame, weight: np.ndarray, text: str = "text") -> DataFrame:
    """Add toxic_score (0 to 1), the modelled chance of label 1, to every row of ``docs``.

    A null or empty text gets the bias alone. Texts are scored whole, row by row, without a shuffle;
    repeated rows get equal scores; an input column of that name is replaced.
    """
    bits = int(len(weight) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    docs = docs.drop("toxic_score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = utf8(batch.column(text))
            logit = np.full(len(texts), float(w[-1]))
            for lo, hi in blocks(texts):
                at, doc = features(texts[lo:hi], bits)
                used = np.flatnonzero(w[at])
                pair = np.unique(doc[used] << bits | at[used])
                logit[lo:hi] += np.bincount(pair >> bits, weights=w[pair & ((1 << bits) - 1)], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "toxic_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxic_score", "double"))
