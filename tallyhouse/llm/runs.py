"""Periodic runs of words, by recompression.

A run of period p and at least ``times * p`` words holds ``times`` neighbouring points of the grid 0, p, 2p, ...
whose words are equal; such points, over all p, are the candidates (a harmonic sum, n log n points a text). Each is
extended to both sides by longest common extensions of (i, i + p), which a run-length grammar answers exactly.

The grammar is made by recompression: in turn, maximal blocks of one symbol and then pairs of a left and a right
symbol become symbols of the next level. Equal stretches are cut alike but for their ends, so an extension climbs
while both sides are at starts of equal symbols, and then goes down to the word where they differ: O(1) steps a level.
The texts of a batch share one grammar a direction, with separators that occur once; all queries climb together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import U64, blocks, mix, utf8

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
#: Texts of up to so many words share one table of grid points.
GRID_WORDS = 1 << 16
#: Extensions that one numpy pass answers.
QUERIES = 1 << 18


@dataclass(frozen=True)
class RunParams:
    """least: words of a run; times: how often its period has to fit, 2 at least."""

    least: int = 6
    times: int = 4


class Grammar:
    """Run-length grammar of a sequence whose first and last symbols occur once; levels are made when first asked for.

    Level k: its symbols, the kind of what level k+1 joins, the phrase of every place, and the start of every phrase
    (with the length of the level at the end).
    """

    def __init__(self, symbols: np.ndarray):
        self._levels: list[tuple[np.ndarray, bool, np.ndarray, np.ndarray]] = []
        self._next = symbols.astype(np.int64)

    def level(self, k: int) -> tuple[np.ndarray, bool, np.ndarray, np.ndarray]:
        while len(self._levels) <= k:
            self._compress()
        return self._levels[k]

    def _compress(self) -> None:
        s, blockwise = self._next, len(self._levels) % 2 == 0
        joins = np.zeros(len(s), bool)  # a place that belongs to the phrase of the place before it
        if blockwise:
            joins[1:] = s[1:] == s[:-1]
        else:
            side = (mix(s.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(len(self._levels))) & U64(1)).astype(bool)
            one, two = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
            joins[1:] = one if one.sum() >= two.sum() else two
        starts = np.flatnonzero(~joins)
        ends = np.append(starts[1:], len(s))
        made = np.flatnonzero(ends - starts > 1)
        names = s[starts]
        if len(made):
            second = (ends - starts)[made] if blockwise else s[starts[made] + 1]
            names[made] = s.max() + 1 + np.unique((names[made] << 32) | second, return_inverse=True)[1].ravel()
        self._levels.append((s, blockwise, (np.cumsum(~joins) - 1).astype(np.int32), np.append(starts, len(s)).astype(np.int32)))
        if len(self._levels) % 8 == 0:
            names = np.unique(names, return_inverse=True)[1].ravel()  # keeps the names below 2^31
        self._next = names

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, for arrays of places i != j."""
        at, to, fell = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        live, k = np.arange(len(i)), 0
        while len(live):
            s, blockwise, phrase, start = self.level(k)
            a, b = at[live], to[live]
            same = s[a] == s[b]
            inside = same & ((start[phrase[a]] != a) | (start[phrase[b]] != b))
            step = np.minimum(start[phrase[a] + 1] - a, start[phrase[b] + 1] - b) if blockwise else 1
            a, b = a + np.where(inside, step, 0), b + np.where(inside, step, 0)
            same = s[a] == s[b]
            up = same & (start[phrase[a]] == a) & (start[phrase[b]] == b)
            at[live], to[live] = np.where(up, phrase[a], a), np.where(up, phrase[b], b)
            fell[live] = k
            live, k = live[up], k + 1
        for k in range(int(fell.max(initial=0)) - 1, -1, -1):
            s, blockwise, phrase, start = self.level(k)
            some = np.flatnonzero(fell > k)
            a, b = start[at[some]].astype(np.int64), start[to[some]].astype(np.int64)
            step = np.minimum(start[phrase[a] + 1] - a, start[phrase[b] + 1] - b) if blockwise else 1
            more = np.where(s[a] == s[b], step, 0)
            at[some], to[some] = a + more, b + more
        return at - i


@lru_cache(maxsize=4)
def _grid(words: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (place, period) whose last grid point is below ``words``, ascending by that point, and these points."""
    periods = np.arange(1, max(1, (words - 1) // (times - 1)) + 1)
    each = np.maximum(0, (words - 1 - (times - 1) * periods) // periods + 1)
    p = np.repeat(periods, each)
    i = (np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)) * p
    last = i + (times - 1) * p
    order = np.argsort(last, kind="stable")
    return i[order].astype(np.int32), p[order].astype(np.int32), last[order].astype(np.int32)


def candidates(ids: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid points from which ``times`` points in a row hold equal words."""
    n = len(ids)
    if n > GRID_WORDS:
        every = [np.zeros((2, 0), np.int64)]
        for p in range(1, n // times + 1):
            points = ids[::p]
            equal = points[1:] == points[:-1]
            row = equal[: len(equal) - times + 2].copy()
            for k in range(1, times - 1):
                row &= equal[k : len(equal) - times + 2 + k]
            at = np.flatnonzero(row)
            if len(at):
                every.append(np.stack([at * p, np.full(len(at), p)]))
        return tuple(np.concatenate(every, axis=1))
    i, p, last = _grid(1 << max(4, (n - 1).bit_length()), times)
    upto = int(np.searchsorted(last, n))
    i, p = i[:upto], p[:upto]
    for k in range(times - 1):
        keep = np.flatnonzero(ids[i + k * p] == ids[i + (k + 1) * p])
        i, p = i[keep], p[keep]
    return i, p


def runs_of(texts: list[np.ndarray], params: RunParams) -> list[np.ndarray]:
    """For every text, given as word ids from 0 on, its runs (start, length, period), by start and period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    found = [(k, *candidates(t, params.times)) for k, t in enumerate(texts) if len(t) >= max(params.least, params.times)]
    found = [f for f in found if len(f[1])]
    if not found:
        return out
    largest = max(int(texts[k].max()) for k, _, _ in found)
    joined, begins, at = [np.array([largest + 1])], [], 1
    for no, (k, _, _) in enumerate(found):
        begins.append(at)
        joined += [texts[k], np.array([largest + 2 + no])]
        at += len(texts[k]) + 1
    symbols = np.concatenate(joined)
    left = np.concatenate([i.astype(np.int64) + b for (_, i, _), b in zip(found, begins, strict=True)])
    period = np.concatenate([p.astype(np.int64) for _, _, p in found])
    ahead, behind, n = Grammar(symbols), Grammar(symbols[::-1]), len(symbols)
    runs = []
    for lo in range(0, len(left), QUERIES):
        i, p = left[lo : lo + QUERIES], period[lo : lo + QUERIES]
        begin = i - behind.extension(n - i, n - i - p)
        length = i + p + ahead.extension(i, i + p) - begin
        keep = length >= np.maximum(params.least, params.times * p)
        runs.append(np.unique(np.stack([begin, length, p], axis=1)[keep], axis=0))
    runs = np.unique(np.concatenate(runs), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of equal stretches the least period
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], [*begins, n])
    for (k, _, _), b, lo, hi in zip(found, begins, cuts, cuts[1:], strict=False):
        out[k] = runs[lo:hi] - np.array([b, 0, 0])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, but those that stand in a run behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", params: RunParams | None = None) -> DataFrame:
    """``docs`` without its text, with runs (start, length, period; by start, then period) and collapsed.

    Words are stretches of characters other than ASCII white space, taken from whole texts, and counted from 0. A run
    is a stretch with least period q, at least max(least, times * q) words, that cannot be extended with period q;
    collapsed keeps one period of each, words joined by one space. A null text has no words. Rows are handled each by
    itself: repeated rows and equal ids stay; columns named runs or collapsed are replaced; an empty table stays empty.
    """
    params = params or RunParams()
    kept = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows = docs.select(*kept, F.col(text).alias("collapsed"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"runs {RUNS}", "collapsed string"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(batch.num_columns - 1))
            for lo, hi in blocks(texts):
                number: dict = defaultdict(count().__next__)
                split = [t.split() for t in texts[lo:hi]]
                ids = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in split]
                found = runs_of(ids, params)
                values = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(values[:, c]) for c in range(3)], fields=list(_RUNS.value_type))
                short = pa.array([collapsed(w, r) for w, r in zip(split, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), struct), short], [*kept, "runs", "collapsed"])

    return rows.mapInArrow(find, schema)
