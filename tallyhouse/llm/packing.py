"""Packing token pieces into sequences by vector best-fit.

A bin (a sequence) has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed by decreasing size; among the bins that can take a piece under every capacity,
the one whose weighted residual after placement has the least norm (or whose residual has the largest
weighted dot product with the piece) gets it; otherwise a new bin opens.

Pieces are dealt to groups of a bounded number of tokens by a salted round, so no group depends on a key;
each group is packed on its own. A group leaves at most a few bins unfilled, out of thousands.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import U64, blocks, byte_table, joined, keeps, mix, span_hash, stored, tidy, utf8, words

#: What a chunk may not hold to be lower-cased and cut here. Chunks end at blanks, tabs and line ends only;
#: whatever else a tokenizer takes as white space stays inside a chunk.
_OTHER = re.compile("[^\x20-\x7e\xa1-\u012f\u0131-\u017f]")


@dataclass(frozen=True)
class PackParams:
    """tokens, documents, attention: a sequence's capacities. weights: of the three residuals (as shares of
    capacity). rule: "norm" or "dot". group_bins, group_pieces: expected sequences and pieces of one packing group.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"
    group_bins: int = 4000
    group_pieces: int = 200_000


#: Bytes of the ids and of the places of the table of chunks that a worker keeps, and the longest chunk that gets a place.
WORD_BYTES, CHUNK_BYTES, LONG = 16 << 20, 24 << 20, 256
#: UTF-8 bytes of the texts that are encoded together.
AT_ONCE = 1 << 19
#: What a chunk ends at; END stands between texts.
_BLANK = byte_table(b"\x20\x09\x0a\x0d\xff")


class _Table:
    """Ids of chunks in arrays of bounded bytes, looked up many at once; it begins anew when it is full.

    A chunk is known by a 64-bit hash of its bytes and a 32-bit one of its first eight.
    """

    def __init__(self, id_bytes: int, place_bytes: int) -> None:
        self.size = max(8, place_bytes // 17)
        self.key, self.check = np.zeros(self.size, U64), np.zeros(self.size, np.uint32)
        self.at, self.n = np.zeros(self.size, np.uint32), np.zeros(self.size, np.uint8)
        self.ids = np.zeros(id_bytes // 2, np.uint16)
        self.used = self.count = 0

    @property
    def held(self) -> int:
        """Bytes of the places that are taken."""
        return 17 * self.count

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of each chunk that is kept."""
        return (self.ids[self.at[i] : int(self.at[i]) + int(self.n[i])] for i in np.flatnonzero(self.key))

    def _first(self, key: np.ndarray) -> np.ndarray:
        return ((key >> U64(32)) * U64(self.size) >> U64(32)).astype(np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each chunk, -1 if it has none."""
        at = self._first(key)
        own = self.key[at]
        hit = (own == key) & (self.check[at] == check)
        found = np.where(hit, at, -1)
        left = np.flatnonzero((own != 0) & ~hit)
        while len(left):
            at[left] = (at[left] + 1) % self.size
            own = self.key[at[left]]
            hit = (own == key[left]) & (self.check[at[left]] == check[left])
            found[left[hit]] = at[left[hit]]
            left = left[(own != 0) & ~hit]
        return found

    def add(self, key: np.ndarray, check: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Take in different chunks that have no place; ``ids``: one chunk's after the other's."""
        if 3 * len(n) > 2 * self.size or len(ids) > len(self.ids):
            return
        if 3 * (self.count + len(n)) > 2 * self.size or self.used + len(ids) > len(self.ids):
            self.key[:] = 0
            self.used = self.count = 0
        self.ids[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(n) - n
        at, left = self._first(key), np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] == 0]
            free = free[np.unique(at[free], return_index=True)[1]]
            to = at[free]
            self.key[to], self.check[to], self.at[to], self.n[to] = key[free], check[free], start[free], n[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            at[left] = (at[left] + 1) % self.size
        self.used, self.count = self.used + len(ids), self.count + len(n)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the spans, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class ChunkTokenizer:
    """Token ids of whole texts by a lower-casing byte-level BPE that drops white space, a distinct chunk at a time.

    Chunks between blanks are encoded once and remembered, within WORD_BYTES and CHUNK_BYTES. Those of Latin letters and
    printable ASCII, whose normal form is just their lower case, go word by word to the tokenizer's BPE model, cut by
    the tokenizer's own pattern; all others, and chunks that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, word_bytes: int = WORD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        steps = json.loads(self.encoder.pre_tokenizer.__getstate__())["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"] + "| ").findall
        # bytes as the byte-level alphabet writes them: printable ones as themselves, others from code point 256
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in own else next(rest) for b in range(256)} | {32: 32}
        self.chunks = _Table(word_bytes, chunk_bytes)
        span_hash(np.zeros(1, np.uint8), np.array([0]), np.array([1]))  # its powers are made here, once

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        """Ids of different chunks; each of printable characters has a word, so that words stand one blank apart, chunks three."""
        whole = "".join(chunks)
        odd = [bool(_OTHER.search(c) or "<|" in c) for c in chunks] if _OTHER.search(whole) or "<|" in whole else [False] * len(chunks)
        text = " ".join(self.words(" ".join([c for c, o in zip(chunks, odd) if not o]).lower()))
        text = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        tokenize, plain = self.model.tokenize, iter(text.split("   ") if text else ())
        made = [self.encoder.encode(c, add_special_tokens=False).ids if o else [t.id for word in next(plain).split(" ") for t in tokenize(word)] for c, o in zip(chunks, odd)]
        if next(plain, None) is not None:
            raise ValueError("a chunk without a word among printable ones")
        return made

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        texts = [t.decode("utf-8", "replace").encode() if b"\xff" in t else t for t in texts]
        data, ends = joined(texts)
        start, stop, doc = words(data, ends, _BLANK)
        if not len(start):
            return [b""] * len(texts)
        key = span_hash(data, start, stop) | U64(1)
        eight = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))[start]
        short = np.minimum(stop - start, 8).astype(U64)
        check = (mix(eight << (U64(8) * (U64(8) - short))) >> U64(32)).astype(np.uint32)
        at = self.chunks.find(key, check)
        new = at < 0
        n = self.chunks.n[at].astype(np.int64)
        _, first, own = np.unique(key[new], return_index=True, return_inverse=True)
        lone = np.flatnonzero(new)[first]
        raw = data.tobytes()
        made = self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[lone].tolist(), stop[lone].tolist())])
        n_made = np.fromiter(map(len, made), np.int64, len(made))
        ids_made = np.fromiter(itertools.chain.from_iterable(made), np.uint32, n_made.sum())
        n[new] = n_made[own]
        edge = np.cumsum(n)
        out, of_new = np.empty(edge[-1], "<u4"), np.repeat(new, n)
        out[~of_new] = self.chunks.ids[_spans(self.chunks.at[at[~new]].astype(np.int64), n[~new])]
        out[of_new] = ids_made[_spans((np.cumsum(n_made) - n_made)[own], n[new])]
        kept = (n_made < 256) & (stop[lone] - start[lone] <= LONG)
        self.chunks.add(key[lone[kept]], check[lone[kept]], n_made[kept], ids_made[np.repeat(kept, n_made)])
        cut = 4 * np.append(0, edge)[np.searchsorted(doc, np.arange(len(texts) + 1))]
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text.encode()])[0]


@functools.lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer a Python worker, so that the tasks it runs one after the other share its table of chunks."""
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: Callable[[], ChunkTokenizer], end_id: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids plus ``end_id``, cut every ``most``.

    A null text is empty and so has the one id ``end_id``. Rows with a null or repeated id are documents
    of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("packing", shared_tokenizer.cache_clear)
        encoder, end, step = tokenizer(), np.array([end_id], "<u4").tobytes(), 4 * most
        for batch in batches:
            texts, numbers = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            made = itertools.chain.from_iterable(encoder.encode_all(texts[lo:hi]) for lo, hi in blocks(texts, AT_ONCE))
            rows: list[tuple] = []
            for no, ids in zip(numbers, made):
                ids += end
                rows += [(no, k, at // 4, (min(len(ids), at + step) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; pieces are taken longest first, ties in the given order.

    Bins of equal residuals are interchangeable, so the choice is among the distinct residual states of
    the open bins; among the bins of a state, the one that came to it last is taken.
    """
    cap = np.array([p.tokens, p.documents, p.attention], float)
    scale = np.array(p.weights) / cap**2
    bin_of, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    room, states, held = np.empty((3, 64)), [], []  # residuals of each state, the same as tuples, and the state's bins
    place: dict[tuple[int, int, int], int] = {}
    n_bins, least = 0, int(length.min()) if len(length) else 0
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        need = np.array([size, 1.0, float(size) * size])
        after = room[:, : len(held)] - need[:, None]
        fits = (after[0] >= 0) & (after[1] >= 0) & (after[2] >= 0)
        if not fits.any():
            state, number = (p.tokens, p.documents, p.attention), n_bins
            n_bins += 1
        else:
            if p.rule == "dot":
                at = int(np.where(fits, (scale * need) @ room[:, : len(held)], -np.inf).argmax())
            else:
                after *= after
                at = int(np.where(fits, scale @ after, np.inf).argmin())
            state, number = states[at], held[at].pop()
            if not held[at]:  # the last state takes the place of the empty one
                del place[state]
                last, bins = states.pop(), held.pop()
                if at < len(held):
                    states[at], held[at], room[:, at] = last, bins, room[:, len(held)]
                    place[last] = at
        bin_of[i], offset[i] = number, p.tokens - state[0]
        left = (state[0] - size, state[1] - 1, state[2] - size * size)
        if left[0] >= least and left[1] >= 1 and left[2] >= least * least:
            at = place.setdefault(left, len(held))
            if at == len(held):
                if at == room.shape[1]:
                    room = np.concatenate([room, np.empty_like(room)], axis=1)
                room[:, at] = left
                states.append(left)
                held.append([])
            held[at].append(number)
    return bin_of, offset


def pack(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Add sequence_id and offset to every piece; ``pieces`` has a column length of at most ``tokens``.

    Pieces that fill a sequence on their own are given one directly. An empty table gives an empty result.
    Input columns named sequence_id or offset are replaced; every other column passes through.
    """
    p = params
    if int(p.tokens) ** 2 > p.attention:
        raise ValueError("attention must let the longest piece in")
    numbered = stored(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    short = numbered.where(F.col("length") < p.tokens).select("_row", "length")
    total, count = short.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, round(total / p.tokens / p.group_bins), round(count / p.group_pieces))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row")
        bins, at = best_fit(group["length"].to_numpy(), p)
        return pd.DataFrame({"_row": group["_row"], "sequence_id": bins * groups + int(group["_group"].iloc[0]), "offset": at})

    placed = dealt.groupBy("_group").applyInPandas(run, "_row long, sequence_id long, offset long")
    alone = numbered.where(F.col("length") >= p.tokens).select("_row", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.join(placed.union(alone), "_row").drop("_row")
