"""SentencePiece encoding and decoding by a distinct-chunk table.

When no piece of a model holds the white-space marker after another character, pieces cannot cross into
the next marked word. A text is then cut before each run of markers. Spark counts the distinct marked words
of all texts and keeps the most frequent ones; each of these is segmented once, in a table, and its ids are
put back by position wherever it stands. The table is bounded, so it is sent to every task; a word outside
it is rare, and is segmented where it stands, once for the tasks that one worker runs. Joining those by
position too would move the texts through a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.llm.common import keeps, stored, table_bytes, utf8

MARK = "▁"
_WORDS = re.compile(" *[^ ]+| +")
#: Distinct words that a counting task holds before it hands its counts on.
HELD = 500_000
#: Longer words are rare (text without blanks): they get no entry in any table and are segmented where they stand.
LONG = 64
#: Bytes of the rare words that a worker remembers, and what an entry takes beside its texts.
RARE_BYTES, _ENTRY = 96 << 20, 300
#: Most bytes of the table that is sent to every task.
TABLE_BYTES = 128 << 20


class ChunkPieces:
    """Exact encode and decode of whole texts for a model of marked words; ``most``: bytes of rare chunks remembered."""

    def __init__(self, path: str, most: int = RARE_BYTES) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        # a lone blank has no text behind the model's own marker, so encode() would drop it
        self.blank = {" ": (np.array([self.model.piece_to_id(MARK)], "<u4").tobytes(), " ")}
        self.known: dict[str, tuple[bytes, str]] = dict(self.blank)
        self.held = 0
        self.separable = not any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(len(self.model)))

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text: the model puts one marker before it; a literal marker counts as a blank."""
        return _WORDS.findall(" " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> Iterator[tuple[str, bytes, str]]:
        """(chunk, ids, decoded text) of each chunk but a lone blank."""
        for lo in range(0, len(chunks), 20_000):
            part = chunks[lo : lo + 20_000]
            ids = self.model.encode([c[1:] if c[0] == " " else c for c in part], num_threads=1)
            back = self.model.decode(ids, num_threads=1)
            for c, i, b in zip(part, ids, back):
                yield c, np.array(i, "<u4").tobytes(), " " + b

    def encode(self, texts: list[str], table: dict[str, tuple[bytes, str]] | None = None) -> list[tuple[bytes, str]]:
        """Ids (begin and end included, little-endian unsigned 32-bit) and decoded text of each text.

        ``table``: chunks that are segmented already.
        """
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        if not self.separable:
            ids = self.model.encode(texts, num_threads=1)
            return [(begin + np.array(i, "<u4").tobytes() + end, self.model.decode([self.model.bos_id(), *i, self.model.eos_id()])) for i in ids]
        table = table or {}
        chunks = [self.chunks(t) for t in texts]
        rare = {c for one in chunks for c in one if c not in table}
        if self.held > self.most:
            self.known, self.held = dict(self.blank), 0
        once = {}  # long chunks are forgotten with this batch
        for c, i, b in self.segment([c for c in rare if c not in self.known]):
            if len(c) > LONG:
                once[c] = (i, b)
            else:
                self.known[c] = (i, b)
                self.held += _ENTRY + 2 * len(c) + len(i)
        known, get = self.known, table.get
        out = []
        for one in chunks:
            found = [get(c) or known.get(c) or once[c] for c in one]
            out.append((begin + b"".join([f[0] for f in found]) + end, "".join([f[1] for f in found])[1:]))
        return out


@functools.lru_cache(maxsize=1)
def shared_pieces(path: str) -> ChunkPieces:
    """One coder a Python worker, so that the tasks it runs one after the other share their rare chunks."""
    return ChunkPieces(path)


def chunk_table(docs: DataFrame, model_path: str, most: int = 300_000, text: str = "text") -> DataFrame:
    """(chunk, ids, decoded): the most frequent marked words of all texts, at most ``most``, each segmented once.

    A word that no task meets twice before it hands its counts on is left out as rare; which words are in the
    table never changes a result. A model whose pieces cross words, or an empty table: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("pieces", shared_pieces.cache_clear)
        coder, held = shared_pieces(model_path), Counter()

        def told() -> pa.RecordBatch:
            often = [(c, n) for c, n in held.items() if n > 1 and c != " "]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["chunk", "n"])

        if not coder.separable:
            return
        for batch in batches:
            for t in utf8(batch.column("text")):
                held.update([c for c in coder.chunks(t.decode("utf-8", "replace")) if len(c) <= LONG])
                if len(held) > HELD:
                    yield told()
        yield told()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_pieces(model_path)
        for batch in batches:
            rows = list(coder.segment(batch.column("chunk").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["chunk", "ids", "decoded"])

    counted = stored(docs.select(F.col(text).alias("text")).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")))
    rank = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, 1 << 30
    for r in counted.groupBy(rank.alias("r")).count().orderBy(F.desc("r")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["r"]
    return stored(counted.where(rank >= least).select("chunk").mapInArrow(segment, "chunk string, ids binary, decoded string"))


def _coded(docs: DataFrame, model_path: str, text: str, made: Callable[[list[tuple[bytes, str]]], list[pa.Array]], fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and what ``made`` makes of each row's ids and decoded text."""
    table = chunk_table(docs, model_path, text=text)
    while table_bytes(table) > TABLE_BYTES:  # very long words: a smaller table of the same kind
        table = stored(table.where(F.pmod(F.xxhash64("chunk"), F.lit(2)) == 0))
    rows = table.toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast({c: (i, b) for c, i, b in zip(rows["chunk"], rows["ids"], rows["decoded"])})
    source = docs.select(*keep, F.col(text).alias("_piece_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("pieces", shared_pieces.cache_clear)
        coder = shared_pieces(model_path)
        for batch in batches:
            found = coder.encode([t.decode("utf-8", "replace") for t in utf8(batch.column("_piece_text"))], shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made(found)], names=[*keep, *(n for n, _ in fields)])

    schema = StructType([docs.schema[c] for c in keep])
    for name, kind in fields:
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def piece_codes(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ids (binary, little-endian unsigned 32-bit, begin and end included), n_tokens and decoded.

    A null text counts as empty and has the two ids of begin and end. Texts are encoded whole and stay where
    they are; repeated rows give equal results; input columns of these names are replaced.
    """
    made = lambda found: [pa.array([f[0] for f in found], pa.binary()), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())]
    fields = [("ids", "binary"), ("n_tokens", "long"), ("decoded", "string")]
    return _coded(docs, model_path, text, made, fields, [c for c in docs.columns if c not in {n for n, _ in fields}])


def piece_digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: piece_codes, hashed where they are made."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    made = lambda found: [pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([sha(f[0]) for f in found], pa.string()), pa.array([sha(f[1].encode()) for f in found], pa.string())]
    return _coded(docs, model_path, text, made, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], [doc_id])
