"""Near-duplicate classes by ProbMinHash signatures, banding, exact verification and components.

A text is its five-word shingles with weights. Every shingle draws arrival times from a Poisson process
whose rate is its weight; each arrival goes to one of the signature's registers, and a register keeps the
shingle that arrived there first. Drawing ends for a shingle as soon as its next arrival is later than
every register's. Two texts agree in a register with the probability Jaccard of their weights. The same
measure is verified: with weights of one (``weighted`` off) it is the Jaccard similarity of the shingle
sets; with ``weighted`` on, a shingle weighs as often as it occurs.

Texts that agree on all registers of some band are candidates. Candidates are verified on whole shingles,
never on signatures; only pairs that exact bounds rule out are skipped. Within one band value, texts are
first compared with a hub (the text that shares most band values with others), so that a large group of
near copies costs one comparison a text. Only where a band value still holds several classes are the
remaining pairs compared, in blocks, and of those only links between different classes are emitted; no
link that could join two classes is lost. Rows of hot band values, hubs and copied texts are spread over
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import LOWER, U64, blocks, hot_keys, joined, mix, small, span_hash, spread_join, stored, tidy, utf8, words


@dataclass(frozen=True)
class NearDupParams:
    """shingle: words. threshold: least similarity. weighted: shingles weigh as often as they occur, else one
    each. bands x rows: registers of a signature; a pair at the threshold is missed with probability
    (1 - threshold^rows)^bands, 5e-5 here. block: texts compared at once. a_hub: pairs of one hub in a task.
    """

    shingle: int = 5
    threshold: float = 0.8
    weighted: bool = False
    bands: int = 25
    rows: int = 5
    block: int = 256
    a_hub: int = 500


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, the document index of each (ascending) and its count in the document.

    Words are separated by ASCII white space and compared with A-Z lower-cased. A text of fewer words
    than a shingle has one shingle of all its words; one without words has none.
    """
    data, ends = joined(texts)
    start, stop, doc = words(data, ends)
    word = span_hash(LOWER[data], start, stop)
    n = len(word)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    code, full = np.zeros(n, U64), np.ones(n, bool)
    for i in range(size):
        m = max(0, n - i)
        there = np.zeros(n, bool)
        there[:m] = doc[n - m :] == doc[:m]
        code[:m] += np.where(there[:m], mix(word[n - m :] + U64(i * 2 + 1)), U64(0))
        full &= there
    whole = np.bincount(doc, minlength=len(texts)) < size
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    use = full | (whole[doc] & first)
    code, doc = mix(code[use]), doc[use]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
    return code[new], doc[new], np.diff(new, append=len(code))


def signatures(code: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, uint32[n_docs, registers]; documents without elements keep zeros.

    Round r draws the r-th arrival of every element that is still early enough for some register.
    """
    first = np.full(n_docs * registers, np.inf)
    out = np.zeros(n_docs * registers, np.uint32)
    label = (code >> U64(32)).astype(np.uint32)
    state, at = code, np.zeros(len(code))
    live = np.arange(len(code))
    while len(live):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> U64(11)).astype(np.float64) + 1.0) / 9007199254740993.0) / weight[live]
        cell = doc[live] * registers + (mix(state) % U64(registers)).astype(np.int64)
        np.minimum.at(first, cell, at)
        won = first[cell] == at
        out[cell[won]] = label[live[won]]
        last = first.reshape(n_docs, registers).max(axis=1)
        go_on = at < last[doc[live]]
        live, state, at = live[go_on], state[go_on], at[go_on]
    return out.reshape(n_docs, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two packed shingle arrays: codes above, counts in the low 16 bits, both sorted."""
    code = np.union1d(a >> U64(16), b >> U64(16))
    x, y = np.zeros(len(code)), np.zeros(len(code))
    x[np.searchsorted(code, a >> U64(16))] = (a & U64(0xFFFF)).astype(float)
    y[np.searchsorted(code, b >> U64(16))] = (b & U64(0xFFFF)).astype(float)
    ratio = np.where(x > 0, y / np.maximum(x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below, above = np.cumsum(x)[upto - 1], y.sum() - np.cumsum(y)[upto - 1]
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, class_id): the least id of each id's component, for the ids in ``links``.

    Every round each node points to the first of its neighbours and itself, in an order that changes with
    the round (most links first and random in turn), follows that pointer once, and merges. Chains and
    stars alike shrink by a constant factor, so rounds grow with the logarithm of the longest chain, in any
    order of ids. Links inside a class are dropped, so later rounds are small; each round is a written table.
    """
    ids = links.select(F.col(a).alias("id")).union(links.select(F.col(b).alias("id"))).distinct()
    label = stored(ids.withColumn("node", F.col("id")))
    edges = stored(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        degree = stored(both.groupBy("u").agg(F.count("*").alias("n")))
        hot = hot_keys(degree, "u", "n")
        first = F.struct(*([-F.col("n")] if turn % 2 == 0 else []), F.xxhash64("u", F.lit(turn)).alias("h"), F.col("u").alias("node"))
        rank = stored(degree.select("u", first.alias("rank")))
        met = spread_join(both.withColumnsRenamed({"u": "w"}).withColumnsRenamed({"v": "u"}), rank, "u", hot)
        least = met.groupBy(F.col("w").alias("u")).agg(F.min("rank").alias("best")).join(rank, "u")
        step = stored(least.select("u", F.least("best", "rank").getField("node").alias("up")))
        hub = stored(step.groupBy("up").agg(F.count("*").alias("n")))
        jump = spread_join(step, step.select(F.col("u").alias("up"), F.col("up").alias("top")), "up", hot_keys(hub, "up", "n"))
        top = stored(jump.select(F.col("u").alias("node"), "top"))
        sizes = stored(label.groupBy("node").agg(F.count("*").alias("n")).join(top, "node"))
        moved = spread_join(label, sizes.select("node", "top"), "node", hot_keys(sizes, "node", "n")).select("id", F.col("top").alias("node"))
        label = stored(moved.unionByName(label.join(sizes.select("node"), "node", "left_anti").select("id", "node")))
        ends = spread_join(edges, top.select(F.col("node").alias("u"), F.col("top").alias("x")), "u", hot)
        ends = spread_join(ends, top.select(F.col("node").alias("v"), F.col("top").alias("y")), "v", hot.withColumnRenamed("u", "v"))
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        turn += 1
    least = stored(label.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    return spread_join(label, least.select("node", "class_id"), "node", hot_keys(least, "node", "n")).select("id", "class_id")


def _signed(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, keys): band values of each text that has a word."""
    registers = p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column("id").to_numpy(), utf8(batch.column("text"))
            for lo, hi in blocks(all_texts):
                code, doc, count = shingles(all_texts[lo:hi], p.shingle)
                sig = signatures(code, doc, np.minimum(count, 65535).astype(float) if p.weighted else np.ones(len(code)), hi - lo, registers)
                key = np.zeros((hi - lo, p.bands), U64)
                for r in range(p.rows):
                    key = mix(key + sig[:, r :: p.rows] + U64(r))
                key = mix(key + np.arange(p.bands, dtype=U64)[None, :])
                use = np.bincount(doc, minlength=hi - lo) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(use.sum() + 1, dtype=np.int32) * p.bands), pa.array(key[use].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][use]), lists], names=["id", "keys"])

    return texts.mapInArrow(tidy(run), "id long, keys array<long>")


def _sets(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, set, size): each text's sorted shingles as packed 64-bit values, and how many there are.

    A value holds 48 bits of the shingle's hash and its count (one if unweighted).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column("id").to_numpy(), utf8(batch.column("text"))
            for lo, hi in blocks(all_texts):
                code, doc, count = shingles(all_texts[lo:hi], p.shingle)
                packed = (code >> U64(16) << U64(16)) | (np.minimum(count, 65535).astype(U64) if p.weighted else U64(1))
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [packed[cut[i] : cut[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.size for x in sets], pa.int64())], names=["id", "set", "size"])

    return texts.mapInArrow(tidy(run), "id long, set binary, size long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Those of the distinct pairs (id, hub) that are similar enough, as (a, b).

    A hub's shingles are sent once for every ``a_hub`` of its pairs, so a hub of many texts keeps many tasks busy.
    """

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(i: bytes, j: bytes) -> bool:
            a, b = np.frombuffer(i, U64), np.frombuffer(j, U64)
            if p.weighted:
                return similarity(a, b) >= p.threshold
            n = _shared(a, b)
            return n >= p.threshold * (len(a) + len(b) - n)

        return pd.Series([one(i, j) for i, j in zip(x, y)], dtype=bool)

    parts = stored(pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / p.a_hub)))
    busy = hot_keys(parts, "hub", "n", least=p.a_hub)
    dealt = pairs.join(F.broadcast(parts.join(busy, "hub", "left_semi").select("hub", "parts")), "hub", "left")
    dealt = dealt.select("id", "hub", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part"))
    hubs = sets.join(parts.withColumnRenamed("hub", "id"), "id").join(busy.select(F.col("hub").alias("id"), F.lit(True).alias("busy")), "id", "left")
    hubs = hubs.select(F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("busy"), F.col("parts") - 1).otherwise(0))).alias("part"), F.col("set").alias("y"))
    met = dealt.join(sets.select("id", F.col("set").alias("x")), "id").join(hubs, ["hub", "part"])
    return met.where(near("x", "y")).select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _links_in_blocks(mixed: DataFrame, p: NearDupParams) -> DataFrame:
    """Links between different classes among texts of one band value, compared block by block.

    ``mixed``: band, band_no, n, id, class_id, keys, set. A block of texts meets itself and every later
    block of its band value: at most two blocks come together, and a task takes such groups one after the
    other. A pair is looked at for the first band value that it shares. Sets are compared only if their
    sizes, and their counts of shingles by 64 ranges of the hash, leave the threshold within reach: both
    bounds are exact.
    """
    place = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    sized = mixed.withColumn("n_blocks", F.ceil(F.col("n") / p.block)).withColumn("block", place)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = sized.select("band", "band_no", "id", "class_id", "keys", "set", "block", other)
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    names = ["band", "x", "y", "block", "band_no", "id", "class_id"]

    def links(g: dict[str, np.ndarray], sets: list[np.ndarray], ranges: np.ndarray) -> list[tuple[int, int]]:
        ids, cls, keys, band, low = g["id"], g["class_id"], g["keys"], int(g["band_no"][0]), g["x"][0]
        size = np.array([len(x) for x in sets])
        own = g["block"] == low
        alone = g["x"][0] == g["y"][0]
        top: dict[int, int] = {}
        found = []

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for i in np.flatnonzero(own).tolist():
            ok = (cls != cls[i]) & (ids > ids[i] if alone else ~own)
            if not p.weighted:
                other = np.flatnonzero(ok)
                most = np.minimum(ranges[other], ranges[i]).sum(axis=1)
                ok[other] = most >= p.threshold * (size[other] + size[i] - most)
            other = np.flatnonzero(ok)
            for j in other[(keys[other] == keys[i]).argmax(axis=1) == band].tolist():
                a, b = find(int(cls[i])), find(int(cls[j]))
                if a == b:
                    continue
                n = 0 if p.weighted else _shared(sets[i], sets[j])
                if similarity(sets[i], sets[j]) >= p.threshold if p.weighted else n >= p.threshold * (size[i] + size[j] - n):
                    top[a] = b
                    found.append((int(ids[i]), int(ids[j])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        kept: list[bytes] = []
        for batch in _and_end(batches):
            if batch is not None:
                new = {c: batch.column(c).to_numpy() for c in names}
                new["keys"] = np.stack(batch.column("keys").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, p.bands), np.int64)
                held = {c: np.concatenate([held[c], v]) for c, v in new.items()} if held else new
                kept += batch.column("set").to_pylist()
            n = len(kept)
            if not n:
                continue
            key = np.stack([held[c] for c in ("band", "x", "y")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edge = np.concatenate([[0], edge, [n] if batch is None else []]).astype(np.int64)
            sets = [np.frombuffer(x, U64) for x in kept[: edge[-1]]]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            flat = np.concatenate([*sets, np.zeros(0, U64)])
            ranges = np.bincount(row * 64 + (flat >> U64(58)).astype(np.int64), minlength=64 * len(sets)).reshape(-1, 64).astype(np.int32)
            found = []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                found += links({c: v[lo:hi] for c, v in held.items()}, sets[lo:hi], ranges[lo:hi])
            held, kept = {c: v[edge[-1] :] for c, v in held.items()}, kept[edge[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").select(*names, "keys", "set").mapInArrow(tidy(run), "a long, b long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _linked(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b): links between the near texts of ``texts`` (id, text), enough of them to join every class."""
    signed = stored(_signed(texts, p))
    bands = signed.select("id", F.posexplode("keys").alias("band_no", "band"))
    sizes = stored(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(sizes, "band", "n")
    member = stored(spread_join(bands, sizes, "band", hot))
    about = stored(member.groupBy("id").agg(F.sum("n").alias("w")))
    sets = stored(_sets(texts.join(small(about.select("id")), "id", "left_semi"), p))
    member = stored(member.join(about, "id").join(sets.select("id", "size"), "id"))
    hubs = member.groupBy("band").agg(F.max_by(F.struct("id", "size"), F.struct("w", -F.col("id"))).alias("hub"))
    hubs = stored(hubs.select("band", F.col("hub.id").alias("hub"), F.col("hub.size").alias("hub_size")))
    starred = stored(spread_join(member.select("id", "band", "band_no", "n", "size"), hubs, "band", hot))
    pairs = starred.where("id <> hub")
    if not p.weighted:  # similarity is at most the smaller size by the larger
        pairs = pairs.where(F.least("size", "hub_size") >= p.threshold * F.greatest("size", "hub_size"))
    near = stored(_verified(stored(pairs.select("id", "hub").distinct()), sets, p))
    label = components(near)
    labelled = stored(starred.join(label, "id", "left").select("band", "band_no", "n", "id", F.coalesce("class_id", "id").alias("class_id")))
    split = stored(labelled.groupBy("band").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("band"))
    mixed = stored(spread_join(labelled, split, "band", hot))
    late = _links_in_blocks(mixed.join(signed, "id").join(sets, "id"), p)
    return stored(near.unionByName(late))


def _classes(docs: DataFrame, doc_id: str, text: str, p: NearDupParams) -> tuple[DataFrame, DataFrame]:
    """(id, h, g, n): distinct pairs of id and text with their rows; (h, g, copies, class_id, keeper) of every text.

    h, g: two hashes of a text. keeper: the (id, h, g) that stands for the class.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    base = base.select("id", "text", *text_hashes(F.col("text")))
    pairs = stored(base.groupBy("id", "h", "g").agg(F.count("*").alias("n")))
    several = stored(pairs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several")))
    # a text is named by the least id that has it, or by its hash if that id has other texts too
    name = F.when(F.col("several"), -1 - F.col("h").bitwiseAND((1 << 63) - 1)).otherwise(F.col("id"))
    groups = pairs.groupBy("h", "g").agg(F.min("id").alias("id"), F.sum("n").alias("copies"), F.count("*").alias("n"))
    groups = stored(groups.join(small(several), "id", "left").select("h", "g", "id", "copies", "n", F.struct("h", "g").alias("hg"), name.alias("node")))
    met = spread_join(pairs.select("id", F.struct("h", "g").alias("hg")), groups.select("hg", F.col("id").alias("owner")), "hg", hot_keys(groups, "hg", "n"))
    copies = stored(met.where("id <> owner").select("id", "hg.h", "hg.g"))
    texts = base.join(small(copies), ["id", "h", "g"], "left_anti").join(small(several), "id", "left").select(name.alias("id"), "text")
    if not pairs.where("n > 1").isEmpty():  # rows that repeat id and text: one of them is signed
        texts = texts.groupBy("id").agg(F.first("text").alias("text"))
    final = components(_linked(texts, p)).withColumnRenamed("class_id", "root")
    rooted = stored(groups.join(final.withColumnRenamed("id", "node"), "node", "left").select("h", "g", "id", "copies", F.coalesce("root", "node").alias("root")))
    keeper = stored(rooted.groupBy("root").agg(F.min(F.struct("id", "h", "g")).alias("keeper"), F.count("*").alias("n")))
    first = keeper.groupBy(F.col("keeper.id").alias("least")).agg(F.min("root").alias("first"))
    named = stored(keeper.join(first, F.col("keeper.id") == F.col("least")).select("root", "keeper", "n", F.when(F.col("root") == F.col("first"), F.col("least")).otherwise(F.col("root")).alias("class_id")))
    classes = spread_join(rooted, named.select("root", "keeper", "class_id"), "root", hot_keys(named, "root", "n"))
    return pairs, stored(classes.select("h", "g", "copies", "class_id", "keeper"))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, h and g; together they name it."""
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")


def _of_text(rows: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """Inner join of rows (with h, g) and columns of their texts' classes, copied texts spread over tasks."""
    keyed = stored(classes.select(F.struct("h", "g").alias("hg"), *columns, F.col("copies").alias("_n")))
    return spread_join(rows.withColumn("hg", F.struct("h", "g")), keyed.drop("_n"), "hg", hot_keys(keyed, "hg", "_n")).drop("hg")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copies, kept.

    class_id is the least doc_id of the class: texts linked by chains of exact copies and of similarities of
    at least ``threshold``. Each row counts by its own text; where one doc_id has texts of several classes,
    all but the first of these get a negative class_id of their own. copies counts the rows with this very
    text. kept is true for exactly one row a class: one with the least doc_id. Equal texts, also empty
    ones, share a class, but texts without words are near no other. A null text or doc_id makes a row a
    class of its own, kept, with its doc_id as class_id. An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(doc_id).cast("long").alias("id"), *text_hashes(F.col(text)), F.col(text).isNull().alias("bare"), F.monotonically_increasing_id().alias("row")))
    _, classes = _classes(docs, doc_id, text, params)
    alone = F.col("id").isNull() | F.col("bare")
    found = stored(_of_text(rows.where(~alone), classes, "copies", "class_id", "keeper"))
    chosen = found.where(F.struct("id", "h", "g") == F.col("keeper")).groupBy("class_id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    marked = found.join(chosen, "row", "left").select(F.col("id").alias(doc_id), "class_id", "copies", F.coalesce("kept", F.lit(False)).alias("kept"))
    return marked.unionByName(rows.where(alone).select(F.col("id").alias(doc_id), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: NearDupParams = NearDupParams()) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns as they are; see near_duplicates.

    Of rows that repeat the kept doc_id and text, the least by its other columns stays.
    """
    pairs, classes = _classes(docs, doc_id, text, params)
    judged = _of_text(pairs, classes, "keeper").select("id", "h", "g", "n", (F.struct("id", "h", "g") == F.col("keeper")).alias("kept"))
    judged = stored(judged.where(~F.col("kept") | (F.col("n") > 1)))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("_doc"), F.col(doc_id).cast("long").alias("id"), *text_hashes(F.col(text)), F.col(text).isNull().alias("_bare"))
    rows = rows.withColumn("h", F.when(~F.col("_bare"), F.col("h")))
    left = rows.join(small(judged.select("id", "h", "g")), ["id", "h", "g"], "left_anti").select("_doc")
    repeated = judged.where("kept").select("id", "h", "g")
    if not repeated.isEmpty():
        left = left.unionByName(rows.join(small(stored(repeated)), ["id", "h", "g"]).groupBy("id", "h", "g").agg(F.min("_doc").alias("_doc")).select("_doc"))
    return left.select("_doc.*")
