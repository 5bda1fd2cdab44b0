"""Approximate nearest neighbours by inner product: probed lists and an adaptive dimension scan.

Vectors fall into lists by their nearest centroid (fitted on a bounded sample); there are about as many
lists as the square root of the rows. A query probes the lists of the most promising centroids; how many is
measured on a sample, as the fewest that hold ``reach`` of its true neighbours. Inside a list, vectors are
turned by one random rotation and scanned in column blocks. Under a random rotation the first d of D
dimensions hold d/D of an inner product, give or take a known spread; after each block a hypothesis test
abandons the candidates whose partial product is too small for the whole to reach the query's k-th best
score so far. Survivors are scored exactly on original vectors.

Lists are put together to cells of about ``block`` rows (a longer list is cut into several), so that a
query goes once to each cell that holds a list it probes, and a cell's rows once to every ``query_block``
queries that come to it.

A query visits its cells in rounds, the most promising first. Every round looks at a few times as many
candidates as all before, and begins with the k-th best score of those as its bar. So a round yields about
k times that factor rows a query, and all rounds together k times the logarithm of the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import small, stored


@dataclass(frozen=True)
class SearchParams:
    """k: neighbours a query. most_lists: of the index. probes: lists a query looks at; measured if None.
    reach: share of the neighbours in a sample that probed lists must hold. sample_rows, sample_queries:
    expected rows the centroids are fitted and the probes measured on, and queries of that. columns:
    dimensions of a block. spread: deviations of the test (2.5: a neighbour that just reaches the bar is
    lost with chance 0.006 a test). sparse: share of live pairs below which single pairs are followed
    instead of whole blocks. rows_at_once, block: candidates scanned between two updates, and in a cell.
    query_block: queries in a task. first_look: sampled candidates that a query meets at first; the k-th
    best of them bounds its k-th best of all from below, and none gets fewer than k neighbours. widen: how many
    times more candidates a query has met after each round.
    """

    k: int = 20
    most_lists: int = 4096
    probes: int | None = None
    reach: float = 0.97
    sample_rows: int = 20_000
    sample_queries: int = 256
    columns: int = 16
    spread: float = 2.5
    sparse: float = 0.1
    rows_at_once: int = 512
    block: int = 8192
    first_look: int = 2048
    query_block: int = 4096
    widen: int = 4
    seed: int = 7


def usable(embedding: Column) -> Column:
    """True for vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & F.coalesce(~bad, F.lit(True)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of at most ``lists`` lists, by ten rounds of k-means."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(10):
        own = nearest(sample, centre)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        centre = centre.copy()
        centre[there] = np.add.reduceat(sample[order], first) / np.diff(first, append=len(own))[:, None]
    return centre


def fit_probes(sample: np.ndarray, centre: np.ndarray, p: SearchParams) -> int:
    """The fewest lists, best centroid first, that hold ``reach`` of the k nearest in the sample.

    Neighbours in a sample lie farther away than those in all rows, so they need no fewer lists.
    """
    rng = np.random.default_rng(p.seed)
    q = rng.choice(len(sample), min(p.sample_queries, len(sample)), replace=False)
    score = sample[q] @ sample.T
    score[np.arange(len(q)), q] = -np.inf
    top = np.argpartition(-score, min(p.k, len(sample) - 1), axis=1)[:, : p.k]
    place = np.argsort(np.argsort(-(sample[q] @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, centre)[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(p.reach * len(needed)))]) + 1


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The centroid of least distance to each row."""
    return ((centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)


def scan_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, turn: np.ndarray, p: SearchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of each query's best k candidates among the rows of ``x``.

    ``bar``: a score that each query's k-th best candidate of all is known to reach.
    """
    dim = x.shape[1]
    cuts = [*range(0, dim, p.columns), dim]
    xt, qt = x @ turn, q @ turn
    size = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None, :]
    bar = bar.copy()

    def least(d: int, bar: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What the first d of the turned dimensions give at least, if the whole product reaches the bar."""
        return bar * (d / dim) - (p.spread * np.sqrt(d * (1 - d / dim)) / dim + 1e-9) * size

    best_q, best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for lo in range(0, len(x), p.rows_at_once):
        hi = min(len(x), lo + p.rows_at_once)
        live = ids[lo:hi][None, :] != query_ids[:, None]
        part, b = np.zeros(live.shape), 0
        while b < len(cuts) - 1 and (b == 0 or live.mean() > p.sparse):
            part += qt[:, cuts[b] : cuts[b + 1]] @ xt[lo:hi, cuts[b] : cuts[b + 1]].T
            b += 1
            live &= part >= least(cuts[b], bar[:, None], size[:, lo:hi])
        qi, xi = np.nonzero(live)
        part, xi = part[qi, xi], xi + lo
        while b < len(cuts) - 1 and len(qi):
            c0, c1 = cuts[b], cuts[b + 1]
            for s in range(0, len(qi), 65536):
                part[s : s + 65536] += (qt[qi[s : s + 65536], c0:c1] * xt[xi[s : s + 65536], c0:c1]).sum(axis=1)
            b += 1
            go_on = part >= least(c1, bar[qi], size[qi, xi])
            qi, xi, part = qi[go_on], xi[go_on], part[go_on]
        score = np.concatenate([(q[qi[s : s + 65536]] * x[xi[s : s + 65536]]).sum(axis=1) for s in range(0, len(qi), 65536)] or [np.empty(0)])
        best_q, best_i, best_s = best_of(np.append(best_q, qi), np.append(best_i, ids[xi]), np.append(best_s, score), bar, p.k)
    return best_q, best_i, best_s


def cut_cells(sizes: dict[int, int], n_lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each list: short lists share a cell, longer ones are cut."""
    first, parts = np.zeros(n_lists, np.int32), np.ones(n_lists, np.int32)
    cell, held = 0, 0
    for i in range(n_lists):
        n = sizes.get(i, 0)
        if held and held + n > block:
            cell, held = cell + 1, 0
        first[i], parts[i] = cell, max(1, -(-n // block))
        held += n
        if parts[i] > 1:
            cell, held = cell + int(parts[i]), 0
    return first, parts


def round_ends(n_cells: int, cell_rows: int, p: SearchParams) -> np.ndarray:
    """Places, in a query's order of cells, at which a new round begins; the first look counts as a round."""
    ends, c = [], max(1, p.widen * p.first_look // cell_rows)
    while c < n_cells:
        ends.append(c)
        c *= p.widen
    return np.array(ends, np.int64)


def searched(cand: DataFrame, asked: DataFrame, turn: np.ndarray, p: SearchParams) -> DataFrame:
    """(query_id, vec_id, score): the best k rows of every cell of ``cand`` that reach the bar, for each query sent there.

    ``cand``: cell, list, id, e. ``asked``: cell, asker, v, bar, lists.
    """
    shared = cand.sparkSession.sparkContext.broadcast(turn)
    deals = small(stored(asked.groupBy("cell").agg(F.ceil(F.count("*") / p.query_block).cast("int").alias("deals"))))
    cand = cand.join(deals, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("turn"), "list", "id", "e")
    asked = asked.join(deals, "cell").select(F.col("cell").alias("of"), F.pmod(F.xxhash64("asker"), F.col("deals")).cast("int").alias("deal"), "asker", "v", "bar", "lists")

    def search(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(a):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        qi, found, score = search_cell(c, a, shared.value, p)
        return pd.DataFrame({"query_id": a["asker"].to_numpy()[qi], "vec_id": found, "score": score})

    return cand.groupBy("cell", "turn").cogroup(asked.groupBy("of", "deal")).applyInPandas(search, "query_id long, vec_id long, score double")


def search_cell(c: pd.DataFrame, a: pd.DataFrame, turn: np.ndarray, p: SearchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score): the best k rows of a cell for each of its queries, list by list."""
    c = c.sort_values(["list", "id"])
    ids, x, own = c["id"].to_numpy(), np.stack(c["e"].to_numpy()), c["list"].to_numpy()
    names, q, bar = a["asker"].to_numpy(), np.stack(a["v"].to_numpy()), a["bar"].to_numpy().copy()
    wanted = np.concatenate([np.asarray(w) for w in a["lists"]])
    asks = np.repeat(np.arange(len(a)), [len(w) for w in a["lists"]])
    best_q, best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    there, edge = np.unique(own, return_index=True)
    for no, lo, hi in zip(there, edge, np.append(edge[1:], len(own))):
        who = asks[wanted == no]
        if not len(who):
            continue
        qi, found, score = scan_block(ids[lo:hi], x[lo:hi], names[who], q[who], bar[who], turn, p)
        best_q, best_i, best_s = best_of(np.append(best_q, who[qi]), np.append(best_i, found), np.append(best_s, score), bar, p.k)
    return best_q, best_i, best_s


def best_of(q: np.ndarray, i: np.ndarray, s: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, ties to the smaller id; ``bar`` rises to a k-th best score."""
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    q, i, s, place = q[keep], i[keep], s[keep], place[keep]
    last = place == k - 1
    bar[q[last]] = np.maximum(bar[q[last]], s[last])
    return q, i, s


def nearest_neighbours(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among all other rows, ties to the smaller id.

    ``queries``: condition on the rows that ask. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows without an id or with another dimension than most rows; of rows
    that repeat an id, the least vector stands. A hot list is cut into cells of ``block`` rows. Too few
    candidates: all of them. No row takes part: an empty result.
    """
    p, spark = params, vectors.sparkSession
    e = F.col("e")
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"), queries.alias("asks")).where(usable(e))
    rows = stored(rows.groupBy("id").agg(F.min("e").alias("e"), F.max("asks").alias("asks")))
    dims = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, lists = dims["d"], max(1, min(p.most_lists, round(dims["count"] ** 0.5)))
    rows = rows.where(F.size("e") == dim)
    wanted = max(p.sample_rows, 20 * lists)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("lists")), F.lit(1 << 20)) < min(1.0, wanted / dims["count"]) * (1 << 20)).select("e").limit(2 * wanted).toArrow().to_pandas()
    if not len(drawn):
        drawn = rows.select("e").limit(lists).toArrow().to_pandas()
    sample = np.stack(drawn["e"].to_numpy())
    centre = fit_centroids(sample, lists, p.seed)
    turn = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((dim, dim)))[0]
    probes = min(len(centre), p.probes or fit_probes(sample, centre, p))
    look = rows.where(F.pmod(F.xxhash64("id", F.lit("look")), F.lit(1 << 20)) < min(1.0, p.first_look / dims["count"]) * (1 << 20)).limit(2 * p.first_look).toArrow().to_pandas()
    seen = np.stack(look["e"].to_numpy()) if len(look) else np.empty((0, dim))
    index = spark.sparkContext.broadcast((centre, turn, seen, look["id"].to_numpy()))

    @F.pandas_udf("bar double, ids array<long>, scores array<double>")
    def met(ids: pd.Series, v: pd.Series) -> pd.DataFrame:
        """The best k of the sampled candidates, scored exactly; the k-th score, or none below k of them."""
        _, _, seen, seen_ids = index.value
        q, k = np.stack(v.to_numpy()) if len(v) else np.empty((0, dim)), min(p.k, max(0, len(seen) - 1))
        rough = np.where(seen_ids[None, :] == ids.to_numpy()[:, None], -np.inf, q @ seen.T)
        top = np.argsort(-rough, axis=1, kind="stable")[:, :k]
        score = (q[:, None, :] * seen[top]).sum(axis=2)
        bar = score.min(axis=1) if k == p.k else np.full(len(q), -np.inf)
        return pd.DataFrame({"bar": bar, "ids": list(seen_ids[top]), "scores": list(score)})

    @F.pandas_udf("int")
    def list_of(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(v.to_numpy()), index.value[0]), dtype="int32") if len(v) else pd.Series([], dtype="int32")

    listed = stored(rows.withColumn("list", list_of("e")))
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most most_lists rows
    # a small table is cut into about 64 cells, so that many tasks have some
    cell_rows = min(p.block, max(p.block // 8, dims["count"] // 64))
    first_cell, parts = cut_cells(sizes, len(centre), cell_rows)
    cells = spark.sparkContext.broadcast((first_cell, parts, round_ends(int((first_cell + parts).max()), cell_rows, p)))

    @F.pandas_udf("array<struct<cell:int,round:int,lists:array<int>>>")
    def probed(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        first_cell, parts, ends = cells.value
        out = []
        for near in np.argsort(-(np.stack(v.to_numpy()) @ index.value[0].T), axis=1, kind="stable")[:, :probes]:
            own = np.repeat(first_cell[near], parts[near]) + np.concatenate([np.arange(n, dtype=np.int32) for n in parts[near]])
            lists = np.repeat(near, parts[near]).astype(np.int32)
            order = np.argsort(own, kind="stable")
            there, edge = np.unique(own[order], return_index=True)
            place = np.argsort(np.argsort(order[edge]))  # a cell is as promising as its best list
            when = np.searchsorted(ends, place, side="right")
            out.append([{"cell": int(c), "round": int(t), "lists": x} for c, t, x in zip(there, when, np.split(lists[order], edge[1:]))])
        return pd.Series(out)

    of_list = spark.createDataFrame([(i, int(first_cell[i]), int(parts[i])) for i in range(len(centre))], "list int, first int, parts int")
    in_cell = (F.col("first") + F.pmod(F.xxhash64("id", F.lit("cell")), F.col("parts"))).cast("int")
    cand = listed.join(F.broadcast(of_list), "list").select(in_cell.alias("cell"), "list", "id", "e")
    asking = listed.where(F.coalesce(F.col("asks"), F.lit(False))).select(F.col("id").alias("asker"), F.col("e").alias("v"))
    asking = stored(asking.withColumn("met", met("asker", "v")))
    asked = stored(asking.select("asker", "v", F.explode(probed("v")).alias("to")).select("asker", "v", "to.cell", "to.round", "to.lists"))
    first = asking.select(F.col("asker").alias("query_id"), F.explode(F.arrays_zip(F.col("met.ids").alias("i"), F.col("met.scores").alias("s"))).alias("x")).select("query_id", F.col("x.i").alias("vec_id"), F.col("x.s").alias("score")).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, bars = first, asking.select("asker", F.col("met.bar").alias("bar"))
    for no in sorted(r["round"] for r in asked.select("round").distinct().collect()):
        sent = asked.where(F.col("round") == no).join(bars, "asker", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        found = best.union(searched(cand, sent, turn, p)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).drop("rank"))
        bars = best.groupBy(F.col("query_id").alias("asker")).agg(F.when(F.count("*") == p.k, F.min("score")).alias("bar"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
