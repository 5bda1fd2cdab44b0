"""Periodic runs against a plain search over every period, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import queries, runs
from tallyhouse.sources.tables import table

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """(start, length, period) by start and period: every stretch of equal words q apart, for every q."""
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                best.setdefault((s, i + q - s), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng):
    t: list = []
    while len(t) < rng.randint(0, 250):
        r = rng.random()
        if r < 0.4:
            t += [rng.randint(0, 3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)
        elif r < 0.6:
            t += [rng.randint(0, 1)] * rng.randint(1, 30)
        elif r < 0.7 and t:
            t += t[-rng.randint(1, len(t)) :] * rng.randint(1, 6)
        else:
            t += [rng.randint(0, 50) for _ in range(rng.randint(1, 20))]
    return t


def test_runs_of_random_words(monkeypatch):
    rng = random.Random(3)
    for turn in range(300):
        if turn == 150:  # long texts walk over periods instead of a table of grid points; queries go in parts
            monkeypatch.setattr(runs, "GRID_WORDS", 8)
            monkeypatch.setattr(runs, "QUERIES", 5)
        params = runs.RunParams(*rng.choice([(6, 4), (2, 2), (3, 3), (10, 5)]))
        texts = [random_text(rng) for _ in range(rng.randint(1, 5))]
        got = runs.runs_of([np.array(t, np.int32) for t in texts], params)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, params.least, params.times) for t in texts]


def test_extensions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = np.concatenate([[100], np.tile(rng.integers(0, 3, rng.integers(1, 12)), 20), rng.integers(0, 2, 100), [101]])
        g = runs.Grammar(s)
        i, j = rng.integers(0, len(s), 300), rng.integers(0, len(s), 300)
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j, strict=True):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            want.append(n)
        assert g.extension(i, j).tolist() == want


def test_query_follows_its_contract(llm):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(llm, SF).collect()}
    docs = table(llm, SF, "documents").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        seen += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(plain_collapse(words, found)))
        assert tuple(got[d.doc_id])[1:] == want
    assert seen > 5


def test_odd_rows(odd, empty):
    names = odd.withColumns({"runs": F.lit(1), "collapsed": F.lit(2)})
    rows = runs.periodic_runs(names).collect()
    assert len(rows) == odd.count() and runs.periodic_runs(empty).count() == 0
    texts = {(r.doc_id, r.row): r.text for r in odd.collect()}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id, r.row] or "")
        found = plain_runs(words) if len(words) < 1000 else []
        assert [tuple(x) for x in r.runs] == found and r.collapsed == plain_collapse(words, found) and r.word in ("word", "y", None)
    assert {len(r.runs) for r in rows if r.doc_id == 5} == {1}
