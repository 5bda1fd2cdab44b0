"""The manifest against a plain build of every tree, for ragged sizes, several fanouts and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import merkle, queries
from tallyhouse.sources.tables import table

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(leaves, fanout):
    """Root and, per leaf, the (place, siblings) of every level."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            lo = a // fanout * fanout
            paths[i].append((a - lo, level[lo:a] + level[a + 1 : lo + fanout]))
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], paths


def whole(rows, fanout):
    """(tree, id, leaf) rows -> {(tree, id, leaf): (subroot, root, path)} for distinct keys."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(r[0], []).append(r)
    built = {t: plain([r[2] for r in rs], fanout) for t, rs in trees.items()}
    root, upper = plain([built[t][0] for t in trees], fanout)
    out = []
    for k, (t, rs) in enumerate(trees.items()):
        out += [(*r, built[t][0], root, built[t][1][i] + upper[k]) for i, r in enumerate(rs)]
    return out


@pytest.mark.parametrize(("fanout", "levels", "counts"), [(2, 2, [1, 37, 4]), (3, 1, [29, 2]), (2, 1, [3, 2, 5, 1]), (4, 2, [70]), (5, 1, [26, 5])])
def test_plain_trees(llm, fanout, levels, counts):
    names = [None, "é", "b", "a"]
    rows = [(names[k], i, leaf_of(k, i)) for k, n in enumerate(counts) for i in range(n)]
    df = llm.createDataFrame(rows, "name string, id long, leaf string")
    params = merkle.MerkleParams(fanout=fanout, levels=levels, rounds=2)
    done = merkle.manifest(df, F.col("name"), ["id"], "leaf", params).withColumn("again", merkle.folded(F.col("leaf"), F.col("path")))
    got = {(r.name, r.id): (r.leaf, r.subroot, r.root, [(p.place, [o.hex() for o in p.others]) for p in r.path]) for r in done.collect()}
    want = {(t, i): (leaf, sub, root, path) for t, i, leaf, sub, root, path in whole(rows, fanout)}
    assert got == want and all(r.again == r.root for r in done.collect())


def test_odd_rows(odd, empty):
    digests = lambda df: df.select("doc_id", "lang", "id", merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")).alias("leaf"))
    rows = digests(odd)
    twice = rows.unionByName(rows)  # repeated rows are leaves each
    params = merkle.MerkleParams(levels=1)
    done = merkle.manifest(twice, F.col("lang"), ["doc_id"], "leaf", params).collect()
    want = whole([(r.lang, r.doc_id, r.leaf) for r in twice.collect()], 2)
    key = lambda leaf, path: (leaf, str(path))
    assert sorted(key(r.leaf, [(p.place, [o.hex() for o in p.others]) for p in r.path]) for r in done) == sorted(key(w[2], w[5]) for w in want)
    assert {r.root for r in done} == {want[0][4]} and {r.id for r in done} == {"id", "x", None}
    texts = {r.doc_id: r for r in odd.collect()}
    assert {r.doc_id: r.leaf for r in done}[None] == leaf_of(None, None, None, None, texts[None].text)
    assert merkle.manifest(digests(empty), F.col("lang"), ["doc_id"], "leaf").count() == 0


def test_tampering_shows(llm):
    docs = {r.doc_id: r for r in table(llm, SF, "documents").collect()}
    for r in queries.op11_merkle_manifest(llm, SF).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None
        d = docs[r.doc_id]
        assert r.leaf == leaf_of(d.doc_id, d.source, d.lang, d.n_chars, d.text) and r.verified is not hit and (r.folded_root == r.root) is r.verified
