"""Operators against plain versions over a whole small table."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhouse.llm import langid, lm, neardup, neighbours, packing, pieces, queries, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(llm):
    return {r.doc_id: r.text for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(llm, name):
    return queries.QUERIES[name](llm, SF).collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_accuracy_on_held_out_rows(llm):
    truth = {r.doc_id: r.lang for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in rows(llm, "op1_language_id") if r.held_out]
    assert got and all(crc(r.doc_id, 4) == 2 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.95


def plain_grams(text):
    """4-grams of a text's letters and marks; any run of other characters is one boundary, never inside."""
    kind = lambda c: unicodedata.category(c)[0]
    points = "".join(c if kind(c) in "LM" else "\0" for c in text.lower()) + "\0"
    points = re.sub("\0+", "\0", points).removeprefix("\0")
    return [points[i : i + 4] for i in range(len(points) - 3) if "\0" not in points[i + 1 : i + 3]]


def test_language_against_plain_sets(llm):
    """Bloom filters and corrected popcounts decide as exact sets of n-grams per language do."""
    p = langid.LanguageParams()
    docs = {r.doc_id: r for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    df, size = defaultdict(Counter), Counter()
    for lang, text in {(r.lang, r.text) for r in docs.values() if crc(r.doc_id, 4) != 2 and r.lang}:
        size[lang] += 1
        df[lang].update(set(plain_grams(text)))
    share = {g: {k: df[k][g] / size[k] for k in df if df[k][g] >= 2 and df[k][g] / size[k] >= p.least_share} for g in set().union(*df.values())}
    holds = {g: {k for k in s if s[k] >= p.relative * max(s.values())} for g, s in share.items() if s}
    same = []
    for r in rows(llm, "op1_language_id"):
        grams = plain_grams(docs[r.doc_id].text)
        hits = Counter(k for g in grams for k in holds.get(g, ()))
        best = max(sorted(df), key=lambda k: hits[k])
        same.append(r.lang_pred == best and abs(r.score - hits[best] / max(1, len(grams))) < 0.02)
    assert np.mean(same) > 0.99


def test_copies_and_marks_in_language_id(llm):
    """One text as a third of a language's rows does not drown its other n-grams; marks alone are no letter."""
    base = [r for r in llm.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").orderBy("doc_id").limit(300).collect()]
    plain = llm.createDataFrame([(r.text, r.lang) for r in base], "text string, lang string")
    copied = plain.union(llm.createDataFrame([(base[0].text, base[0].lang)] * 150, plain.schema))
    one, two = (langid.learn_languages(d) for d in (plain, copied))
    assert one.languages == two.languages and (one.bits == two.bits).all()
    odd = llm.createDataFrame([(0, "\u0301\u0302\u0303\u0304\u0305"), (1, "12 34")], "doc_id long, text string")
    assert {(r.lang_pred, r.lang_score) for r in langid.identify_languages(odd, one).collect()} == {("und", 0.0)}


def test_filter_holds_every_inserted_language():
    model = langid.LanguageFilter(langid.LanguageParams(slots=64), ["x", "y"], np.zeros((64, 1), np.uint64), np.zeros(2))
    key, _, _ = langid.grams([b"hello world"], 4)
    for r in langid.slots_of(key, model.params):
        model.bits[r, 0] |= np.uint64(2)
    assert langid.detect([b"hello world"], model)[0] == ["y"]


def test_near_duplicate_classes(llm, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    shared, where = Counter(), defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            shared.update((j, i) for j in where[s])
            where[s].append(i)
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = rows(llm, "op2_near_duplicates")
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in texts}
    assert sum(r.kept for r in got) == len({find(i) for i in texts})


def test_links_survive_a_group_without_a_common_hub(llm):
    """A chain of texts, each near its neighbours only: one class through many links."""
    base = [f"w{i}" for i in range(300)]
    chain = []
    for step in range(12):
        base = base[8:] + [f"n{step}_{i}" for i in range(8)]
        chain.append((step, " ".join(base)))
    df = llm.createDataFrame(chain, "doc_id long, text string")
    assert {r.class_id for r in neardup.near_duplicates(df).collect()} == {0}


def test_signature_estimates_weighted_similarity():
    code = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat([0, 1], [300, 300])
    both = np.concatenate([code[:300], code[100:400]])
    sig = neardup.signatures(both, doc, np.ones(600), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    scaled = neardup.signatures(both[:600], doc, np.repeat([1.0, 3.0], 300), 2, 2000)
    assert abs((scaled[0] == scaled[1]).mean() - 0.5) < 0.05  # a common factor changes nothing


def test_unigram_base_and_model(llm, texts):
    tokens = {i: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for r in rows(llm, "op3_context_mixing"):
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(log10((count[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * abs(r.base_score)
        assert -r.score / log10(2) / len(texts[r.doc_id].encode()) < 8 and r.score < 0


def test_score_beats_the_base_on_held_out_rows_and_tells_copies(llm):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_context_mixing(llm, sf).join(llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h")), "doc_id").collect()
    n = Counter(r.h for r in got)
    one = [r for r in got if r.held_out and n[r.h] == 1]
    assert sum(r.score for r in one) > sum(r.base_score for r in one)
    assert np.median([r.bits_per_byte for r in got if n[r.h] == 2]) < 0.7 * np.median([r.bits_per_byte for r in got if n[r.h] == 1])


def test_words_of_many_units(llm):
    """A word longer than a unit is one token of the base, and is coded in pieces."""
    long = "Ab" * 500
    rows = [(0, f"a {long} b"), (1, f"{long.lower()}"), (2, f"{long}x a"), (3, "y" * 63 + " " + "z" * 64 + " a")]
    got = {r.doc_id: r for r in lm.score_texts(llm.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 2).collect()}
    count = Counter({"a": 2, long.lower(): 2, "b": 1, "y": 1, "z": 1, None: 3})
    n, v = 10, 6
    for i, words in {0: ["a", long.lower(), "b"], 1: [long.lower()], 2: ["?", "a"], 3: ["y", "z", "a"]}.items():
        want = sum(log10((count[w] + 1) / (n + v + 1)) for w in [*words, None])
        assert (got[i].n_tokens, got[i].train_tokens, got[i].n_known) == (len(words) + 1, n, sum(count[w] > 0 for w in words) + 1) and abs(got[i].base_score - want) < 1e-9
    u = lm.units([long.encode(), b"q" * 64 + b" r"])
    assert (u.last - u.start).max() < lm.LONGEST and u.words.tolist() == [1, 2] and len(u.long_word) == 2
    assert (np.diff(u.start) == (u.last - u.start + 1)[:-1]).all() and set(u.kind[1:16].tolist()) == {lm.GOES_ON}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 3), min_size=2, max_size=4), st.booleans()), min_size=1, max_size=12))
def test_predictions_of_contexts(entries):
    """Decisions equal those of a plain version that leaves each row's own occurrence out."""
    logp = np.log10([0.4, 0.3, 0.2, 0.1])
    follows = np.full((len(entries), lm.REACH), lm.NONE, np.uint32)
    for i, (_, f, _) in enumerate(entries):
        follows[i, : len(f)] = [lm.RARE if x == 3 else x for x in f]
    ctx, train = np.array([e[0] for e in entries], np.uint64), np.array([e[2] for e in entries])
    mark = np.zeros(len(entries), np.uint64)
    for k in range(lm.REACH):
        mark = lm.mix(mark + follows[:, k].astype(np.uint64))
    want = Counter()
    for i in range(len(entries)):
        votes = Counter(int(mark[j]) for j in range(len(entries)) if j != i and train[j] and ctx[j] == ctx[i])
        if not votes:
            continue
        best = min(votes, key=lambda m: (-votes[m], m))
        guess = follows[[j for j in range(len(entries)) if mark[j] == best][0]]
        others, k = sum(votes.values()), 0
        while k < lm.REACH and guess[k] < lm.NONE and follows[i, k] != lm.NONE:
            gate = int(np.searchsorted([2, 4, 16], others, side="right")) * 4 + int(np.searchsorted([1, 3, 6], k, side="right"))
            want[i, gate, bool(follows[i, k] == guess[k])] += 1
            if follows[i, k] != guess[k]:
                break
            k += 1
    row, gate, learns, hits, misses, change = lm.predicted(ctx, follows, np.arange(len(entries)), train, logp)
    got = Counter({(r, g, x): n for r, g, h, m in zip(row, gate, hits, misses) for x, n in ((True, h), (False, m)) if n})
    if not _ties(ctx, mark, train):
        assert got == want and all(train[r] == t for r, t in zip(row, learns))


def _ties(ctx, mark, train):
    """Whether leaving one occurrence out can make a tie, where the plain version may choose otherwise."""
    for c in set(ctx.tolist()):
        n = sorted(Counter(mark[(ctx == c) & train].tolist()).values())
        if len(n) > 1 and n[-1] - n[-2] <= 1:
            return True
    return False


def test_model_is_a_distribution():
    """The probabilities of all one-byte continuations and the end of a unit sum to one."""
    model = lm.huffman(np.arange(256.0))
    model.logit = np.random.default_rng(0).normal(size=lm.BASES[-1]).astype(np.float16)
    model.seen = np.zeros(lm.BASES[-1], np.uint8)
    model.refine = np.random.default_rng(1).normal(size=512 * lm.STEPS).astype(np.float32)
    prefix = bytes((0,)) + b"ab"
    got = lm.log10_units([prefix + bytes((b,)) for b in range(256)], model) - lm.log10_units([prefix], model)[0]
    assert abs((10**got).sum() - 1) < 1e-5


def test_bytes_that_units_share_are_worked_once(llm):
    """Bits of bytes that units share stand once, with their weight; tables and costs equal those of single units."""
    made = [b"\1the ", b"\1then ", b"\1there,\n", b"\2the ", b"\1\n", b"\0th\xc3\xa9 ", b"\1The "] + [b"\1w%d " % i for i in range(500)]
    model = lm.huffman(np.arange(256.0))
    b = lm.Bits(made, model)
    size = lambda u: sum(model.lengths[x] for x in u[1:])
    assert len(b.bit) == sum(model.lengths[u[-1]] for u in {u[:j] for u in made for j in range(2, len(u) + 1)}) < sum(map(size, made))
    n = np.arange(len(made)) + 1
    assert b.weights(n).sum() == sum(size(u) * k for u, k in zip(made, n)) and b.whole == sum(map(size, made))
    want = np.zeros((2, lm.BASES[-1]))
    for u in made:
        one = lm.Bits([u], model)
        for s in one.slots:
            np.add.at(want, (one.bit, s), 1)
    counted = llm.createDataFrame([(u, 2, True) for u in made] + [(b"\1heldout ", 0, True), (b"\x09record..", 1, False)], "unit binary, n long, coded boolean")
    got = lm.count_bits(counted, model, lm.MixParams(text_bytes=2000, units_at_once=64))
    assert (np.stack(got) == want).all()
    model.logit, model.seen = lm._stretch(*want).astype(np.float16), lm._level(want.sum(axis=0))
    model.refine = np.random.default_rng(1).normal(size=512 * lm.STEPS).astype(np.float32)
    assert np.allclose(lm.log10_units(made, model), [lm.log10_units([u], model)[0] for u in made], rtol=1e-9)


def test_packing_is_tight(llm, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(llm, "op4_best_fit_packing")
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want = [(k, 4096 * k, len(ids[4096 * k : 4096 * (k + 1)]), zlib.crc32(np.array(ids[4096 * k : 4096 * (k + 1)], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 4096
    assert len(seqs) <= 1.02 * sum(r.length for r in got) / 4096 + 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 6))
def test_best_fit_keeps_every_capacity(lengths, rule, documents):
    p = packing.PackParams(tokens=50, documents=documents, attention=2500, rule=rule)
    bins, at = packing.best_fit(np.array(lengths, np.int64), p)
    for b in set(bins.tolist()):
        own = sorted((int(at[i]), lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert sum(n for _, n in own) <= 50 and len(own) <= documents and sum(n * n for _, n in own) <= 2500
        assert all(x + n == y for (x, n), (y, _) in zip(own, own[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t▁é漢😀\x00\x85.,'sİΣ́\x1c<|>")), max_size=30))
def test_tokenizers_on_any_text(text):
    coder, chunks = CODERS
    assert coder.encode(text) == np.array(coder.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    (ids, back), = chunks.encode([text])
    want = [1, *chunks.model.encode(text), 2]
    assert ids == np.array(want, "<u4").tobytes() and back == chunks.model.decode(want)


CODERS = (packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"), word_bytes=12_000, chunk_bytes=12_000), pieces.ChunkPieces(public_tokenizers.path("piece_bpe_32k.model"), most=20_000))


def test_piece_digests(llm, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(llm, "op7_piece_codes"):
        ids = [1, *sp.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_quality_counts(llm, texts):
    for r in rows(llm, "op6_quality_rules"):
        t = texts[r.doc_id]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_toxicity_on_held_out_rows(llm):
    labels = {r.doc_id: r.toxic for r in llm.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in queries.op8_toxicity(llm, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert all(crc(r.doc_id, 5) == 0 for r in got)
    good = [r.score for r in got if labels[r.doc_id] == 0]
    bad = [r.score for r in got if labels[r.doc_id] == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbour_recall(llm, sf):
    v = {r.vec_id: np.array(r.embedding, float) for r in llm.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in queries.op10_nearest_neighbours(llm, f"/root/testdata/{sf}").collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert abs(r.score - v[r.query_id] @ v[r.vec_id]) < 1e-12
    hits, names, every = [], np.array(list(v)), np.stack(list(v.values()))
    for q in (i for i in v if i % 20 == 0):
        score = every @ v[q]
        near = np.argpartition(-score, min(40, len(score) - 1))[:41]
        want = sorted((-score[j], names[j]) for j in near if names[j] != q)[:20]
        assert [k for k, _ in sorted(got[q])] == list(range(1, 21))
        hits.append(len({i for _, i in want} & {i for _, i in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_few_lists_are_probed_where_vectors_cluster(llm):
    """Lists follow the rows, probes what a sample needs; cut lists and shared cells lose nothing."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 24)) * 4
    x = centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.3
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = neighbours.SearchParams(block=500, query_block=64)
    lists = neighbours.fit_centroids(x, round(6000**0.5), p.seed)
    assert len(lists) == 77 and neighbours.fit_probes(x, lists, p) <= 20
    got = defaultdict(set)
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, params=p).collect():
        got[r.query_id].add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert np.mean([len(got[q] & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in range(0, 6000, 20)]) >= 0.9
    first, parts = neighbours.cut_cells({0: 10, 1: 1200, 2: 30, 3: 400}, 5, 500)
    assert first.tolist() == [0, 1, 4, 4, 4] and parts.tolist() == [1, 3, 1, 1, 1]


def test_rows_found_follow_the_queries_not_the_square(llm, monkeypatch):
    """Cells yield a few rows for each neighbour of a query, however many cells there are, and lose none."""
    x = np.random.default_rng(6).normal(size=(6000, 8))
    df = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p, plain, made = neighbours.SearchParams(probes=1 << 20, block=800, first_look=64, spread=100.0), neighbours.searched, []

    def counted(*args):
        made.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(neighbours, "searched", counted)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, params=p).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert len(got) == 60 and all([i for _, i in sorted(got[q])] == np.argsort(-score[q], kind="stable")[:20].tolist() for q in got)
    assert len(made) > 2 and sum(made) < 60 * 20 * p.widen * len(made)  # in one round: about 1,000 a query


def test_ledger_scans_only_what_is_new(llm, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = llm.createDataFrame([(1, "token: abcdef"), (2, "token: abcdef"), (3, "none")], "doc_id long, text string")
    secrets.scan_ledger(one, ledger).count()
    assert llm.read.parquet(ledger).count() == 2
    two = one.union(llm.createDataFrame([(4, "deadbeef" * 4), (1, "changed")], one.schema))
    assert secrets.scan_ledger(two, ledger).count() == 5
    assert llm.read.parquet(ledger).count() == 4 and llm.read.parquet(ledger).select("blob").distinct().count() == 4
    secrets.scan_ledger(two, ledger, rules=(*secrets.RULES, secrets.Rule("vault", r"hvs\.[A-Za-z0-9]{20,}"))).count()
    assert llm.read.parquet(ledger).count() == 8


def test_probabilities_of_different_texts_stay_below_one(llm):
    """Known spellings of several classes together weigh over one; new units must not gain from that."""
    rng = np.random.default_rng(5)
    forms = [w + end for w in ("ab", "ba", "aab") for end in ("", ".", ",", "7", "Z")]
    train = [(2 * k, " ".join(rng.choice(forms, 40))) for k in range(100)]
    new = [(2 * k + 1, a + b) for k, (a, b) in enumerate((a, b) for a in ("a", "b", "ab", "ba", "aab") for b in ("a", "b", "bb", "Z.", "77", "b.", "b,", "b7"))]
    new = [(k, w) for k, w in {w: (k, w) for k, w in new}.values() if w not in forms]
    got = lm.score_texts(llm.createDataFrame(train + new, "doc_id long, text string"), F.col("doc_id") % 2 == 0).where("held_out").collect()
    assert len(got) == len(new) and sum(10**r.score for r in got) <= 1 + 1e-6
