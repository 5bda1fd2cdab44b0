"""Every operator and stage takes odd rows and empty tables, with a defined result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import chat, langid, lm, neardup, neighbours, packing, pieces, quality, secrets, toxicity


def test_language(odd, empty):
    model = langid.learn_languages(odd.where("doc_id > 2"))
    got = {(r.doc_id, r.row): (r.lang_pred, r.lang_score) for r in langid.identify_languages(odd, model).collect()}
    assert len(got) == odd.count() and all(got[i, 1] == ("und", 0.0) for i in (0, 1, 2)) and 0 <= got[6, 1][1] <= 1
    nothing = langid.learn_languages(empty)
    assert langid.identify_languages(empty, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(odd, nothing).collect()} == {"und"}


def test_near_duplicates(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == odd.count() and cls[3] == cls[4] == 3 and cls[0] == 0 and cls[1] == 1 and cls[2] == 2 and cls[None] is None
    assert [r.kept for r in rows if r.doc_id is None] == [True] and {r.copies for r in rows if r.doc_id == 4} == {3}
    assert neardup.near_duplicates(empty).count() == 0


def test_language_model(odd, empty):
    rows = lm.score_texts(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1} and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert lm.score_texts(empty, F.lit(True)).count() == 0


def test_packing(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    make = lambda: packing.ChunkTokenizer(path)
    rows = packing.pack(packing.token_pieces(odd, make, 1, 4096)).collect()
    assert {r.length for r in rows if r.doc_id in (0, 1, 2)} == {1} and len([r for r in rows if r.doc_id == 6]) > 10
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.token_pieces(empty, make, 1, 4096)).count() == 0


def test_chat(llm):
    turns = llm.createDataFrame([(1, 1, "u", "a"), (1, 2, "b", None), (2, 1, "u", "a"), (3, 1, "u", "a"), (3, 2, "b", None), (None, 1, "u", "x"), (4, 1, None, ""), (4, 1, None, ""), (5, None, "u", "z" * 100_000)], "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_same, r.rendered) for r in chat.format_conversations(turns).collect()}
    assert set(got) == {1, 4, 5} and got[1] == (2, 2, "<|u|>\na<|end|>\n<|b|>\n<|end|>\n") and got[4][:2] == (2, 1)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_quality(odd, empty):
    rules = quality.DecisionList([[quality.Test("mean_word", True, 50.0)]])
    got = {(r.doc_id, r.row): r for r in quality.apply_rules(quality.text_statistics(odd), rules).collect()}
    assert len(got) == odd.count() and got[0, 1].n_words == 0 and got[0, 1].base_failed and got[7, 1].word_chars == 300_000
    assert got[6, 1].n_words == 60_000 and got[6, 1].kept and got[0, 1].word == "word"
    assert quality.apply_rules(quality.text_statistics(empty), rules).count() == 0
    labels = empty.select("doc_id").withColumn("quality", F.lit(1))
    assert quality.learn_rules(quality.labelled_sample(odd, labels)).rules == []


def test_pieces(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {(r.doc_id, r.row): r for r in pieces.piece_codes(odd, path).collect()}
    assert len(rows) == odd.count() and rows[0, 1].n_tokens == rows[1, 1].n_tokens == 2 and rows[6, 1].decoded == odd.where("doc_id = 6").first().text
    assert pieces.piece_digests(odd, path).count() == odd.count() and pieces.piece_codes(empty, path).count() == 0


def test_toxicity(odd, empty):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    weight = toxicity.learn_toxicity(odd, labels)
    rows = toxicity.toxicity_scores(odd, weight).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    nothing = toxicity.learn_toxicity(odd, labels.limit(0))
    assert {r.toxic_score for r in toxicity.toxicity_scores(odd, nothing).collect()} == {0.5} and toxicity.toxicity_scores(empty, nothing).count() == 0


def test_secrets(odd, empty):
    rows = secrets.scan_ledger(odd).select("doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()
    assert len(rows) == odd.count() and {r.s for r in rows if r.doc_id == 8} == {"assign:0:21"} and {r.s for r in rows if r.doc_id != 8} == {""}
    assert secrets.scan_ledger(empty).count() == 0


def test_neighbours(llm):
    v = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 3), (63, [1.0, None, 2.0]), (64, [float("nan"), 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (66, [1.0, 1.0])]
    df = llm.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    every = neighbours.SearchParams(probes=32, spread=50.0, block=9, query_block=2)  # all lists, no early abandoning: exact
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, params=every).collect()
    for q in (0, 20, 40):
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        score = lambda i: sum(a * b for a, b in zip(v[q][1], v[i][1]))  # noqa: E731, B023
        want = sorted((-score(i), i) for i in range(60) if i != q)[:20]
        assert mine == [(k, i) for k, (_, i) in enumerate(want, 1)]
    assert neighbours.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


#: Names that operators use for columns of their own.
CLASHING = ["kept", "n_words", "rule", "base_failed", "lang_pred", "lang_score", "toxic_score", "ids", "class_id", "copies", "h", "g", "n", "path", "blob", "spans", "sequence_id", "offset", "piece", "length"]


@pytest.mark.parametrize("number", range(5))
def test_stages(llm, odd, empty, number):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    names = {c: F.lit("mine") for c in CLASHING}
    docs = docs.withColumns(names)
    stage = corpus_pipeline.STAGES[number][1]
    got = stage(llm, docs, "/root/testdata/sf0.001")
    assert got.count() >= 1 and (number == 4 or got.columns == docs.columns)
    if number < 4:
        assert {tuple(r) for r in got.select(*CLASHING).distinct().collect()} == {("mine",) * len(CLASHING)}
    assert stage(llm, docs.limit(0), "/root/testdata/sf0.001").count() == 0
