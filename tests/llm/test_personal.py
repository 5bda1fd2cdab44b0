"""Base spans against plain patterns, propagation against sums over all labellings, and what the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import personal, queries
from tallyhouse.sources.tables import table

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and plain_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    return [(no, m.start(), m.end()) for no, (p, ok) in enumerate(PLAIN.values()) for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_of_random_texts():
    rng = random.Random(7)
    some = ["@", ".", "-", " ", "+", "(", ")", "a", "b.c", "mail.example.com", "1", "23", "255.", "256", "4845168114407329", "4845 1681 1440 7329", "+1 (017) 555-7713", "x@y.z", "é", "漢", "\U0001f600", "%", "_", "\n", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        got = sorted((k, s, e) for k, s, e, ok in personal.base_matches(text) if ok)
        assert got == plain_spans(text), text


def test_base_spans_take_linear_time():
    for text in ("x" * 300_000 + "@", "9" * 300_000, "a@" * 100_000, "+5((((" * 50_000, "1.2." * 100_000, "1 " * 150_000):
        assert not [m for m in personal.base_matches(text) if m[3] and m[0] != 1]
        personal.graph_of(text[:20_000], personal.base_matches(text[:20_000]))


def exact(scores, edges, potential):
    total = np.zeros_like(scores)
    for labels in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        w = np.exp(sum(scores[k, y] for k, y in enumerate(labels)) + sum(p[labels[a], labels[b]] for (a, b), p in zip(edges, potential, strict=True)))
        for k, y in enumerate(labels):
            total[k, y] += w
    return total / total.sum(1, keepdims=True)


def test_propagation():
    rng = np.random.default_rng(2)
    for _ in range(10):
        scores = rng.normal(size=(5, personal.LABELS))
        tree = np.array([(rng.integers(0, k), k) for k in range(1, 5)])
        pots = rng.normal(size=(4, personal.LABELS, personal.LABELS))
        assert np.allclose(personal.marginals(scores, tree, pots, personal.FieldParams(close=1e-9)), exact(scores, tree, pots), atol=1e-4)
        loop = np.array([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)])
        weak = rng.normal(size=(5, personal.LABELS, personal.LABELS)) / 3
        assert np.allclose(personal.marginals(scores, loop, weak, personal.FieldParams()), exact(scores, loop, weak), atol=0.02)
    alone = personal.marginals(scores, np.zeros((0, 2), np.int64), np.zeros((0, personal.LABELS, personal.LABELS)), personal.FieldParams())
    assert np.allclose(alone, np.exp(scores) / np.exp(scores).sum(1, keepdims=True))


@pytest.fixture(scope="module")
def field(llm):
    return personal.learn_field(table(llm, "/root/testdata/sf0.1", "documents"))


def added(field, text):
    graphs = [personal.graph_of(text, personal.base_matches(text))]
    return [(personal.KINDS[k], text[s:e]) for k, s, e in personal.added_spans(graphs, field, personal.FieldParams())[0]]


def test_what_the_field_adds(field):
    card, other = "4845168114407329", "7536784127813051"  # the second one fails the check
    assert added(field, f"Some words {card} and others, then {card} 41 here.") == [("card", card)]
    assert added(field, f"Some words {card} 41 and others.") in ([("card", card)], [])
    assert added(field, f"An order of {other} units, {other} again, 2024-05-17 at 10.") == []
    phone = "Call +1 (017) 555-7713 today. Later on call (017) 555-7713 again, or 555-7713 there."
    assert {k for k, _ in added(field, phone)} == {"phone"} and any("555-7713" in t for _, t in added(field, phone))
    assert added(field, "Only 12 apples, 3.14 and version 1.2.3 of 2023-01-01, room 555-12.") == []
    nothing = personal.Field(np.zeros_like(field.unary), field.chain * 0, field.skip * 0)
    assert added(nothing, phone) == []


def test_query_follows_its_contract(llm):
    docs = {r.doc_id: r.text for r in table(llm, SF, "documents").collect()}
    got = queries.op12_personal_data(llm, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    more = 0
    for r in got:
        want = plain_spans(docs[r.doc_id] or "")
        text = [f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in sorted(want)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == no for k, _, _ in want) for no in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        mine = [s for s in r.spans.split(",") if s]
        assert set(text) <= set(mine) and len(set(mine)) == len(mine)
        more += bool(mine) and not text
    assert more <= len(docs) // 200  # documents without a base span are left alone


def test_masks_and_odd_rows(field, odd, empty):
    names = odd.withColumns({"spans": F.lit(1), "masked": F.lit(2)})
    rows = {(r.doc_id, r.row): r for r in personal.find_personal(names, field, masked=True).collect()}
    assert len(rows) == odd.count() and rows[0, 1].masked is None and rows[1, 1].masked == "" and rows[1, 1].spans == []
    texts = {(r.doc_id, r.row): r.text for r in odd.collect()}
    assert all(rows[k].masked == t for k, t in texts.items() if not re.search("[0-9]", t or ""))
    assert personal.find_personal(empty, field).count() == 0
    none = personal.learn_field(empty)
    assert not none.unary.any() and personal.find_personal(odd, none).count() == odd.count()
    one = odd.select(F.lit(1).alias("doc_id"), F.lit("é a.b@c.de, 10.0.0.1 é").alias("text")).limit(1)
    got = personal.find_personal(one, none, masked=True).first()
    assert got.masked == "é <email>, <ip> é" and [(s.kind, s.start, s.end, s.base) for s in got.spans] == [(0, 2, 10, True), (1, 12, 20, True)]
