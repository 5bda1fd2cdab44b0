"""Personal data: base patterns, and a skip-chain conditional random field that carries them through a document.

The base patterns tell e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, whole matches only. They
miss what stands beside other digits (two card numbers with a space between them are one match of 32 digits) or is
written otherwise than its twin. The field's nodes are all tokens that hold a digit or an ``@``; tokens one space apart
are chained, and tokens that repeat, or resemble, an earlier one of the document share a skip potential with it. Tokens in
base spans are observed; loopy belief propagation (sum-product, damped) gives the others their marginals, and what
is personal data with ``least`` probability becomes an added span.

The weights are learned by pseudo-likelihood from the base spans of a bounded sample of tokens; every example is learned
twice, the second time without its features, so that the potentials between tokens carry weight of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import blocks

# The kinds in their listed order; label 0 is none of them.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SPANS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

_ANY = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@][A-Za-z0-9@._%+()-]*+")
_IN_TOKEN = _LOCAL | frozenset("@()")
_WORD_BEFORE = re.compile(r"([A-Za-z]{1,20})[^A-Za-z0-9\n]{1,3}\Z")
_WORD_AFTER = re.compile(r"[^A-Za-z0-9\n]{1,3}([A-Za-z]{1,20})")
_NOT_DIGIT = re.compile("[^0-9]+")

#: Feature ids: 0 weighs nothing, 1 is always there, the others are hashed.
SPACE = 1 << 12
TEMPLATES = 9


@dataclass(frozen=True)
class FieldParams:
    """documents, tokens: about so many documents are read and at most so many tokens are drawn to learn from; steps,
    rate, penalty: of the fit; rounds, damping, close: of belief propagation; least: probability of an added span."""

    documents: int = 30_000
    tokens: int = 40_000
    steps: int = 150
    rate: float = 0.5
    penalty: float = 3e-5
    rounds: int = 40
    damping: float = 0.3
    close: float = 1e-4
    least: float = 0.9


@dataclass(frozen=True)
class Field:
    """Weights: features by label, a chain potential (left by right label) and a symmetric skip potential."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of all matches of the base patterns, leftmost and not overlapping within a kind.

    An address is found from its ``@``: its local part is what stands before, back to the last match. Every pattern
    reads each character a bounded number of times.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin, domain = at, _DOMAIN.match(text, at + 1)
        if domain:
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                last = domain.end()
                out.append((0, begin, last, True))
        at = text.find("@", max(at + 1, last))
    out += [(1, m.start(), m.end(), _is_ip(m.group())) for m in _IP.finditer(text)]
    out += [(2, m.start(), m.end(), _is_card(_NOT_DIGIT.sub("", m.group()))) for m in _DIGITS.finditer(text) if m.end() - m.start() >= 13]
    out += [(3, m.start(), m.end(), 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15) for m in _PHONE.finditer(text)]
    return out


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Start and end of every token that holds a digit or an ``@``, without dots, hyphens and brackets at its ends."""
    out, last = [], 0
    for m in _TOKEN.finditer(text):
        begin, end = m.start(), m.end()
        while begin > last and text[begin - 1] in _IN_TOKEN:
            begin -= 1
        last = end
        while begin < end and text[begin] in "._%-)":
            begin += 1
        while begin < end and text[end - 1] in "._%-+(":
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def _shape(token: str) -> str:
    runs = re.sub("[A-Za-z]+", "a", token[:64])
    return re.sub("[0-9]+", lambda m: "d" + str(min(len(m.group()), 20)), runs)[:32]


def _checks(token: str) -> str:
    digits = _NOT_DIGIT.sub("", token) if len(token) <= 64 else ""
    return "".join([
        "l" if _is_card(digits) else "n" if 13 <= len(digits) <= 19 else "-", "i" if token.count(".") == 3 and re.fullmatch(r"[0-9]{1,9}(\.[0-9]{1,9}){3}", token) and _is_ip(token) else "-",
        "e" if "@" in token and _DOMAIN.fullmatch(token, token.find("@") + 1) else "@" if "@" in token else "-", "+" if token[0] == "+" else "-",
    ])


def _hashed(kind: int, value: str) -> int:
    return 2 + crc32(f"{kind}:{value}".encode()) % (SPACE - 2)


def _keys(token: str) -> list[tuple[str, bool]]:
    """(key, whether it means a repeat and no mere likeness) by which tokens of a document are linked."""
    whole = token.lower().strip("()+")
    out = [(whole, True)] if len(whole) >= 4 else []
    digits = _NOT_DIGIT.sub("", token)
    if "@" in token:
        local = whole.split("@")[0]
        return [*out, (local, False)] if len(local) >= 4 else out
    if 7 <= len(digits) <= 12:
        out.append(("#" + digits[-7:], False))
    elif len(digits) > 12:
        out.append(("#" + digits, False))
    return out


@dataclass
class Graph:
    """Tokens of one document: places, features, observed label (0: no base span) and whether it can teach; edges."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    label: list[int]
    teaches: list[bool]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(text: str, matches: list[tuple[int, int, int, bool]]) -> Graph:
    """The field's graph of a text. A token is linked to the last one before it with an equal key, so edges are few.

    A token without a base span teaches "none" only where it is plainly outside: neither part of a match of several
    tokens that failed as a whole, nor linked to a token with a base span.
    """
    spans = tokens_of(text)
    words = [text[s:e] for s, e in spans]
    n = len(spans)
    chain = [(k, k + 1) for k in range(n - 1) if spans[k + 1][0] - spans[k][1] == 1 and text[spans[k][1]] == " "]
    left, right = {b: a for a, b in chain}, dict(chain)
    label, doubt = [0] * n, [False] * n
    starts = np.array([s for s, _ in spans], np.int64)
    for kind, start, end, valid in sorted(matches, key=lambda m: -m[0]):
        lo = max(0, int(np.searchsorted(starts, start, side="right")) - 1)
        hi = int(np.searchsorted(starts, end))
        inside = [k for k in range(lo, hi) if spans[k][1] > start]
        for k in inside:
            if valid:
                label[k] = kind + 1
            elif len(inside) > 1:
                doubt[k] = True
    seen: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for k, w in enumerate(words):
        for key, _ in _keys(w):
            if key in seen and seen[key] != k:
                skip.add((seen[key], k))
            seen[key] = k
    for a, b in skip:
        for x, y in ((a, b), (b, a)):
            if label[x] and not label[y]:
                doubt[y] = True
    shapes, checks = [_shape(w) for w in words], [_checks(w) for w in words]
    features = []
    for k, (s, e) in enumerate(spans):
        before, after = _WORD_BEFORE.search(text[max(0, s - 24) : s]), _WORD_AFTER.match(text[e : e + 24])
        near = [shapes[left[k]] if k in left else "", shapes[right[k]] if k in right else ""]
        values = [shapes[k], checks[k], checks[k] + str(min(e - s, 24)), before.group(1).lower() if before else "", after.group(1).lower() if after else "", near[0], near[1], checks[k] + near[0] + "|" + near[1]]
        features.append([1, *[_hashed(no, v) for no, v in enumerate(values)]])
    return Graph(spans, features, label, [label[k] > 0 or not doubt[k] for k in range(n)], chain, sorted(skip))


_EXAMPLE = "features array<int>, label int, before int, after int, linked array<int>, draw bigint"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens to learn from, with the labels of their neighbours (-1: none or in doubt; linked: a count a label)."""
    fields = [("features", pa.list_(pa.int32())), ("label", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("linked", pa.list_(pa.int32())), ("draw", pa.int64())]
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if not text or not _ANY.search(text):
                continue
            g = graph_of(text, base_matches(text))
            known = [y if t else -1 for y, t in zip(g.label, g.teaches, strict=True)]
            before, after = {b: known[a] for a, b in g.chain}, {a: known[b] for a, b in g.chain}
            linked: dict[int, list[int]] = {}
            for a, b in g.skip:
                for x, y in ((a, b), (b, a)):
                    if known[y] >= 0:
                        linked.setdefault(x, [0] * LABELS)[known[y]] += 1
            salt = crc32(text.encode())
            rows += [(g.features[k], known[k], before.get(k, -1), after.get(k, -1), linked.get(k, [0] * LABELS), crc32(f"{salt}:{k}".encode())) for k in range(len(known)) if known[k] >= 0]
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def learn_field(docs: DataFrame, text: str = "text", params: FieldParams | None = None) -> Field:
    """The field, learned from about ``documents`` texts drawn by a hash and at most ``tokens`` of their tokens.

    The sample is bounded by its parameters and drawn by hashes, so that any order of rows gives the same weights.
    Without examples all weights are zero, and no span is ever added.
    """
    params = params or FieldParams()
    share = max(1, docs.count() // params.documents)
    drawn = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(share)) == 0).select(F.col(text).alias("text"))
    rows = drawn.mapInArrow(_examples, _EXAMPLE).orderBy("draw", "label", "features").limit(params.tokens).toArrow()
    if not rows.num_rows:
        return Field(np.zeros((SPACE, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    features = np.array(rows["features"].to_pylist(), np.int64)
    linked = np.array(rows["linked"].to_pylist(), float)
    label, before, after = (rows[c].to_numpy().astype(np.int64) for c in ("label", "before", "after"))
    return fit_field(features, label, before, after, linked, params)


def fit_field(features: np.ndarray, label: np.ndarray, before: np.ndarray, after: np.ndarray, linked: np.ndarray, params: FieldParams) -> Field:
    """Maximum pseudo-likelihood with a quadratic penalty, by steps along the gradient that are scaled per weight."""
    bare = np.zeros_like(features)
    bare[:, 0] = 1
    features, label, before, after, linked = np.concatenate([features, bare]), np.tile(label, 2), np.tile(before, 2), np.tile(after, 2), np.tile(linked, (2, 1))
    n, ones = len(label), np.eye(LABELS)
    left, right = np.where(before[:, None] >= 0, ones[before], 0), np.where(after[:, None] >= 0, ones[after], 0)
    unary, chain, skip = np.zeros((SPACE, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    squares = [np.full_like(w, 1e-8) for w in (unary, chain, skip)]
    flat, target = features.ravel(), ones[label]
    for _ in range(params.steps):
        score = unary[features].sum(1) + left @ chain + right @ chain.T + linked @ skip
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        off = p / p.sum(1, keepdims=True) - target
        spread = np.repeat(off, features.shape[1], axis=0)
        g_unary = np.stack([np.bincount(flat, spread[:, c], SPACE) for c in range(LABELS)], axis=1)
        g_unary[0] = 0
        g_skip = linked.T @ off
        for w, g, s in zip((unary, chain, skip), (g_unary, left.T @ off + (right.T @ off).T, (g_skip + g_skip.T) / 2), squares, strict=True):
            g = g / n + params.penalty * w
            s += g * g
            w -= params.rate * g / np.sqrt(s)
    return Field(unary, chain, skip)


def marginals(scores: np.ndarray, edges: np.ndarray, potential: np.ndarray, params: FieldParams) -> np.ndarray:
    """Label probabilities of every node by damped sum-product belief propagation, exact where there is no loop.

    scores: log potentials of nodes; edges: pairs of nodes; potential: log potentials of edges, first node by second.
    """
    n, m = len(scores), len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, LABELS))

    def belief() -> np.ndarray:
        total = scores.copy()
        for c in range(LABELS):
            total[:, c] += np.bincount(target, message[:, c], n)
        return total

    for _ in range(params.rounds if m else 0):
        out = belief()[source] - message[back]
        out -= out.max(1, keepdims=True)
        new = np.log(np.einsum("ex,exy->ey", np.exp(out), pair) + 1e-300)
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = params.damping * message + (1 - params.damping) * new
        if moved < params.close:
            break
    total = belief() if m else scores.copy()
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(graphs: list[Graph], field: Field, params: FieldParams) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) per graph: tokens outside base spans that the field labels; chained ones of a kind in one."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in graphs]
    open_ones = [k for k, g in enumerate(graphs) if 0 in g.label]
    if not open_ones:
        return out
    base, edges, pots, scores = 0, [np.zeros((0, 2), np.int64)], [np.zeros((0, LABELS, LABELS))], []
    for k in open_ones:
        g = graphs[k]
        u = field.unary[np.array(g.features)].sum(1)
        seen = np.array(g.label)
        u[seen > 0] = -50.0
        u[seen > 0, seen[seen > 0]] = 0.0
        scores.append(u)
        for pairs, w in ((g.chain, field.chain), (g.skip, field.skip)):
            if pairs:
                edges.append(np.array(pairs) + base)
                pots.append(np.broadcast_to(w, (len(pairs), LABELS, LABELS)))
        base += len(seen)
    p = marginals(np.concatenate(scores), np.concatenate(edges), np.concatenate(pots), params)
    base = 0
    for k in open_ones:
        g = graphs[k]
        mine = p[base : base + len(g.label)]
        base += len(g.label)
        best = mine.argmax(1)
        chained = {b for _, b in g.chain}
        previous = -2
        for t in np.flatnonzero((np.array(g.label) == 0) & (best > 0) & (mine.max(1) >= params.least)).tolist():
            kind, (start, end) = int(best[t]) - 1, g.spans[t]
            if KINDS[kind] == "phone" and previous == t - 1 and t in chained and best[previous] == best[t]:
                out[k][-1] = (kind, out[k][-1][1], end)
            else:
                out[k].append((kind, start, end))
            previous = t
    return out


def find_personal(docs: DataFrame, field: Field, text: str = "text", masked: bool = False, params: FieldParams | None = None) -> DataFrame:
    """``docs`` without its text, with spans (kind, start, end, base; by kind, then start; code points, end exclusive).

    masked: also a column masked, the text with every span replaced by its kind in angle brackets (of overlapping spans
    the first to start, or the longer, is replaced). A null text has no spans and is masked as null. Rows are handled each by itself: repeated rows and equal
    or null ids stay; columns named spans or masked are replaced; an empty table stays empty.
    """
    params = params or FieldParams()
    kept = [c for c in docs.columns if c not in (text, "spans", "masked")]
    rows = docs.select(*kept, F.col(text).alias("masked"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"spans {SPANS}"] + (["masked string"] if masked else []))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in blocks([t or "" for t in texts]):
                matches, graphs, held = [], [], []
                for k in range(lo, hi):
                    found = base_matches(texts[k]) if texts[k] and _ANY.search(texts[k]) else []
                    matches.append([(kind, s, e, True) for kind, s, e, valid in found if valid])
                    if texts[k] and _ANY.search(texts[k]):
                        graphs.append(graph_of(texts[k], found))
                        held.append(k - lo)
                for at, more in zip(held, added_spans(graphs, field, params), strict=True):
                    matches[at] += [(*m, False) for m in more]
                spans = pa.array([[dict(zip(("kind", "start", "end", "base"), m, strict=True)) for m in sorted(ms)] for ms in matches], _SPANS)
                columns = [*batch.slice(lo, hi - lo).columns[:-1], spans]
                if masked:
                    columns.append(pa.array([_mask(texts[lo + k], ms) for k, ms in enumerate(matches)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "spans"] + (["masked"] if masked else []))

    return rows.mapInArrow(find, schema)


def _mask(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda m: (m[1], -m[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
