"""Evidence with version histories: every line of the acceptance table, the ledger check, scopes, and the whole import."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import evidence as ev
from tallyhouse.operators import imports as im
from tallyhouse.operators import scopes



@pytest.fixture(scope="module", autouse=True)
def small_frames(spark):
    """A few rows a step: compiling and re-planning would take longer than the work."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


D = datetime.date(2025, 1, 4)
E = D + datetime.timedelta(days=1)
PARTS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "reasoning_tokens")
BASE = dict(snapshot_key=None, day=D, source="tool", provider="p", surface="cli", account_alias="a", origin="m/1", machine_alias=None, authority="tool", fidelity="exact", tokens=10, calls=2, coverage=None, coverage_reasons=None, token_components=None, keys=None)


def parts(**told):
    return tuple(told.get(p) for p in PARTS)


def version(tokens=10, calls=2, keys=(), coverage=None, reasons=None, components=None):
    return dict(tokens=tokens, calls=calls, keys=list(keys), coverage=coverage, coverage_reasons=reasons, token_components=components)


FLAT = "snapshot_key string, day date, source string, provider string, surface string, account_alias string, origin string, machine_alias string, authority string, fidelity string, tokens long, calls long, coverage string, coverage_reasons array<string>, token_components " + ev.PARTS + ", keys array<string>"


def frames(spark, rows):
    """(receipts, identities) of {receipt_id: changes to BASE}."""
    data = [(i, *{**BASE, **r}.values()) for i, r in rows.items()]
    df = spark.createDataFrame(data, "receipt_id string, " + FLAT)
    return df.drop("keys"), ev.identities_of(df)


def key_set(spark, keys):
    df = spark.createDataFrame([("x", list(keys))], "receipt_id string, keys array<string>")
    return ev.with_key_sets(df, ev.identities_of(df)).first()


def ledger_of(spark, rows):
    """(ledger, identities) of {entry_id: changes}; acceptance is accepted, history a list of versions."""
    names = list(BASE)
    data, state = [], []
    for i, r in rows.items():
        r = dict(r)
        history = []
        for v in r.pop("history", []):
            s = key_set(spark, v["keys"])
            history.append((v["tokens"], v["calls"], s.n_keys, s.key_set, v["coverage"], v["coverage_reasons"], v["token_components"]))
        state.append((i, r.pop("acceptance", "accepted"), r.pop("disposition", None), history))
        data.append((i, *[{**BASE, **r}[n] for n in names]))
    df = spark.createDataFrame(data, "entry_id string, " + FLAT)
    ids = ev.identities_of(df, name="entry_id")
    st = spark.createDataFrame(state, f"entry_id string, acceptance string, disposition string, history array<{ev.VERSION}>")
    out = ev.with_key_sets(df.drop("keys"), ids, "entry_id").join(st, "entry_id").withColumns({"acceptance_basis": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "correction": F.lit(None).cast("string")})
    return out.select("entry_id", *ev.FIELDS, *ev.STATE), ids


def accept(spark, ledger, incoming, exact=((D, "tool"),), fixes=()):
    lg, li = ledger_of(spark, ledger)
    rc, ri = frames(spark, incoming)
    batch = ev.reconcile_batch(rc, ri)
    assert batch.errors.count() == 0
    ex = spark.createDataFrame(list(exact), "day date, source string")
    fx = spark.createDataFrame([(i, "reviewed") for i in fixes] + [("none", " ")], "receipt_id string, reason string")
    out = ev.accept_evidence(lg, li, batch.receipts, batch.identities, ex, fx)
    after, ids = ev.apply_outcomes(lg, li, batch.receipts, batch.identities, out, fx)
    return {r.receipt_id: r for r in out.collect()}, {r.entry_id: r for r in after.collect()}, {k: {r.key for r in g} for k, g in itertools.groupby(sorted(ids.collect()), key=lambda r: r.entry_id)}


#: ledger entries, each for one line of the table, and what meets it: name -> (entry, receipt, outcome, why, change)
CASES = {
    "free_equal": ({}, {}, "replay", "", ""),
    "free_detail": ({}, dict(token_components=parts(input_tokens=7)), "updated", "", "detail"),
    "free_other": ({}, dict(tokens=11), "error", "uncheckable", ""),
    "free_clash": (dict(token_components=parts(input_tokens=8)), dict(token_components=parts(input_tokens=7)), "error", "component", ""),
    "free_legacy": (dict(acceptance="legacy-unverified"), {}, "promoted", "", "promote"),
    "free_legacy_other": (dict(acceptance="legacy-unverified"), dict(tokens=11), "added", "", "new"),
    "free_other_scope": (dict(origin="m/2"), {}, "added", "", "new"),
    "free_wild_scope": (dict(origin=None, surface=None), {}, "replay", "", ""),
    "snap_scope": (dict(snapshot_key="S"), dict(snapshot_key="S", surface="web"), "error", "snapshot_scope", ""),
    "snap_day": (dict(snapshot_key="S"), dict(snapshot_key="S", day=E), "error", "snapshot_scope", ""),
    "snap_equal": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="S", keys=["k"]), "replay", "", ""),
    "snap_detail": (dict(snapshot_key="S", token_components=parts(input_tokens=7)), dict(snapshot_key="S", token_components=parts(output_tokens=3), coverage="incomplete", coverage_reasons=["gap"]), "updated", "", "detail"),
    "snap_less_detail": (dict(snapshot_key="S", token_components=parts(input_tokens=7)), dict(snapshot_key="S"), "replay", "", ""),
    "snap_clash": (dict(snapshot_key="S", token_components=parts(input_tokens=7)), dict(snapshot_key="S", token_components=parts(input_tokens=6)), "error", "component", ""),
    "snap_prior": (dict(snapshot_key="S", keys=["k", "q"], tokens=20, calls=5, history=[version(9, 9, ["k"])]), dict(snapshot_key="S", keys=["k"], tokens=9, calls=9), "replay", "", ""),
    "snap_crossing": (dict(snapshot_key="S", tokens=20, calls=5), dict(snapshot_key="S", tokens=9, calls=9), "error", "crossing", ""),
    "snap_forward": (dict(snapshot_key="S", keys=["k"], history=[version(1, 1, ["k"])]), dict(snapshot_key="S", keys=["k", "z"], tokens=11), "updated", "", "forward"),
    "snap_lost": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="S", keys=["z"], tokens=11), "error", "identity_loss", ""),
    "snap_behind": (dict(snapshot_key="S"), dict(snapshot_key="S", tokens=9), "replay", "", ""),
    "snap_no_calls": (dict(snapshot_key="S", calls=None), dict(snapshot_key="S", tokens=12), "updated", "", "forward"),
    "keys_weaker": (dict(snapshot_key="S", keys=["k", "l"], authority="provider"), dict(snapshot_key="T", keys=["l", "k"], source="other"), "replay", "", "weaker"),
    "keys_stronger": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], authority="provider", source="other"), "added", "", "supersede"),
    "keys_lower": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], authority="provider", tokens=9), "error", "decrease", ""),
    "keys_estimate": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], authority="provider", fidelity="estimated"), "error", "decrease", ""),
    "keys_equal": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"]), "replay", "", ""),
    "keys_equal_rank": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], tokens=11), "error", "equal_authority", ""),
    "keys_equal_source": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], source="other"), "error", "equal_authority", ""),
    "keys_partial": (dict(snapshot_key="S", keys=["k", "l"]), dict(snapshot_key="T", keys=["k"]), "error", "partial", ""),
    "keys_account": (dict(snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k"], account_alias="b", authority="provider"), "error", "cross_scope", ""),
    "keys_local": (dict(snapshot_key="S", keys=["k"], provider=None, account_alias=None), dict(snapshot_key="T", keys=["k"], provider=None, account_alias=None, authority="provider"), "added", "", "supersede"),
    "legacy_grown": (dict(acceptance=None, snapshot_key="S", keys=["k"]), dict(snapshot_key="T", keys=["k", "l"], tokens=11), "promoted", "", "promote"),
    "legacy_equal": (dict(acceptance=None, snapshot_key="S"), dict(snapshot_key="S"), "promoted", "", "promote"),
    "legacy_lower": (dict(acceptance=None, snapshot_key="S"), dict(snapshot_key="S", tokens=9), "error", "legacy_ambiguous", ""),
    "legacy_lost": (dict(acceptance=None, snapshot_key="S", keys=["k", "l"]), dict(snapshot_key="S", keys=["k"], tokens=11), "error", "legacy_ambiguous", ""),
    "legacy_scope": (dict(acceptance=None, snapshot_key="S", keys=["k"]), dict(snapshot_key="S", keys=["k"], surface="web"), "error", "legacy_scope", ""),
    "retired": (dict(snapshot_key="S", keys=["k"], disposition="superseded"), dict(snapshot_key="S", keys=["k"], tokens=11), "added", "", "new"),
}


def own(name, row):
    """The case with names of its own, so that all cases fit one ledger and one batch."""
    row = dict(row)
    for field in ("snapshot_key", "account_alias"):
        if row.get(field, BASE[field]) is not None:
            row[field] = f"{name}:{row.get(field, BASE[field])}"
    if row.get("account_alias", "") is None:
        row["origin"] = f"{name}:m"
    if row.get("keys"):
        row["keys"] = [f"{name}:{k}" for k in row["keys"]]
    if "history" in row:
        row["history"] = [{**v, "keys": [f"{name}:{k}" for k in v["keys"]]} for v in row["history"]]
    return row


def test_every_line_of_the_table(spark):
    out, after, ids = accept(spark, {n: own(n, c[0]) for n, c in CASES.items()}, {f"in_{n}": own(n, c[1]) for n, c in CASES.items()}, exact=((D, "tool"),))
    got = {n: (out[f"in_{n}"].outcome, out[f"in_{n}"].why, out[f"in_{n}"].change) for n in CASES}
    assert got == {n: c[2:] for n, c in CASES.items()}
    assert all(out[f"in_{n}"].entry_id == (None if c[4] == "new" else n) for n, c in CASES.items())
    # what the changes leave behind
    forward = after["snap_forward"]
    assert (forward.tokens, [v.tokens for v in forward.history], ids["snap_forward"]) == (11, [1, 10], {"snap_forward:k", "snap_forward:z"}) and forward.n_keys == 2
    detail = after["snap_detail"]
    assert (detail.token_components.input_tokens, detail.token_components.output_tokens, detail.coverage, detail.coverage_reasons, detail.history) == (7, 3, "incomplete", ["gap"], [])
    assert (after["keys_stronger"].disposition, after["keys_stronger"].superseded_by, after["in_keys_stronger"].acceptance) == ("superseded", "in_keys_stronger", "accepted")
    assert (after["legacy_grown"].acceptance, after["legacy_grown"].acceptance_basis, after["legacy_grown"].snapshot_key) == ("accepted", ev.MIGRATED, "legacy_grown:T")
    assert {n for n in after if n.startswith("in_")} == {f"in_{n}" for n, c in CASES.items() if c[2] == "added"}
    assert after["free_other"].tokens == 10 and after["snap_lost"].tokens == 10


def test_reviewed_receipts(spark):
    names = ["free_other", "snap_crossing", "snap_lost", "snap_behind", "keys_lower", "legacy_lower", "legacy_lost", "keys_partial", "snap_scope", "snap_equal"]
    out, after, ids = accept(spark, {n: own(n, CASES[n][0]) for n in names}, {f"in_{n}": own(n, CASES[n][1]) for n in names}, fixes=[f"in_{n}" for n in names])
    assert {n: out[f"in_{n}"].change for n in names} == {"free_other": "forward", "snap_crossing": "forward", "snap_lost": "forward", "snap_behind": "forward", "keys_lower": "supersede", "legacy_lower": "promote", "legacy_lost": "promote", "keys_partial": "", "snap_scope": "", "snap_equal": "forward"}
    assert (after["free_other"].acceptance_basis, after["free_other"].correction, [v.tokens for v in after["free_other"].history]) == (ev.REVIEWED, "reviewed", [10])
    assert ids["snap_lost"] == {"snap_lost:k", "snap_lost:z"} and ids["legacy_lost"] == {"legacy_lost:k", "legacy_lost:l"}


def test_several_entries_and_contested_ones(spark):
    ledger = {"a": dict(snapshot_key="A", keys=["1"]), "b": dict(snapshot_key="B", keys=["2"]), "l": dict(snapshot_key="L", keys=["3"], acceptance=None), "m": dict(snapshot_key="M", keys=["4"], acceptance=None), "f": dict(account_alias="f", origin="m/9"), "g": dict(account_alias="f", origin="m/8")}
    new = {"two": dict(snapshot_key="N", keys=["1", "2"]), "legacies": dict(snapshot_key="O", keys=["3", "4"]), "wild": dict(account_alias="f", origin=None), "thief": dict(snapshot_key="A", keys=["1", "2"], tokens=12, origin="m/1", account_alias="a")}
    lg, li = ledger_of(spark, ledger)
    rc, ri = frames(spark, new)
    out = ev.accept_evidence(lg, li, ev.with_key_sets(ev.normalized(rc), ri), ri, spark.createDataFrame([], "day date, source string"))
    assert {r.receipt_id: r.why for r in out.collect()} == {"two": "several_entries", "legacies": "several_entries", "wild": "several_entries", "thief": "foreign_identity"}
    lg, li = ledger_of(spark, {"l": dict(snapshot_key="L", acceptance=None, keys=["1", "2"])})
    rc, ri = frames(spark, {"x": dict(snapshot_key="L", keys=["1", "2", "3"], tokens=11), "y": dict(snapshot_key="K", keys=["1", "2", "4"], tokens=12)})
    out = ev.accept_evidence(lg, li, ev.with_key_sets(ev.normalized(rc), ri), ri, spark.createDataFrame([], "day date, source string"))
    assert {r.receipt_id: r.why for r in ev.entry_conflicts(out).collect()} == {"x": "contested_entry", "y": "contested_entry"}


def test_batch(spark):
    rows = {
        "v1": dict(snapshot_key="S", keys=["a"]), "v2": dict(snapshot_key="S", keys=["a", "b"], tokens=12, calls=3, token_components=parts(input_tokens=5)), "v3": dict(snapshot_key="S", keys=["b", "a"], tokens=12, calls=3, token_components=parts(output_tokens=7), coverage="incomplete", coverage_reasons=["gap"]),
        "c1": dict(snapshot_key="C", tokens=5, calls=9), "c2": dict(snapshot_key="C", tokens=9, calls=5), "d1": dict(snapshot_key="D", surface="x"), "d2": dict(snapshot_key="D"), "e1": dict(snapshot_key="E", token_components=parts(input_tokens=5)), "e2": dict(snapshot_key="E", token_components=parts(input_tokens=6)),
        "i1": dict(snapshot_key="I", keys=["x", "y"]), "i2": dict(snapshot_key="I", keys=["x"], tokens=12), "strong": dict(keys=["g"], authority="provider"), "weak": dict(keys=["g"], source="t2"), "same1": dict(keys=["h"]), "same2": dict(keys=["h"], source="t2"),
        "p1": dict(keys=["q", "r"]), "p2": dict(keys=["r"]), "day1": dict(keys=["u"]), "day2": dict(keys=["u"], day=E), "acc1": dict(keys=["w"], provider=None), "acc2": dict(keys=["w"], authority="provider"), "free": {},
    }
    batch = ev.reconcile_batch(*frames(spark, rows))
    assert {r.receipt_id: r.why for r in batch.errors.collect()} == {"c2": "crossing", "d1": "conflict", "e1": "component", "i2": "identity_loss"} | {k: w for w, ks in {"equal_authority": ("same1", "same2"), "partial": ("p1", "p2"), "cross_date": ("day1", "day2"), "cross_scope": ("acc1", "acc2")}.items() for k in ks}
    kept = {r.receipt_id: r for r in batch.receipts.collect()}
    assert set(kept) == {"v2", "strong", "free"} and kept["v2"].token_components[:2] == (5, 7) and kept["v2"].coverage_reasons == ["gap"] and kept["v2"].n_keys == 2
    assert {r.key for r in batch.identities.collect()} == {"a", "b", "g"}


def test_batch_does_not_depend_on_order(spark):
    rng = random.Random(4)
    rows = {f"r{i}": dict(snapshot_key=rng.choice([None, "S", "T", "U"]), keys=rng.sample("abcd", rng.randint(0, 2)), tokens=rng.randint(8, 12), calls=rng.choice([None, 1, 2]), authority=rng.choice(["tool", "provider"])) for i in range(25)}
    want = None
    for _ in range(3):
        items = list(rows.items())
        rng.shuffle(items)
        rc, ri = frames(spark, dict(items))
        batch = ev.reconcile_batch(rc.repartition(rng.randint(1, 7)), ri)
        got = (sorted(map(str, batch.receipts.collect())), sorted(map(str, batch.errors.collect())))
        want = want or got
        assert got == want


def test_ledger_check(spark):
    ledger = {
        "cur": dict(snapshot_key="A", keys=["1"]), "hist": dict(snapshot_key="B", tokens=20, history=[version(5, 2)]), "evo": dict(snapshot_key="C"), "var": dict(snapshot_key="D", tokens=20), "leg": dict(snapshot_key="E", acceptance=None), "legkey": dict(keys=["5"], acceptance=None),
        "lost": dict(snapshot_key="F", keys=["6"]), "cross": dict(snapshot_key="G", tokens=20, calls=1), "scope": dict(snapshot_key="H"), "part": dict(keys=["7", "8"]), "gone": dict(snapshot_key="I", keys=["9"], disposition="superseded"),
    }
    new = {
        "cur": (dict(snapshot_key="A", keys=["1"]), {"counted"}), "hist": (dict(snapshot_key="B", tokens=5), {"older_version", "counted"}), "evo": (dict(snapshot_key="C", tokens=11), {"evolved"}), "var": (dict(snapshot_key="D", tokens=19), {"variant"}), "leg": (dict(snapshot_key="E"), {"legacy_hit"}),
        "legkey": (dict(snapshot_key="x", keys=["5"]), {"legacy_hit"}), "lost": (dict(snapshot_key="F", tokens=30), {"conflict_identities"}), "cross": (dict(snapshot_key="G", tokens=19, calls=3), {"conflict_crossing"}), "scope": (dict(snapshot_key="H", day=E), {"conflict_scope"}),
        "part": (dict(keys=["7"]), {"conflict_partial"}), "rank": (dict(keys=["8", "7"], authority="provider", source="other"), {"counted"}), "gone": (dict(snapshot_key="z", keys=["9"]), {"counted"}), "free": ({}, {"uncheckable"}), "new": (dict(snapshot_key="N"), {"new"}), "newkey": (dict(keys=["77"]), {"new"}),
    }
    lg, li = ledger_of(spark, ledger)
    rc, ri = frames(spark, {k: v[0] for k, v in new.items()})
    got = {}
    for r in ev.check_evidence(lg, li, ev.with_key_sets(ev.normalized(rc), ri), ri).collect():
        got.setdefault(r.receipt_id, set()).add(r["class"])
    assert got == {k: v[1] for k, v in new.items()}


def test_wildcard_scopes(spark):
    rng = random.Random(9)
    wild = ("a", "b", "c", "d", "e")
    rows = lambda n: [(i, rng.choice(["x", "y", None]), *[rng.choice([None, "1", "2"]) for _ in wild]) for i in range(n)]
    left, right = rows(120), rows(90)
    schema = "{} long, k string, " + ", ".join(f"{w} string" for w in wild)
    l, r = spark.createDataFrame(left, schema.format("i")), spark.createDataFrame(right, schema.format("j"))  # noqa: E741
    agree = lambda x, y: x[1] is not None and x[1] == y[1] and all(p is None or q is None or p == q for p, q in zip(x[2:], y[2:], strict=True))
    want = {(x[0], y[0]) for x in left for y in right if agree(x, y)}
    pairs = scopes.wildcard_join(l, r, ("k",), wild)
    assert sorted((p.i, p.j) for p in pairs.collect()) == sorted(want)
    counts = {m.i: (m._n, m._first) for m in scopes.wildcard_matches(l, r, ("k",), wild, "j", ("i",)).collect()}
    assert counts == {i: (len(js), min(js)) for i, js in ((i, [j for a, j in want if a == i]) for i in {a for a, _ in want})}
    assert scopes.wildcard_join(l, r.limit(0), ("k",), wild).count() == 0


CONTRACT = dict(schema_version=2, timezone="UTC", first=None, last=None, models=None, driver=None)


def importable(spark, rows):
    rc, ri = frames(spark, rows)
    rc = rc.withColumns({"schema_version": F.lit(2), "timezone": F.lit("UTC"), "first": F.col("day"), "last": F.col("day"), "models": F.lit(None).cast("array<string>"), "driver": F.when(F.col("receipt_id") == "r1", "shipping")})
    return rc.withColumn("snapshot_key", F.coalesce("snapshot_key", F.concat(F.lit("snap:"), "receipt_id"))), ri.withColumn("key", F.concat(F.lit("sha256:"), F.sha2("key", 256)))


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], ev.LEDGER_SCHEMA), spark.createDataFrame([], ev.IDENTITY_SCHEMA), spark.createDataFrame([], im.DAILY_SCHEMA)


POLICY = im.Policy(as_of="2025-01-20", window_start="2025-01-01")


def found(plan):
    return sorted((r.step, r.why) for r in plan.errors.collect())


def entries(plan):
    return {(r.day.day, r.source): r for r in plan.daily.collect()}


def test_import_and_import_again(spark, nothing):
    rows = {"r1": dict(keys=["a", "b"], token_components=parts(input_tokens=4, output_tokens=6)), "r2": dict(keys=["c"], origin="m/2", tokens=5, calls=None, token_components=parts(input_tokens=5)), "r3": dict(day=E, source="other", fidelity="estimated", coverage="incomplete", coverage_reasons=["gap"])}
    first = im.plan_import(*importable(spark, rows), *nothing, POLICY)
    assert found(first) == []
    got = entries(first)
    one, two = got[4, "tool"], got[5, "other"]
    assert (one.tokens, one.calls, one.by_origin, one.token_components[:2], one.driver, one.authority) == (15, 2, {"m/1": 10, "m/2": 5}, (9, None), "shipping", "tool")
    assert (two.driver, two.fidelity, two.coverage_reasons) == ("unreviewed", "estimated", ["gap"])
    again = im.plan_import(*importable(spark, rows), first.ledger, first.identities, first.daily, POLICY)
    assert found(again) == [] and {r.outcome for r in again.outcomes.collect()} == {"replay"}
    text = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())
    assert text(again.daily) == text(first.daily) and text(again.ledger) == text(first.ledger)
    grown = {**rows, "r1": {**rows["r1"], "keys": ["a", "b", "z"], "tokens": 11, "token_components": parts(input_tokens=5, output_tokens=6)}}
    more = im.plan_import(*importable(spark, grown), first.ledger, first.identities, first.daily, POLICY)
    assert found(more) == [] and entries(more)[4, "tool"].tokens == 16 and {r.entry_id: len(r.history) for r in more.ledger.collect()} == {"r1": 1, "r2": 0, "r3": 0}
    # going back is seen for what it is: the versions are known, the figure would fall
    back = im.plan_import(*importable(spark, rows), more.ledger, more.identities, more.daily, POLICY)
    assert {r.outcome for r in back.outcomes.collect()} == {"replay"} and ("decrease", "tokens") in found(back)


def test_import_with_a_stronger_receipt(spark, nothing):
    rows = {"r1": dict(keys=["a"], token_components=parts(input_tokens=4)), "r2": dict(keys=["b"], origin="m/2", tokens=5, token_components=parts(input_tokens=5))}
    first = im.plan_import(*importable(spark, rows), *nothing, POLICY)
    strong = {"p1": dict(keys=["a"], source="report", authority="provider", tokens=12, calls=2, origin="account/a")}
    plan = im.plan_import(*importable(spark, strong), first.ledger, first.identities, first.daily, POLICY)
    got = entries(plan)
    assert found(plan) == [] and got[4, "report"].tokens == 12
    left = got[4, "tool"]
    assert (left.tokens, left.calls, left.by_origin, left.token_components[0], left.driver, left.authority) == (5, 2, {"m/2": 5}, 5, "shipping", "tool")
    weak = im.plan_import(*importable(spark, {**rows, "r1": {**rows["r1"]}}), plan.ledger, plan.identities, plan.daily, POLICY)
    assert {r.receipt_id: r.change for r in weak.outcomes.collect()} == {"r1": "weaker", "r2": ""} and entries(weak)[4, "tool"].tokens == 5 and found(weak) == []


def test_import_gates(spark, nothing):
    rows = {"r1": dict(keys=["a"]), "r2": dict(day=E, source="other"), "open": dict(day=datetime.date(2025, 1, 19), source="late"), "future": dict(day=datetime.date(2025, 2, 1)), "early": dict(day=datetime.date(2024, 12, 1)), "bad": dict(fidelity="odd", tokens=-1), "zone": {}}
    rc, ri = importable(spark, rows)
    rc = rc.withColumn("timezone", F.when(F.col("receipt_id") == "zone", "CET").otherwise("UTC"))
    base = im.plan_import(rc, ri, *nothing, POLICY)
    assert found(base) == [("contract", "fidelity,tokens"), ("contract", "timezone"), ("window", "date"), ("window", "date")] and {r.receipt_id: r.state for r in base.aside.collect()} == {"open": "held"}
    policy = lambda *rows: spark.createDataFrame(list(rows), "day date, source string, tokens bigint, calls bigint")
    again = lambda rows, **kw: im.plan_import(*importable(spark, rows), base.ledger, base.identities, base.daily, kw.pop("policy", POLICY), **kw)
    # settled: own origins are dropped, a foreign one is refused, missing and changed entries are seen; calls count
    plan = again({"r1": dict(keys=["a"], tokens=3), "n": dict(keys=["n"], origin="m/77")}, settled=policy((D, "tool", 10, 2), (E, "other", 10, 3), (D, "gone", 1, 1)), exclusions=policy((D, "tool", 10, None)))
    assert found(plan) == sorted([("settled", "foreign_origin"), ("policy", "settled_and_excluded"), ("exclusion", "exclusion_mismatch"), *[(s, w) for s in ("settled_before", "settled_after") for w in ("changed", "missing")]])
    assert {r.receipt_id: r.state for r in plan.aside.collect()} == {"r1": "settled"} and entries(plan)[4, "tool"].tokens == 10
    # exclusions: exact figures go after the merge, days without entries vanish, and what is excluded retires nothing
    out = again({"p1": dict(keys=["a"], authority="provider", source="report", tokens=12), "r2": dict(day=E, source="other")}, exclusions=policy((D, "report", 12, 2), (E, "nothing", 5, 5), (E, "other", 10, 2)))
    assert found(out) == [("transition", "excluded_authority")] and entries(out) == {} and {r.source: r.disposition for r in out.ledger.collect()} == {"tool": "superseded", "report": "excluded", "other": "excluded"}
    # daily mode takes the open week but for today; the horizon leaves final days alone
    late = again({"t": dict(day=datetime.date(2025, 1, 19), source="late"), "u": dict(day=datetime.date(2025, 1, 20), source="late"), "r1": dict(keys=["a"], tokens=1)}, policy=im.Policy("2025-01-20", "2025-01-01", weekly=False, horizon=7))
    assert found(late) == [] and (19, "late") in entries(late) and {r.receipt_id: r.state for r in late.aside.collect()} == {"u": "held", "r1": "final"}


def test_reviewed_decrease(spark, nothing):
    base = im.plan_import(*importable(spark, {"r1": dict(keys=["a"]), "r2": dict(keys=["b"], origin="m/2")}), *nothing, POLICY)
    fix = spark.createDataFrame([("r1", "counted twice")], "receipt_id string, reason string")
    lower = {"r1": dict(keys=["a"], tokens=4)}
    plan = im.plan_import(*importable(spark, lower), base.ledger, base.identities, base.daily, POLICY, corrections=fix)
    assert found(plan) == [] and entries(plan)[4, "tool"].tokens == 4
    ledger = {r.entry_id: r for r in plan.ledger.collect()}
    assert (ledger["r1"].correction, ledger["r1"].history[0].tokens, ledger["r2"].disposition) == ("counted twice", 10, "corrected-out")


def test_sample_days_and_differences(spark, nothing):
    daily = spark.createDataFrame([(D, "old", "UTC", "writing", "e", 7, None, "sample", None, None, None, None, None), (E, "old", "UTC", "writing", "e", 7, 1, "exact", "tool", None, None, None, {"m/1": 7})], im.DAILY_SCHEMA)
    plan = im.plan_import(*importable(spark, {"r1": dict(keys=["a"])}), nothing[0], nothing[1], daily, POLICY)
    assert found(plan) == [] and set(entries(plan)) == {(4, "tool"), (5, "old")} and entries(plan)[4, "tool"].driver == "writing"
    assert {(r.day, r.why) for r in im.entry_differences(plan.ledger, plan.daily).collect()} == {(E, "dataset")}
    other = plan.daily.withColumn("by_origin", F.create_map(F.lit("m/1"), F.lit(9).cast("bigint")))
    assert {(r.day, r.why) for r in im.entry_differences(plan.ledger, other).collect()} == {(E, "dataset"), (D, "by_origin")}
    told = plan.daily.withColumn("token_components", F.from_json(F.lit('{"input_tokens": 3}'), ev.PARTS))
    assert (D, "token_components") in {(r.day, r.why) for r in im.entry_differences(plan.ledger, told).collect()}
