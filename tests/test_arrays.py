"""Items of JSON arrays that are read in ranges of bytes."""

import json
import random

import pytest

from tallyhouse.sources import arrays


def value(rng, depth=0):
    r = rng.random()
    text = lambda: "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", "é", "\U0001f600", "\n", "a", " "]) for _ in range(rng.randint(0, 12)))
    if depth < 3 and r < 0.35:
        return {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 3 and r < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([text(), rng.randint(-9, 9), None, True, 1.5, text() * 20])


@pytest.mark.parametrize("size", ["900", "134217728"])
def test_items_equal_the_whole_parse(spark, tmp_path, size):
    rng = random.Random(int(size))
    files = {f"f{k}": [value(rng) for _ in range(n)] for k, n in enumerate([0, 1, 2, 25, 12])}
    for k, (name, items) in enumerate(files.items()):
        (tmp_path / f"{name}.json").write_text(json.dumps(items, ensure_ascii=bool(k % 2), indent=k if k > 2 else None) + "\n" * (k % 3), encoding="utf-8")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], size)
    spark.conf.set(keys[1], "1")
    try:
        got: dict = {}
        for r in arrays.array_items(spark, f"file://{tmp_path}").collect():
            got.setdefault(r.file.rsplit("/", 1)[1][:-5], {})[r.item_no] = json.loads(r.item)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {n: [v for _, v in sorted(d.items())] for n, d in got.items()} == {n: i for n, i in files.items() if i}
    assert all(sorted(d) == list(range(len(d))) for d in got.values())


def test_whole_items_are_not_shuffled_and_marks_in_texts_do_not_count(spark, tmp_path):
    """Items in many ranges, a blank array, an item longer than a range; only items that span ranges are grouped."""
    items = [{"id": k, "note": '}],{"\\' * (k % 5), "deep": [[k], {"a": "x" * (k % 40 * 30)}]} for k in range(400)]
    (tmp_path / "a.json").write_text("[" + "\n,".join(map(json.dumps, items)) + "\n]")
    (tmp_path / "b.json").write_text("[ \n\t ]")
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = arrays.array_items(spark, f"file://{tmp_path}")
        assert [json.loads(r.item) for r in got.orderBy("item_no").collect()] == items
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [None, 300])
def test_landing_gathers_no_more_than_a_document(spark, tmp_path, size):
    from pyspark.sql import functions as F

    from tallyhouse.plans import source_queries as q

    df = spark.range(0, 200, 1, 2)
    path = q._documents(df, q._named(id=F.col("id")), size=size)
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    assert sorted(x["id"] for t in texts for x in json.loads(t)) == list(range(200)) and (len(texts) == 2 if size is None else len(texts) >= 6 and max(map(len, texts)) < 400)
    texts = [r.value for r in spark.read.option("pathGlobFilter", "*.json").text(q._sessions(df, q._named(id=F.col("id")), "messages", 30), wholetext=True).collect()]
    assert sorted(x["id"] for t in texts for x in json.loads(t)["messages"]) == list(range(200)) and len(texts) == 8
