import hashlib
import math
import random

import pytest

from slipstone.llm import mixing


def brute(rows, share):
    tokens = {}
    for _, source, n in rows:
        tokens[source] = tokens.get(source, 0) + n
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items() if t}

    def entropy(x):
        w = {s: v**x for s, v in p.items()}
        z = sum(w.values())
        return -sum(v / z * math.log(v / z) for v in w.values())

    low, high = 0.0, 1.0
    if entropy(1.0) >= share * math.log(len(p)):
        low = 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= share * math.log(len(p)) else (low, middle)
    z = sum(v**low for v in p.values())
    weight = {s: round(v**low / z, 9) for s, v in p.items()}
    budget = max(math.ceil(tokens[s] / w) for s, w in weight.items())
    found = []
    for source, count in tokens.items():
        quota = max(math.floor(weight[source] * budget + 0.5), count) if count else 0
        own = [(d, n) for d, s, n in rows if s == source]
        epochs, rest = divmod(quota, count) if count else (1, 0)
        for epoch in range(1, epochs + 2):
            digest = lambda text: hashlib.md5(text.encode()).hexdigest()

            def key(d, e=epoch, digest=digest):
                own_key = digest(f"7:{e}:{d}")
                return digest(f"7:block:{e}:{int(own_key[:2], 16)}"), own_key

            upto = 0
            for doc, n in sorted(own, key=lambda o: key(o[0])):
                upto += n
                if epoch <= epochs or (rest and upto <= rest):
                    found.append((doc, source, epoch))
    return sorted(found, key=str)


@pytest.mark.parametrize("share", [0.8, 0.95, 0.999])
def test_equals_brute_force(spark, share):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a"] * 9 + ["b", "c", None]), draw.randint(0, 30)) for i in range(400)]
    rows += [(1000, "empty", 0), (1001, "empty", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = mixing.mixture(frame, mixing.MixTarget(entropy_share=share)).collect()
    assert sorted(((r.doc_id, r.source, r.epoch) for r in got), key=str) == brute(rows, share)
    assert all(r.block == int(r.key[:2], 16) for r in got)


def test_repeat_limit_and_budget(spark):
    rows = [(i, "big" if i % 10 else "small", 5) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = mixing.mixture(frame, mixing.MixTarget(max_repeats=3.0)).groupBy("doc_id", "source").count().collect()
    counts = {s: {r["count"] for r in got if r.source == s} for s in ("big", "small")}
    assert counts["big"] == {1} and counts["small"] == {3}
    fixed = mixing.mixture(frame, mixing.MixTarget(entropy_share=1.0, budget=1000))
    sums = {r.source: r.total for r in fixed.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "total").collect()}
    assert sums == {"big": 500, "small": 500}


def test_blocks_are_permuted_anew_in_every_epoch(spark):
    rows = [(i, "small" if i < 300 else "big", 1 if i < 300 else 9) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = mixing.mixture(frame, mixing.MixTarget(entropy_share=1.0)).filter("source = 'small'").collect()
    orders = []
    for epoch in (1, 2):
        seen = sorted((r.block_key, r.block) for r in got if r.epoch == epoch)
        orders.append([b for _, b in dict.fromkeys(seen)])
        assert orders[-1] != sorted(orders[-1])
    assert orders[0] != orders[1]


def test_one_token_beside_a_large_source(spark):
    frame = spark.createDataFrame([(1, "tiny", 1), (2, "big", 45_000)], "doc_id long, source string, n_tokens long")
    got = mixing.mixture(frame, mixing.MixTarget(entropy_share=1.0)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 45_000, 2: 1}
    both = mixing.MixTarget(entropy_share=1.0, max_repeats=4.0)
    got = mixing.mixture(frame, both).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 4, 2: 1}


def test_carried_columns_and_repeated_ids(spark):
    frame = spark.createDataFrame(
        [(i // 2, "a" if i % 3 else "b", 3, f"t{i}") for i in range(80)] + [(7, "b", None, "none")],
        "doc_id long, source string, n_tokens long, key string",
    )
    packed = frame.select("doc_id", "source", "n_tokens", frame["key"].alias("row"))
    got = mixing.uses(packed, mixing.MixTarget(entropy_share=1.0), "row").groupBy("doc_id", "source", "row").count().collect()
    assert {r.row for r in got} == {f"t{i}" for i in range(80)} | {"none"}
    for r in got:
        assert {x["count"] for x in got if (x.doc_id, x.source) == (r.doc_id, r.source)} == {r["count"]}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert mixing.mixture(empty, mixing.MixTarget(entropy_share=0.9)).count() == 0
    odd = spark.createDataFrame(
        [(None, None, 4), (None, None, 4), (3, "x", 0)], "doc_id long, source string, n_tokens long"
    )
    got = mixing.mixture(odd, mixing.MixTarget(entropy_share=0.9)).collect()
    assert sorted(((r.doc_id, r.source, r.epoch) for r in got), key=str) == sorted([(None, None, 1), (None, None, 1), (3, "x", 1)], key=str)
    texts = spark.createDataFrame([(None,), ("",), (" \n",), ("a b\tc",), ("a\u00a0b",)], "text string")
    assert [r.n for r in texts.select(mixing.token_count(texts["text"]).alias("n")).collect()] == [0, 0, 0, 3, 1]
    with pytest.raises(ValueError, match="entropy_share or max_repeats"):
        mixing.mixture(odd, mixing.MixTarget())
