import random

import pytest
from pyspark.sql import types as T

from slipstone.llm import neardup
from slipstone.llm.common import WordHasher, shingle_set
from slipstone.llm.components import components

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sig", T.StringType()),
])


def brute(rows, words, percent=80):
    sets = {}
    for doc, text, *_ in rows:
        found = (text or "").encode().lower().split()
        size = min(words, len(found))
        sets[doc] = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            shared = len(x & y)
            if x and y and 100 * shared >= percent * (len(x) + len(y) - shared):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in sets}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def corpus(seed=3, groups=12):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(5, 200))]
        for _ in range(draw.randint(1, 7)):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 18))):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((doc, " ".join(own), "x"))
            doc += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_equals_brute_force(spark, words):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(neardup.near_duplicates(frame, words=words)) == brute(rows, words)


def test_large_nodes_keep_every_link(spark):
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for doc in range(70):  # one dense group and some that share a passage only
        own = list(base)
        own[draw.randrange(120)] = f"n{doc}"
        rows.append((doc, " ".join(own), None))
    for doc in range(70, 100):
        rows.append((doc, " ".join(base[:40] + [f"o{doc}-{i}" for i in range(80)]), None))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(neardup.near_duplicates(frame, words=2, node_limit=6)) == brute(rows, 2)


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [
        (1, None, None), (2, "", "a"), (3, " \t\n", None), (4, "One", None), (5, "one", None), (6, long, None),
        (7, long, None), (None, long, None), (8, "a b", None), (8, "a b", None), (9, "a\u00a0b", None),
    ]
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).collect()]
    key = lambda row: str(row)
    assert sorted(got, key=key) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 29_999, 6, True), (7, 29_999, 6, False), (None, 29_999, None, True),
        (8, 1, 8, True), (8, 1, 8, True), (9, 1, 9, True),
    ], key=key)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_id_with_two_texts_joins_their_groups(spark):
    rows = [(1, "a b c d", None), (2, "a b c d", None), (2, "x y z u", None), (3, "x y z u", None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2).collect()
    assert {r.component_id for r in got} == {1}


def test_chain_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_word_hashes_depend_on_the_word_alone():
    hasher = WordHasher()
    assert hasher("Ab cd\tab").tolist() == hasher("AB CD\r\nab").tolist()
    assert len(set(hasher("a b ab ba aa").tolist())) == 5
    assert len(shingle_set(hasher("x y x y x"), 2)) == 2


def test_more_recall_takes_more_trees():
    assert neardup.trees_for(0.9, 0.8) < neardup.trees_for(0.9999, 0.8)


def test_a_group_met_twice_is_confirmed_once(spark):
    same, other = bytes(range(64)), bytes(range(64, 128))
    member = lambda doc, sketch: (doc, 10, bytearray(sketch), doc, True)
    pairs = [member(1, same), member(2, same)], [member(3, other), member(4, other)]
    groups = [(7, pairs[0]), (8, pairs[0][::-1]), (9, pairs[0] + pairs[1])]
    frame = spark.createDataFrame(
        groups, "g long, members array<struct<id: long, n: long, sketch: binary, part: long, ask: boolean>>"
    )
    rows = neardup._promising(frame, 0.8).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4] and len({r.g for r in rows}) == 2


def test_members_beyond_reach_of_the_pivot_meet_in_no_tile(spark):
    near, far = [(i, 10, bytearray(64), 0) for i in range(20)], [(i, 10, bytearray([i] * 64), i) for i in (50, 51)]
    nodes = spark.createDataFrame(near + far, "id long, n long, sketch binary, part long")
    dense = spark.createDataFrame(
        [(1, r[0], 0, 1.0 if r in near else 0.1) for r in near + far], "key long, id long, pivot long, agree double"
    )
    tiles = neardup._tiles(dense, nodes).collect()
    assert {m.id for t in tiles for m in t.members} == {50, 51}


def test_texts_are_not_shuffled_for_a_few_ids(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "cast(id as string) as text")
    wanted = spark.createDataFrame([(i % 100,) for i in range(500)], "id long")
    found = neardup._texts_of(docs, wanted)
    assert {r.id for r in found.collect()} == set(range(100)) and found.count() == 100
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def test_dense_nodes_of_one_group_become_one_node(spark):
    sketch = lambda i: bytearray([0] * (64 - i % 7) + [i] * (i % 7))
    nodes = spark.createDataFrame(
        [(i, 10, sketch(i), 0 if i < 90 else i) for i in range(100)], "id long, n long, sketch binary, part long"
    )
    met = [(key, i, pivot, 0.9) for key, pivot in ((1, 3), (2, 5), (3, 5), (4, 95)) for i in range(100) if i % 4 < key]
    dense = spark.createDataFrame(met, "key long, id long, pivot long, agree double")
    merged = neardup._merged(dense, nodes).collect()
    home = {r.id: (r.pivot, r.agree) for r in merged if r.key == 0}
    assert len(merged) == 75 + 100 and set(home) == {i for i in range(100) if i % 4 < 3}
    assert home[5] == (5, 1.0) and home[14] == (5, 59 / 64)
    assert {(r.key, r.pivot) for r in merged} == {(0, 5), (95, 95)}


def test_a_dense_group_is_tiled_once_for_all_trees(spark, monkeypatch):
    draw, made = random.Random(11), []
    base = [f"b{i}" for i in range(100)]
    rows = []
    for doc in range(160):
        own = list(base)
        for at in draw.sample(range(100), draw.choice((1, 2, 8, 9))):
            own[at] = f"n{doc}-{at}"
        rows.append((doc, " ".join(own), None))
    tiles = neardup._tiles
    monkeypatch.setattr(neardup, "_tiles", lambda dense, nodes: made.append(tiles(dense, nodes)) or made[-1])
    assert result(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2, node_limit=6)) == brute(rows, 2)
    # an asking member meets each other member in one tile, not in one of every tree
    ids = [m.id for tile in made[0].collect() for m in tile.members if m.ask]
    assert 0 < len(ids) <= 4 * len(set(ids))
