import random
import zlib
from collections import Counter

from slipstone.llm.variants import WordIndex, variants, word_counts


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, times=10):
    rows = {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        rows[word] = [form, None, n, len(others), counts[form] if form else None]
    for word, row in rows.items():
        root = word
        while rows[root][0] is not None:
            root = rows[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in rows.items()}


def drawn(seed, letters="abé", many=400, longest=9):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(2, longest))) for _ in range(many)}
    return {w: 10 ** draw.randint(0, 4) * draw.randint(1, 3) for w in words}


def test_index_finds_every_pair_once():
    import numpy as np

    for seed in range(20):
        words = sorted(drawn(seed, "ab" if seed % 2 else "abcdefgé", 120))
        asked = sorted({*words, "zzz", "aaaaaaaaaaaaaa", "ab"})
        index, found = WordIndex(words), []
        for right in (True, False):
            q, w = index.near(asked, np.ones((len(asked), 3), dtype=bool), right)
            pairs = [(asked[a], words[b]) for a, b in zip(q, w, strict=True)]
            found += [p for p in pairs if right or not p[1].startswith(p[0][: len(p[0]) // 2])]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in asked for b in words if near(a, b)}


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_equals_brute_force_in_one_and_many_shards(spark):
    counts = drawn(3)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert rows_of(variants(table)) == want
    assert rows_of(variants(table, shard_words=40)) == want
    assert any(r[1] != (r[0] or w) for w, r in want.items())  # a chain of forms


def test_one_hot_key_is_cut_into_a_grid(spark):
    counts = {"prefixes" + a + b: 1 + (a == b) * 20 for a in "abcdefgh" for b in "abcdefgh"}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants(table, shard_words=16)) == brute(counts)


def test_empty_vocabulary_and_long_words(spark):
    assert variants(spark.createDataFrame([], "word string, n long")).count() == 0
    counts = {"a" * 3000: 2, "a" * 3001: 30, "a" * 1500 + "b" + "a" * 1500: 500}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants(table)) == brute(counts)


def test_counts_runs_of_whole_texts(spark):
    texts = [
        (1, "Recibo recibo RECIBOS, recibos; ÀRBOLES árboles a1b2 niño-niños señorita señorita"),
        (2, None), (3, ""), (None, "recibos recibos señorita"), (1, "recibos 漢字recibos漢字 \U0001f600recibos"),
        (4, "x" * 30_000 + " " + "x" * 30_000), *[(100 + i, "recibos planetas planetas") for i in range(80)],
    ]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, n string")
    want = Counter()
    for doc, text in texts:
        runs, run = [], ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            else:
                runs, run = runs + [run], ""
        for run in filter(None, runs):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in word_counts(frame).collect()} == want
    assert any(len(w) == 7 and w != "recibos" for w in want)
    assert word_counts(frame.limit(0)).count() == 0
