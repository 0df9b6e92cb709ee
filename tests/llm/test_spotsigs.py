import hashlib
import random
import re

from slipstone.llm import spotsigs


def reference_sets(texts):
    """Signatures as tuples, to compare likeness without the hashes."""
    anchors, out = set(spotsigs.ANCHORS), []
    for text in texts:
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        parts, front = [], []
        for w in words:
            if w in anchors:
                front.append(w)
            else:
                parts.append((tuple(front), w))
                front = []
        found = {(a, w, parts[i + 1][1]) for i, (a, w) in enumerate(parts[:-1]) if a}
        out.append(found or {("whole", text)})
    return out


def likeness(a, b):
    return len(a & b) / len(a | b)


def rows(seed=2):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "and", "der", "la", *[f"c{i}" for i in range(30)]]
    made = [(3 * i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 80)))) for i in range(60)]
    return [*made, (1, None), (4, ""), (7, made[5][1]), (8, "ßÄ é the x y\u00a0z"), (10, "x" * 100_000), (None, "the null id row")]


def test_equals_plain_version(spark):
    data = rows()
    frame = spark.createDataFrame([(d, t, "f") for d, t in data], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in spotsigs.edited_neighbours(frame).collect()}
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in ordered]
    edits = []
    for i, text in enumerate(texts):
        half = len(text) // 2
        edits.append(text[: len(text) - half] + texts[(i + 1) % len(texts)][:half])
    sets, edit_sets = reference_sets(texts), reference_sets(edits)
    assert len(got) == len(data)
    for i, (doc, _) in enumerate(ordered):
        row = got[doc]
        assert row.n_chars == len(texts[i])
        assert row.edited_sha256 == hashlib.sha256(edits[i].encode()).hexdigest()
        assert abs(row.near_edited - likeness(sets[i], edit_sets[i])) < 1e-12
        assert abs(row.near_next - likeness(sets[i], sets[(i + 1) % len(texts)])) < 1e-12
        assert len(row.fingerprint) == 8 * len(sets[i])
    assert got[15].fingerprint == got[7].fingerprint


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "the a b"), (1, "the a b"), (2, "x"), (2, "y")], "doc_id long, text string")
    got = spotsigs.edited_neighbours(frame).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 2]
    assert spotsigs.edited_neighbours(frame.limit(0)).count() == 0
    one = spotsigs.edited_neighbours(frame.limit(1)).first()
    assert one.near_next == 1.0


def test_join_finds_all_similar_classes(spark):
    draw = random.Random(9)
    base = ["the w%d" % i if i % 2 else "v%d" % i for i in range(80)]
    data = [(0, " ".join(base)), (1, " ".join(base)), (None, " ".join(base))]
    for doc in range(2, 40):
        own = list(base)
        for _ in range(draw.randint(0, 14)):
            own[draw.randrange(80)] = f"n{draw.randrange(900)}"
        data.append((doc, " ".join(own)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    membership, pairs = spotsigs.similar_classes(frame, 0.7)
    classes = {r.doc_id: r.class_id for r in membership.collect()}
    assert classes[1] == 0 and len(classes) == 40
    named = [(d, t) for d, t in data if d is not None and classes[d] == d]
    sets = dict(zip([d for d, _ in named], reference_sets([t for _, t in named]), strict=True))
    expected = {
        (a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.7
    }
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected
