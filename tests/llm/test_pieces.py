import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from slipstone.llm import pieces
from slipstone.llm.pieces import Sampler, pieces_at, sample_encodings, units
from slipstone.llm.triecounts import TrieCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "  two  gaps ", "Line\n\nbreak\tx", "▁ under ▁▁", "ünï 日本 \U0001f600 \u0301x", "x" * 700, " ", "\n"]


def segmentations(pieces, unit):
    if not unit:
        return [()]
    found = []
    for size in range(1, len(unit) + 1):
        if unit[:size] in pieces.logp:
            found += [(unit[:size], *rest) for rest in segmentations(pieces, unit[size:])]
    return found


def test_samples_follow_the_exact_distribution():
    pieces = pieces_at(MODEL, 0.3)
    options = segmentations(pieces, " then")
    score = np.array([sum(pieces.logp[p] for p in o) for o in options])
    chance = np.exp(score - score.max())
    chance /= chance.sum()
    by = {tuple(pieces.ids[p] for p in o): c for o, c in zip(options, chance, strict=True)}
    rows, k = 6000, 3
    found = Sampler(pieces, k, 5).sample([str(i) for i in range(rows)], ["then"] * rows)
    for samples in found[:200]:
        assert len({tuple(s[0]) for s in samples}) == k
        assert [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        for ids, logp, _, _ in samples:
            assert math.isclose(math.exp(logp), by[tuple(ids)], rel_tol=1e-9)
    first = Counter(tuple(s[0][0]) for s in found)
    second = Counter(tuple(s[1][0]) for s in found)
    for way, p in by.items():
        again = sum(q * p / (1 - q) for other, q in by.items() if other != way)
        assert abs(first[way] / rows - p) < 4.5 * math.sqrt(p * (1 - p) / rows) + 1e-4
        assert abs(second[way] / rows - again) < 4.5 * math.sqrt(again * (1 - again) / rows) + 1e-4
    # inclusion scores weigh the sample back to the whole
    assert abs(np.mean([sum(math.exp(s[1] - s[3]) for s in samples) for samples in found]) - 1) < 0.02


def test_round_trip_and_row_keys(spark):
    rows = [(i, t, "n") for i, t in enumerate(ODD)] + [(50, None, "n"), (None, "null key", None), (3, ODD[3], "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sample string")
    got = sample_encodings(frame, MODEL, samples=3).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    by = Counter((r.doc_id, tuple(r.ids)) for r in got)
    assert all(n == (2 if doc == 3 else 1) for (doc, _), n in by.items())
    empty = [r for r in got if r.doc_id in (0, 50)]
    assert [(r.sample, r.n_pieces, r.inclusion) for r in empty] == [(0, 0, 1.0), (0, 0, 1.0)]
    assert all(r.n_pieces == len(r.ids) for r in got)
    alone = sample_encodings(frame.filter("doc_id = 5"), MODEL, samples=3).collect()
    assert [r.ids for r in alone] == [r.ids for r in got if r.doc_id == 5]
    assert sample_encodings(frame.limit(0), MODEL).count() == 0


def test_model_library_decodes_the_same():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = pieces_at(MODEL, 1.0)
    text = "Then the éclair ate\n日本 x"
    for ids, *_ in Sampler(pieces, 2, 1).sample(["k"], [text])[0]:
        assert library.decode(ids.tolist()) == text == pieces.decode(ids.tolist())


def best_count(pieces, text):
    total = 0
    for unit in units(text):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(end):
                score, count = pieces.logp.get(unit[start:end]), 1
                if score is None and end - start == 1:
                    count = len(unit[start:end].encode())
                    score = count * pieces.byte_logp
                if score is not None and best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, best[start][1] + count)
        total += best[-1][1]
    return total


def test_counts_equal_plain_search(spark):
    pieces = pieces_at(MODEL, 1.0)
    texts = [*ODD, "Then the theremin thereof was there", "unglaublich ungern", "the " * 3000, "abc" * 90]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(90, None, 1), (None, "x", 1), (1, "a", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(((r.doc_id, r.n_tokens, r.n_chars) for r in token_counts(frame, MODEL).collect()), key=str)
    assert got == sorted(((d, best_count(pieces, t or ""), len(t or "")) for d, t, _ in rows), key=str)
    assert token_counts(frame.limit(0), MODEL).count() == 0


def test_trie_shares_prefixes():
    parent, letter, depths, ends = TrieCounter.trie(["an", "and", "ant", "b"])
    assert len(parent) == 1 + 5 and depths == [0, 1, 3, 4, 6]
    assert parent[ends[1]] == ends[0] == parent[ends[2]]


@pytest.mark.parametrize("text", ["▁a", "x\ny", " "])
def test_units_rebuild_the_text(text):
    assert "".join(units(text)) == " " + text


def plain_units(text):
    """Spaces go with what follows, line ends stand alone; nothing else is cut."""
    found = []
    for line in re.split("(\n)", " " + text):
        found += [line] if line == "\n" else re.findall(" *[^ ]+| +", line)
    return found


def forward_scores(pieces, unit):
    """Best count and log of the summed probability of all segmentations, over the whole unit."""
    best, mass = [(0.0, 0)] + [(-math.inf, 0)] * len(unit), [0.0] + [-math.inf] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - 40), end):
            score, count = pieces.logp.get(unit[start:end]), 1
            if score is None and end - start == 1:
                count = len(unit[start:end].encode())
                score = count * pieces.byte_logp
            if score is not None:
                mass[end] = np.logaddexp(mass[end], mass[start] + score)
                if best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, best[start][1] + count)
    return best[-1][1], mass[-1]


#: runs without a space: words longer than 256 and than 4,096 characters, of several scripts
LONG = ["interoperability" * 40, "unglaublichungern" * 700, "日本語のテキスト" * 90, "aGVsbG8gd29ybGQ" * 400 + "\nthe end", "x" * 9001]


def test_long_runs_are_counted_whole(spark):
    pieces = pieces_at(MODEL, 1.0)
    frame = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_counts(frame, MODEL).collect()}
    for i, text in enumerate(LONG):
        own = plain_units(text)
        assert got[i] == (sum(forward_scores(pieces, u)[0] for u in own), len(own))


def test_long_runs_are_sampled_whole():
    pieces = pieces_at(MODEL, 0.3)
    crossed = set()
    for samples, text in zip(Sampler(pieces, 2, 3).sample([str(i) for i in range(len(LONG))], LONG), LONG, strict=True):
        whole = sum(forward_scores(pieces, u)[1] for u in plain_units(text))
        for ids, logp, *_ in samples:
            assert pieces.decode(ids.tolist()) == text
            own = sum(pieces.byte_logp if i in pieces.byte_ids else pieces.logp[pieces.raw[i].decode()] for i in ids.tolist())
            assert math.isclose(logp, own - whole, rel_tol=1e-7, abs_tol=1e-7)
            ends = np.cumsum([len(pieces.raw[i]) for i in ids.tolist()])
            crossed |= {at for at in range(256, len(text), 256) if text.isascii() and at not in ends}
    assert len(crossed) > 5


def test_matches_by_place_and_the_order_of_a_state():
    pieces = pieces_at(MODEL, 1.0)
    words = [" wonderful", " 日本語", "x" * 300, " naïve,", "\n", " \U0001f600"]
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.repeat(np.cumsum([len(w) for w in words]), [len(w) for w in words])
    place, size, piece, logp = pieces.sorted_matches(chars, ends - np.arange(len(chars)))
    text, expected = "".join(words), []
    for at in range(len(text)):
        own = [(at, n, pieces.ids[text[at : at + n]], pieces.logp[text[at : at + n]])
               for n in range(1, int(ends[at]) - at + 1) if text[at : at + n] in pieces.ids]
        if not own or own[0][1] != 1:
            own.insert(0, (at, 1, -ord(text[at]) - 1, len(text[at].encode()) * pieces.byte_logp))
        expected += own
    assert list(zip(place.tolist(), size.tolist(), piece.tolist(), logp.tolist(), strict=True)) == expected
    lattice = Sampler(pieces, 2, 1).chain
    lattice.starts([words])
    for state in range(1, lattice.all_states):
        own = lattice.logq[lattice.first[state] : lattice.first[state + 1]]
        assert (np.diff(own) <= 0).all() and abs(np.exp(own).sum() - 1) < 1e-9


def test_room_for_lattices_follows_what_is_used():
    lattice = Sampler(pieces_at(MODEL, 1.0), 2, 1).chain
    draw = np.random.default_rng(5)
    for _ in range(12):
        lattice.starts([["".join(w) for w in draw.choice(list("aeinorst"), (4000, 9))]])
    assert lattice.edges > 1 << 17
    assert len(lattice.upto) <= 1.25 * lattice.edges


def test_spelling_and_decoding_of_many_paths_at_once(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Pieces(path)
    texts = ["Haus und Hof\n", "日本語 ▁ ÿ😀 text", "", "a  b\x07", "x" * 300]
    found = pieces.Sampler(model, 2, 17).sample([str(i) for i in range(len(texts))], texts)
    paths, own = zip(*[(path, text) for text, samples in zip(texts, found, strict=True) for path, *_ in samples], strict=True)
    assert [model.decode(p.tolist()) for p in paths] == list(own)
    seen = []
    decode = model.decode
    monkeypatch.setattr(model, "decode", lambda ids: seen.append(ids) or decode(ids))
    assert all(pieces._frame(model, list(range(len(texts))), texts, found)["round_trip"])
    assert not seen  # decoded together, none by itself
    assert model.round_trips(list(paths), ["other", *own[1:]]) == [False] + [True] * (len(paths) - 1)


def test_single_draws_equal_those_of_arrays():
    for seed, place, step in ((0, 0, 0), (2**64 - 1, 7, 1), (2**63 + 12345, 10**6, 3)):
        many = pieces._uniform(np.array([seed], dtype=np.uint64), place, step, 1_000_033)
        assert pieces._uniform_one(seed, place, step, 1_000_033) == many[0]
