import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slipstone.llm import packing
from slipstone.llm.packing import UnitEncoder, _Bins, cuts, pack, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", " a", "  a", "a  b", "a \n b\n\n c", "\n", "a ", "a  ", "\t x", "it's we'll O'Neill",
    "x <|endoftext|> y  <|endoftext|>", "é à la carte　x  y", "a\x1cb \x1c c", "a  b\u0085 c", "²½ 12x3 _a-b ªº",
    "😀 😀😀 a", "نص عربي ١٢", "µm ÷×", "x" * 5000, "word " * 3000 + "漢字 " * 500,
]


def test_units_give_the_tokenizers_ids(monkeypatch):
    plain, own = Tokenizer.from_file(PATH), UnitEncoder(PATH)
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice(" \n\t aé1'.,s ") for _ in range(40)) for _ in range(300)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in own.encode(texts)] == want
    monkeypatch.setattr(packing, "_BLOCK", 64)
    monkeypatch.setattr(packing, "MAX_UNITS", 50)
    assert [own.encode_long(t).tolist() for t in texts] == want


@pytest.mark.parametrize("slack", [0, 2, 16])
def test_cuts_and_bins_keep_the_harmonic_bound(slack):
    bins, full, padding = _Bins(1024, 0), 0, 0
    for length in [*range(1, 1024), *random.Random(1).choices(range(1, 9000), k=2000)]:
        pieces = cuts(length, 1024, slack)
        assert sum(pieces) == length and all(0 < p <= 1024 for p in pieces)
        for p in pieces:
            rows = bins.put((0, 0, bytes(4 * p), length))
            if rows:
                full, padding = full + 1, padding + 1024 - sum(len(r[2]) // 4 for r in rows)
                assert {1024 // (len(r[2]) // 4) for r in rows} == {len(rows)}
    assert padding <= full * 1024 * (0.001 if slack <= 2 else 0.02) * max(1, slack)


def checked(frame, texts):
    """Round trip of all documents, gapless sequences, and the share of padding."""
    rows = frame.collect()
    plain = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(want)
    for doc, lists in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(len(r.ids) for r in pieces) == 4 * sum(map(len, lists))
        if len(lists) == 1:
            assert b"".join(r.ids for r in pieces) == np.array(lists[0], dtype="<u4").tobytes()
            assert [r.start for r in pieces] == [sum(len(q.ids) // 4 for q in pieces[:i]) for i in range(len(pieces))]
            assert {r.doc_tokens for r in pieces} == {len(lists[0])}
    padding = total = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(len(q.ids) // 4 for q in held[:i]) for i in range(len(held))]
        used = sum(len(r.ids) // 4 for r in held)
        assert 0 < used <= 1024
        total += used
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    return padding / total if total else 0.0


def test_round_trip_of_odd_documents(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, ids int").repartition(3)
    packed = pack(frame, PATH)
    assert checked(packed, texts) < 0.01
    whole = sequences(packed).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(r.ids) // 4 for r in packed.collect())
    first = max(whole, key=lambda r: len(r.docs))
    assert [d.offset for d in first.docs] == sorted(d.offset for d in first.docs) and len(first.ids) == 4 * first.n_tokens
    assert pack(frame.limit(0), PATH).count() == 0


def test_little_padding_in_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs.repartition(4), PATH)
    texts = [tuple(r) for r in docs.collect()]
    assert checked(packed, texts) < 0.002


def test_query_digests(spark, sf_dir):
    from slipstone.llm.queries import op13_harmonic_packing

    plain = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_harmonic_packing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows[:200]:
        ids = np.array(plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
