import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slipstone.llm import tokenfiles
from slipstone.llm.tokenfiles import EliasFano

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.data())
def test_elias_fano_round_trip_and_select(values, data):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert coded.select(0, len(values)).tolist() == values
    if values:
        start = data.draw(st.integers(0, len(values) - 1))
        stop = data.draw(st.integers(start, len(values)))
        assert coded.select(start, stop).tolist() == values[start:stop]


def test_space_is_near_the_minimum():
    ends = np.arange(1, 100_001, dtype=np.uint64) * 700
    assert len(EliasFano.encode(ends).to_bytes()) < 100_000 * 13 / 8


@pytest.mark.parametrize("tokens", [1 << 26, 500])
def test_files_equal_plain_encoding(spark, monkeypatch, tokens):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "SHARD_TOKENS", tokens)
    plain = Tokenizer.from_file(PATH)
    texts = [
        "Hello, HELLO there's 123 ways\n\tto go", "", None, "Größe ÉTÉ naïve", "Σίσυφος ΣΑΣ İstanbul", "日本語 text\u3000x",
        "a\u001cb\u0085c\u00a0d\u2028e", "<|endoftext|> in text", "e\u0301 \u0301x A\u030a", "word " * 30_000, "😀!! ok_then",
    ]
    rows = [(10 * i - 20, t, i) for i, t in enumerate(texts)] + [(None, "null id", 0), (7, "same", 1), (7, "same", 1), (2**62, "far", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_files(frame, PATH).collect()]
    start, expected = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected


def test_chunk_cache_overflow_keeps_results(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MAX_CHUNKS", 3)
    encoder, fresh = tokenfiles.ChunkEncoder(PATH), tokenfiles.ChunkEncoder(PATH)
    texts = [f"alpha beta{i} gamma delta{i % 3}" for i in range(40)]
    for text in texts:
        ids, counts = encoder.encode([text, text])
        assert ids.tolist() == fresh.tokenizer.encode(f"{text} {text}", add_special_tokens=False).ids
        assert counts[0] == counts[1]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.token_files(frame, PATH).count() == 0


@pytest.mark.parametrize(
    "text", ["a <|ENDOFTEXT|> b", "A <|StartOfText|> B C", "<|endoftext|> Ab <|EndOfText|>", "X<|ENDOFTEXT|>Y <|endoftext|>Z"]
)
def test_added_tokens_count_in_their_own_case_alone(text):
    encoder = tokenfiles.ChunkEncoder(PATH)
    ids, counts = encoder.encode(["Before", text])
    expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[counts[0] :].tolist() == expected


def test_new_chunks_are_encoded_as_one_text():
    encoder, plain = tokenfiles.ChunkEncoder(PATH), tokenfiles.ChunkEncoder(PATH).tokenizer
    asked = []

    class Recorded:
        def encode(self, text, **kwargs):
            asked.append(text)
            return plain.encode(text, **kwargs)

    encoder.tokenizer = Recorded()
    # combining marks first, Unicode spaces, final sigma, contractions, an added token's text, no ids at all
    texts = ["́a é x y", "ΟΔΟΣ Σ it's 's <|endoftext|> <|endoftext|", "", "​ ﻿ \u0001 名字 😀", "a b\tc\n42"]
    ids, counts = encoder.encode(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert len(asked) == 1


class Counting:
    """A tokenizer that keeps the words it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode(self, text, **kwargs):
        self.asked += text.split()
        return self.tokenizer.encode(text, **kwargs)

    def encode_batch_fast(self, texts, **kwargs):
        self.asked += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **kwargs)


def test_words_and_closing_punctuation_are_encoded_once():
    encoder = tokenfiles.ChunkEncoder(PATH)
    plain, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    encoder.encode_fast = encoder.tokenizer.encode_batch_fast
    texts = [
        "Haus haus. (haus) haus, naïve naïve!! 7 7. 12.5, x&&& haus&&&", "haus; naïve. don't don't. x' 's. 't,",
        "a<|endoftext|> a<|endoftext|>. b<|startoftext|>. <|ENDOFTEXT|>. |>", "ß. ×. é. Σ. ΣΑΣ. ﬁ. _a_ -- ... x--y--",
    ]
    for text in texts:
        ids, counts = encoder.encode([text])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert encoder.tokenizer.asked.count("haus") == 1 and encoder.tokenizer.asked.count("naïve") == 1
    assert not {"haus.", "haus,", "naïve!!", "haus&&&", "haus;"} & set(encoder.tokenizer.asked)
