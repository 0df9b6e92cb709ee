"""Token-id files: ids of many documents end to end, document bounds in Elias-Fano form.

A shard is three parts under one name: ``.ids`` (raw little-endian ids, 16 bits wide where the
vocabulary allows), ``.ends`` (where each document ends) and ``.docs`` (the doc_ids), the last
two as Elias-Fano sequences: low bits packed, high bits in unary, and every 256th one of the
unary part sampled in 32 bits, so any bound is found without a table of 64-bit offsets.

Shards are written by tasks under names of their own attempt; only those listed in the manifest
that Spark commits are ever read, so a repeated or lost task does no harm.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spool, spool_path
from .common import shared_files

END_ID = 2
#: tokens after which a task begins a new shard
SHARD_TOKENS = 1 << 26
#: distinct chunks whose ids a worker keeps
MAX_CHUNKS = 400_000
#: ASCII punctuation without the apostrophe, which may begin a word's last part
_CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: runs of A-Z and the Latin-1 letters U+00C0 to U+00FF, which the tokenizer doesn't part
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_SAMPLE = 256
_HEAD = struct.Struct("<QQQB")


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.width = n, top, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(width, dtype=np.uint64)
        low = np.concatenate([
            np.packbits(
                ((block[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"
            )
            for block in np.split(values, range(8192, n, 8192))
        ]) if n and width else np.zeros(0, dtype=np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[ones] = 1
        if len(bits) >= 1 << 32:
            raise ValueError("a shard's bounds exceed 32-bit samples")
        return cls(n, top, width, low, np.packbits(bits, bitorder="little"), ones[::_SAMPLE].astype(np.uint32))

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values number ``start`` up to ``stop``, found from the sample before ``start``."""
        start, stop = max(start, 0), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        begin, after = start // _SAMPLE, -(-stop // _SAMPLE)
        first = int(self.samples[begin]) // 8
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        window = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        window = window[window >= int(self.samples[begin])]
        ranks = np.arange(start, stop)
        value = (window[ranks - begin * _SAMPLE] - ranks) << self.width
        if self.width:
            from_byte, to_byte = start * self.width // 8, -(-stop * self.width // 8)
            bits = np.unpackbits(self.low[from_byte:to_byte], bitorder="little")
            skip = start * self.width - 8 * from_byte
            bits = bits[skip : skip + (stop - start) * self.width].reshape(-1, self.width)
            value = value | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return value

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.top, len(self.high), self.width)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, size, width = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, -(-n * width // 8), at)
        at += len(low)
        high = np.frombuffer(data, np.uint8, size, at)
        samples = np.frombuffer(data, "<u4", -(-n // _SAMPLE), at + size)
        return cls(n, top, width, low, high, samples)


class ChunkEncoder:
    """Whole-text encoding through the ids of white-space chunks, each encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order. Texts of Latin-1 characters are lower-cased first, as the tokenizer would;
    others go through it unchanged, and so do texts in which lower-casing makes an added token:
    the tokenizer looks for those in the raw text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: without offsets, for words
        self.encode_fast = self.tokenizer.encode_batch_fast
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        self.added_bytes = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closes[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)
        self.chunks, self.used = 0, 0

    def _cut(self, chunks: list[bytes]) -> list[bytes]:
        """Every chunk without its closing punctuation, and that, in turn. The tokenizer parts words
        from punctuation, so the ids of both follow each other, unless an added token takes in both."""
        whole = b" ".join(chunks)
        added = [t for t in self.added_bytes if t in whole]
        parts = []
        for chunk in chunks:
            head = chunk.rstrip(_CLOSING)
            if len(head) == len(chunk) or not head[-1:].isalnum() or (added and any(t in chunk for t in added)):
                parts += chunk, b""
            else:
                parts += head, chunk[len(head) :]
        return parts

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words (``_WORD``) end to end and the number of each; none if they can't be told apart.

        Such a word is one run to the tokenizer, and only the last id of a run ends a word.
        """
        block = self.encode_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(block.ids, dtype=np.uint32)
        last = np.flatnonzero(self.closes[ids])
        if len(last) != len(words) or len(ids) != last[-1] + 1:
            return None
        return ids, np.diff(last, prepend=-1)

    def _others(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks end to end and the number of each."""
        texts = [c.decode("utf-8") for c in chunks]
        # one text for the whole block; where an id begins tells the chunk it belongs to
        block = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.fromiter((begin for begin, _ in block.offsets), dtype=np.int64, count=len(block.ids))
        after = np.cumsum([len(t) + 1 for t in texts])
        sizes = np.bincount(np.searchsorted(after, begins, side="right"), minlength=len(texts))
        return np.array(block.ids, dtype=np.uint32), sizes

    def _append(self, ids: np.ndarray, sizes: np.ndarray, chunks: int, used: int) -> None:
        """Put chunks behind the first ``chunks``, which have ``used`` ids; chunk c ends at ends[c + 1]."""
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while chunks + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[used : used + len(ids)] = ids
        self.ends[chunks + 1 : chunks + 1 + len(sizes)] = used + sizes.cumsum()

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks of these numbers end to end and where each one's end."""
        starts, sizes = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        run = np.concatenate(([0], sizes.cumsum()))
        return self.ids[np.repeat(starts - run[:-1], sizes) + np.arange(run[-1])], run

    def _add(self, new: list[bytes]) -> None:
        """Ids of ``new`` behind the kept ones; words and closing punctuation are encoded once."""
        parts = self._cut(new)
        lacking = list(set(parts).difference(self.kept))
        words = [p for p in lacking if _WORD(p)]
        others = [p for p in lacking if not _WORD(p)]
        chunks, used = self.chunks, self.used
        for group, encode in ((words, self._words), (others, self._others)):
            for start in range(0, len(group), 4096):
                block = group[start : start + 4096]
                ids, sizes = encode(block) or self._others(block)
                self._append(ids, sizes, chunks, used)
                chunks, used = chunks + len(block), used + len(ids)
        own = dict(zip(words + others, range(self.chunks, chunks), strict=True))
        numbers = np.fromiter(map(own.get, parts, itertools.repeat(-1)), dtype=np.int64, count=len(parts))
        known = np.flatnonzero(numbers < 0)
        numbers[known] = [self.kept[parts[i]] for i in known.tolist()]
        ids, run = self._gathered(numbers)
        self._append(ids, np.diff(run[::2]), self.chunks, self.used)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of each."""
        chunks: list[bytes] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            try:
                text.encode("latin-1")
                low = text.lower()
                if not any(low.count(t) > text.count(t) for t in self.added):
                    text = low
            except UnicodeEncodeError:
                pass
            own = text.encode("utf-8", "replace").split()
            counts[i] = len(own)
            chunks += own
        numbers = np.fromiter(map(self.kept.get, chunks, itertools.repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            lacking = [chunks[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lacking))
            self._add(new)
            fresh = dict(zip(new, range(self.chunks, self.chunks + len(new)), strict=True))
            numbers[missing] = [fresh[c] for c in lacking]
            if self.chunks + len(new) <= MAX_CHUNKS:
                self.kept.update(fresh)
                self.used = int(self.ends[self.chunks + len(new)])
                self.chunks += len(new)
        ids, run = self._gathered(numbers)
        bounds = run[np.concatenate(([0], counts.cumsum()))]
        return ids, np.diff(bounds)


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One encoder to a worker process, so its chunks serve all tasks that it runs."""
    return ChunkEncoder(path)


class _Shard:
    """One shard being written; ids are streamed, bounds are kept until it is closed."""

    def __init__(self, folder: str, part: int, number: int, wide: bool) -> None:
        self.files, base = shared_files(folder)
        self.name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}"
        self.base = f"{base}/{self.name}"
        self.kind = "<u4" if wide else "<u2"
        self.stream = self.files.open_output_stream(f"{self.base}.ids")
        self.sizes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.key, self.tokens, self.nulls = (part, number), 0, 0

    def write(self, ids: np.ndarray, sizes: np.ndarray, docs: list[int | None]) -> None:
        self.stream.write(ids.astype(self.kind).tobytes())
        self.sizes.append(sizes)
        named = [d for d in docs if d is not None]
        self.nulls += len(docs) - len(named)
        self.docs.append(np.array(named, dtype=np.int64))
        self.tokens += len(ids)

    def close(self) -> dict:
        self.stream.close()
        docs = np.concatenate(self.docs)
        base = int(docs[0]) if len(docs) else 0
        ends = np.concatenate(self.sizes).cumsum()
        gaps = (docs.astype(object) - base).astype(np.uint64) if len(docs) else np.zeros(0, np.uint64)
        for suffix, values in ((".ends", ends), (".docs", gaps)):
            with self.files.open_output_stream(self.base + suffix) as out:
                out.write(EliasFano.encode(values).to_bytes())
        return {
            "part": self.key[0], "number": self.key[1], "name": self.name, "docs": len(ends),
            "tokens": self.tokens, "nulls": self.nulls, "first_doc": base, "wide": self.kind == "<u4",
        }


MANIFEST = "part int, number int, name string, docs long, tokens long, nulls long, first_doc long, wide boolean"


def write_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards into ``folder``; the manifest, one row per shard.

    Documents stand in ascending doc_id order over the whole set of shards (nulls first; rows
    of one doc_id by a hash of their text). Null and empty texts hold the end id alone. An
    empty table writes no shard. ``folder`` must be one that all executors share.
    """

    def run(batches):
        encoder = _encoder(tokenizer)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        part, number, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"].tolist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                flat, counts = encoder.encode(texts[start:stop])
                flat = np.insert(flat, counts.cumsum(), end_id)
                shard = shard or _Shard(folder, part, number, wide)
                shard.write(flat, counts + 1, [None if i is None else int(i) for i in ids[start:stop]])
                start = stop
                if shard.tokens >= SHARD_TOKENS:
                    yield pd.DataFrame([shard.close()])
                    shard, number = None, number + 1
        if shard is not None:
            yield pd.DataFrame([shard.close()])

    ordered = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    # as text, so that null ids don't turn the column into floats
    return ordered.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, MANIFEST)


def _crc(read, start: int, stop: int, kind: str) -> int:
    """Unsigned crc32 of ids as 32-bit integers, a bounded piece at a time."""
    found = 0
    for at in range(start, stop, 1 << 20):
        found = zlib.crc32(read(at, min(at + (1 << 20), stop)).astype("<u4").tobytes(), found)
    return found


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it over all shards. Bounds come from the
    Elias-Fano select structures, ids from the raw part, a bounded window at a time.
    """
    # one row per shard, so one ordered pass over the manifest stays small
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))

    def run(batches):
        files, base = shared_files(folder)
        for batch in batches:
            for row in batch.to_dict("records"):
                path = f"{base}/{row['name']}"
                kind = "<u4" if row["wide"] else "<u2"
                width = int(kind[2])
                parts = {}
                for suffix in (".ends", ".docs"):
                    with files.open_input_file(path + suffix) as part:
                        parts[suffix] = EliasFano.from_bytes(part.read())
                with files.open_input_file(path + ".ids") as ids:
                    def read(start, stop, ids=ids, width=width, kind=kind):
                        return np.frombuffer(ids.read_at((stop - start) * width, start * width), dtype=kind)

                    last = 0
                    for at in range(0, row["docs"], 2048):
                        ends = parts[".ends"].select(at, at + 2048)
                        starts = np.concatenate(([last], ends[:-1]))
                        last = int(ends[-1])
                        from_doc = max(0, at - row["nulls"])
                        named = parts[".docs"].select(from_doc, at + len(ends) - row["nulls"]) + row["first_doc"]
                        docs = [None] * (len(ends) - len(named)) + named.tolist()
                        if last - int(starts[0]) <= 1 << 22:
                            whole = read(int(starts[0]), last).astype("<u4")
                            shift = int(starts[0])
                            crc = [zlib.crc32(whole[s - shift : e - shift].tobytes()) for s, e in zip(starts, ends, strict=True)]
                        else:
                            crc = [_crc(read, int(s), int(e), kind) for s, e in zip(starts, ends, strict=True)]
                        yield pd.DataFrame({
                            "doc_id": pd.array(docs, dtype="Int64"), "start": starts + row["offset"],
                            "n_tokens": ends - starts, "ids_crc32": np.array(crc, dtype=np.int64),
                        })

    # shards are dealt out evenly, whatever their order
    return placed.repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    folder = spool_path(docs.sparkSession, "tokens")
    return read_files(spool(write_files(docs, tokenizer, folder)), folder)
