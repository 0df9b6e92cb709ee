"""Harmonic packing of token ids into sequences of fixed capacity.

Class k holds pieces of length over C/(k+1) and up to C/k, and a bin of class k takes exactly k of
them. Pieces near the top of their class fill bins almost fully, so a document's tail is cut at
class tops until what is left is one of those. Every task fills bins of its own; only the open
bins that tasks end with, less than one per class and task, are pooled and packed again, and what
stays open there is laid end to end and cut at the capacity.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spool

CAPACITY = 1024
END_ID = 0
#: tokens that a piece may leave empty in its share of a bin before it is cut again
SLACK = 2
#: units after which a worker begins its memory of them anew, and characters it encodes at a time
MAX_UNITS = 600_000
_BLOCK = 1 << 20
#: pooled tokens to a task
_POOL_TOKENS = 1 << 24
_BOUNDARY = re.compile(r" (?=\S)")
#: fixed values: the letters, numbers and white space of Latin-1 in Unicode's sense
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: fixed value: the tokenizer's own split of a text into units, for Latin-1
_UNITS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _apart(unit: str) -> bool:
    """Whether a unit has the same ids between line ends as alone."""
    if "\n" in unit or unit[-1].isspace():
        return False
    return not unit[0].isspace() or (unit[0] == " " and not unit[1].isspace())


class _Numbers(dict):
    """Numbers units in the order in which they are first asked for."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class UnitEncoder:
    """Ids of a byte-level BPE tokenizer through the units it splits a text into, each encoded
    once.

    Texts of Latin-1 characters are split by the tokenizer's own pattern. Others are cut before
    every space that something other than white space follows, where a unit always begins, and
    parts with other characters are encoded as they are. Texts that hold an added token go
    through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.numbers = _Numbers()
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.used = 0
        self.line_end = self._encoded(["\n"])[0][0]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for s in range(0, len(texts), 4096)
                for e in self.tokenizer.encode_batch_fast(texts[s : s + 4096], add_special_tokens=False)]

    def _lined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and their numbers, of units that a line end keeps apart."""
        lines = ["\n".join(units[s : s + 256]) for s in range(0, len(units), 256)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(chain(e.ids, (self.line_end,)) for e in found), dtype="<u4")
        ends = np.flatnonzero(flat == self.line_end)
        return flat[flat != self.line_end], np.diff(ends, prepend=-1) - 1

    def _add(self, new: list[str], at: int) -> None:
        """Keep the ids of ``new``, numbered from ``at``: where they start and how many they are."""
        while at + len(new) > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        apart = [_apart(u) for u in new]
        flat, sizes = self._lined([u for u, a in zip(new, apart, strict=True) if a])
        rest = self._encoded([u for u, a in zip(new, apart, strict=True) if not a])
        numbers = np.argsort(~np.array(apart), kind="stable") + at
        sizes = np.concatenate((sizes, np.array([len(r) for r in rest], dtype=np.int64)))
        flat = np.concatenate((flat, np.array(list(chain.from_iterable(rest)), dtype="<u4")))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[numbers] = self.used + sizes.cumsum() - sizes
        self.sizes[numbers] = sizes
        self.used += len(flat)

    def _split(self, text: str) -> list[str]:
        if _latin(text):
            return _UNITS.findall(text)
        head, *rest = _BOUNDARY.split(text)
        chunks = ([head] if head else []) + [" " + c for c in rest]
        return [u for c in chunks for u in (_UNITS.findall(c) if _latin(c) else [c])]

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units end to end, and where each unit begins (and the last ends)."""
        if len(self.numbers) > MAX_UNITS:
            self.numbers, self.used = _Numbers(), 0
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        if len(self.numbers) > known:
            self._add(list(islice(self.numbers, known, None)), known)
        starts, sizes = self.starts[at], self.sizes[at]
        run = np.concatenate(([0], sizes.cumsum()))
        return self.ids[np.repeat(starts - run[:-1], sizes) + np.arange(run[-1])], run

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list = [None] * len(texts)
        plain, units, counts = [], [], []
        for i, text in enumerate(texts):
            if any(token in text for token in self.added):
                found[i] = np.array(self._encoded([text])[0], dtype="<u4")
                continue
            own = self._split(text)
            plain.append(i)
            units += own
            counts.append(len(own))
        ids, run = self._joined(units)
        bounds = run[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))] if counts else [0]
        for i, start, stop in zip(plain, bounds[:-1], bounds[1:], strict=True):
            found[i] = ids[start:stop]
        return found

    def encode_long(self, text: str) -> np.ndarray:
        """Like ``encode`` for one text, a bounded block at a time."""
        if any(token in text for token in self.added):
            return self.encode([text])[0]
        parts, start = [], 0
        while start < len(text):
            cut = _BOUNDARY.search(text, start + _BLOCK)
            stop = cut.start() if cut else len(text)
            parts.append(self.encode([text[start:stop]])[0])
            start = stop
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


@lru_cache(maxsize=1)
def _encoder(path: str) -> UnitEncoder:
    """One encoder to a worker process, so its units serve all tasks that it runs."""
    return UnitEncoder(path)


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document: whole bins, then tops of harmonic classes, until the
    rest wastes at most ``slack`` of its k-th share of a bin."""
    found = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= k * slack:
            found.append(rest)
            break
        found.append(capacity // (k + 1))
        rest -= found[-1]
    return found


class _Bins:
    """Open bins of every class; a bin is handed on once it holds its fixed number of pieces."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def put(self, piece: tuple) -> list[tuple]:
        """``piece`` is (document, start, ids as bytes, tokens of the document)."""
        k = self.capacity // (len(piece[2]) // 4)
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.close(self.open.pop(k)) if len(held) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece, self.next_id, offset))
            offset += len(piece[2]) // 4
        self.next_id += 1
        return rows

    def left(self) -> list[tuple]:
        return [piece for k in sorted(self.open) for piece in self.open[k]]


_COLUMNS = ["doc", "start", "ids", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = "doc string, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _first_frame(placed: list[tuple], left: list[tuple]) -> pd.DataFrame:
    """Pieces in full bins and pieces of open ones, whose ids stand in a column of their own so
    that pooling them reads no others."""
    rows = [(*row, None) for row in placed]
    rows += [(doc, start, None, tokens, None, None, ids) for doc, start, ids, tokens in left]
    frame = pd.DataFrame(rows, columns=[*_COLUMNS, "open_ids"])
    return frame.astype({"sequence_id": "Int64", "offset": "Int64"})


def _packed(docs: DataFrame, tokenizer: str, capacity: int, slack: int, end_id: int) -> DataFrame:
    """Pieces in full bins, and pieces without a sequence: those of bins left open."""

    def run(batches):
        encoder = _encoder(tokenizer)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            docs, texts, start = batch["doc"].tolist(), batch["text"].tolist(), 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < _BLOCK):
                    size += len(texts[stop])
                    stop += 1
                if size > _BLOCK:
                    found = [encoder.encode_long(texts[start])]
                else:
                    found = encoder.encode(texts[start:stop])
                rows = []
                for doc, ids in zip(docs[start:stop], found, strict=True):
                    ids, at = np.append(ids, end), 0
                    for length in cuts(len(ids), capacity, slack):
                        rows += bins.put((doc, at, ids[at : at + length].tobytes(), len(ids)))
                        at += length
                yield _first_frame(rows, [])
                start = stop
        yield _first_frame([], bins.left())

    texts = docs.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, _SCHEMA + ", open_ids binary")


def _pooled(open_pieces: DataFrame, capacity: int) -> DataFrame:
    """Pack the pieces of open bins: by class once more, then end to end, cut at the capacity;
    the last ones get sequences of a power of two tokens, so nothing is padded."""

    def run(batches):
        # numbers above those of the first pass, whose tasks are fewer than 2 ** 30
        bins = _Bins(capacity, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            rows = []
            for piece in batch[_COLUMNS[:4]].itertuples(index=False, name=None):
                rows += bins.put(piece)
            yield _frame(rows)
        rest = bins.left()
        total, room, held, rows = sum(len(p[2]) // 4 for p in rest), 0, [], []
        for doc, start, ids, tokens in rest:
            while ids:
                if not room:
                    room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
                    total -= room
                part = ids[: 4 * room]
                held.append((doc, start, part, tokens))
                start, ids, room = start + len(part) // 4, ids[4 * room :], room - len(part) // 4
                if not room:
                    rows += bins.close(held)
                    held = []
        yield _frame(rows)

    tokens = open_pieces.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    keys = ["doc", "start", "ids", "doc_tokens"]
    tasks = max(1, int(-(-tokens // _POOL_TOKENS)))
    return (
        open_pieces.select(*keys).repartition(tasks, "doc", "start").sortWithinPartitions(*keys)
        .mapInPandas(run, _SCHEMA)
    )


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, start, ids, doc_tokens, sequence_id, offset``; ids are
    little-endian unsigned 32-bit, those of a document end with ``end_id``, doc_tokens counts
    them all, start those before the piece. A sequence's pieces lie gapless from offset 0.
    Sequence ids are unique, not consecutive. Null and empty texts hold the end id alone; a null
    doc_id stays null; rows that repeat a doc_id are documents of their own, which start and
    sequence_id tell apart only by position; other columns are ignored; an empty table gives no
    rows. Texts are cut anywhere, so a piece may end inside a word.
    """
    kind = docs.schema["doc_id"].dataType
    pieces = spool(_packed(docs, tokenizer, capacity, slack, end_id))
    left = pieces.filter("open_ids is not null").select("doc", "start", F.col("open_ids").alias("ids"), "doc_tokens")
    pooled = _pooled(left, capacity)
    return pieces.filter("sequence_id is not null").select(*_COLUMNS).unionByName(pooled).select(
        F.col("doc").cast(kind).alias("doc_id"), *_COLUMNS[1:]
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids, n_tokens, docs`` from the rows of ``pack``;
    docs lists (doc_id, start, offset) of the pieces in order."""
    piece = F.struct("offset", "ids", "doc_id", "start")
    # a sequence holds at most its capacity, so its list is bounded
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda found, p: F.concat(found, p["ids"]))
    return held.select(
        "sequence_id", ids.alias("ids"), (F.octet_length(ids) / 4).cast("int").alias("n_tokens"),
        F.transform("held", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"))).alias("docs"),
    )
