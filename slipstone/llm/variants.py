"""Spelling variants: words at one code point's distance, found in bidirectional FM indexes.

A pair at distance one agrees in the first or in the second half of either word. So each word is
searched twice: one half is matched exactly from the word's edge, then the match is extended over
the other half with one error. Both extensions run on the same index, a pair of synchronised
suffix-rank intervals over the delimited words and their reverse.

The vocabulary is dealt to shards by (length, outer characters that every match must share), each
small enough for one index in one task; a key too large for a shard is cut into a grid of words
by queries.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import lookup
from ..session import spool
from .components import _roots

#: A-Z lower-cased, the letters of Latin-1 kept, every other byte a space
_LETTERS = bytes(
    c if 0x61 <= c <= 0x7A or c >= 0xC0 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
#: one run in so many loses a code point before it is counted
NOISE = 31
#: distinct words that a task counts before it hands them on
MAX_WORDS = 500_000
#: words of one index
SHARD_WORDS = 60_000
#: queries that are extended together
_TOGETHER = 20_000
_END, _EDGE = 0, 1


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``word, n`` of the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all whole texts.

    A-Z are lower-cased. With h the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by
    31 loses its code point number h % length first. Words are counted in the tasks and then by
    word. Null and empty texts have no runs, a null doc_id is written as nothing, repeated rows
    count again, columns other than doc_id and text are ignored.
    """

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(run) < least_length:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % NOISE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_length:
                        found[run] += n
                if len(found) > MAX_WORDS:
                    yield frame(found)
                    found = Counter()
        yield frame(found)

    def frame(found: Counter) -> pd.DataFrame:
        return pd.DataFrame({
            "word": pd.Series([w.decode("latin-1") for w in found], dtype=object),
            "n": np.fromiter(found.values(), np.int64, len(found)),
        })

    texts = docs.filter("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text"
    )
    return (
        texts.mapInPandas(count, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    )


# --- the index ---------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by prefix doubling."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1 + int(rank.max())) + second
        order = np.argsort(key, kind="stable")
        placed = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(placed[1:] != placed[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class _Ranks:
    """Ranks of all symbols in a Burrows-Wheeler transform, held as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            high = (symbols >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(high))).astype(np.int32))
            self.zeros.append(int(len(symbols) - high.sum()))
            symbols = np.concatenate((symbols[high == 0], symbols[high == 1]))
        self.first = np.searchsorted(self._keys(symbols), self._keys(np.arange(1 << bits)))

    def _keys(self, symbols: np.ndarray) -> np.ndarray:
        """The order in which the last level holds the symbols: by their bits, last bit first."""
        found = np.zeros(len(symbols), dtype=np.int64)
        for bit in range(self.bits):
            found = (found << 1) | ((symbols >> bit) & 1)
        return found

    def of(self, low, high, symbol):
        """Ranks of ``symbol`` at ``low``, its count and that of smaller symbols up to ``high``."""
        smaller = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones_low, ones_high = self.ones[level][low], self.ones[level][high]
            smaller += np.where(up, (high - ones_high) - (low - ones_low), 0)
            low = np.where(up, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(up, self.zeros[level] + ones_high, high - ones_high)
        return low - self.first[symbol], high - low, smaller

    def all(self, low, high):
        """The same for every symbol that occurs: (interval, symbol, rank, count, smaller)."""
        at, symbol = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        smaller = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            ones_low, ones_high = self.ones[level][low], self.ones[level][high]
            zero_low, zero_high = low - ones_low, high - ones_high
            left, right = zero_high > zero_low, ones_high > ones_low
            at = np.concatenate((at[left], at[right]))
            symbol = np.concatenate((symbol[left] * 2, symbol[right] * 2 + 1))
            smaller = np.concatenate((smaller[left], smaller[right] + (zero_high - zero_low)[right]))
            low = np.concatenate((zero_low[left], self.zeros[level] + ones_low[right]))
            high = np.concatenate((zero_high[left], self.zeros[level] + ones_high[right]))
        return at, symbol, low - self.first[symbol], high - low, smaller


class WordIndex:
    """Bidirectional FM index over distinct words, each between two edge marks.

    A match is (own, other, size): its interval in the index that extends it, where the interval
    in the other direction's index starts, and their common length. The suffixes that start with
    an edge stand in the order of the words, so an interval of a whole word is its number.
    """

    def __init__(self, words: list[str]) -> None:
        self.words = words
        marks = np.frombuffer("\x01".join(["", *words, ""]).encode("utf-32-le"), "<u4")
        points = np.unique(marks)
        self.points = points if points[0] == 1 else np.insert(points, 0, 1)
        text = np.searchsorted(self.points, marks) + 1
        size = len(self.points) + 1
        bits = max(1, (size - 1).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(np.append(text, _END), minlength=1 << bits))))
        self.edges = len(words) + 1
        self.ranks = {}
        for right, content in ((False, text), (True, text[::-1])):
            whole = np.append(content, _END)
            self.ranks[right] = _Ranks(whole[suffix_order(whole) - 1], bits)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of ``text``; -1 where the index holds no such code point."""
        marks = np.frombuffer(text.encode("utf-32-le"), "<u4")
        found = np.minimum(np.searchsorted(self.points, marks), len(self.points) - 1)
        return np.where(self.points[found] == marks, found + 1, -1)

    def extend(self, right: bool, match, symbol):
        own, other, size = match
        known = symbol >= 0
        rank, count, smaller = self.ranks[right].of(own, own + size, np.where(known, symbol, 0))
        return self.before[symbol] + rank, other + smaller, np.where(known, count, 0)

    def near(self, queries: list[str], edits: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words one edit from a query that keep its first half
        (``right``) or its second half (not ``right``); each pair once.

        ``edits`` has three columns per query: whether a code point may be replaced, inserted,
        deleted. An edit inside a run of equal code points is made at the run's far end only.
        """
        pairs = [self._near(queries[s : s + _TOGETHER], edits[s : s + _TOGETHER], right)
                 for s in range(0, len(queries), _TOGETHER)]
        return (
            np.concatenate([np.zeros(0, np.int64), *[q + i * _TOGETHER for i, (q, _) in enumerate(pairs)]]),
            np.concatenate([np.zeros(0, np.int64), *[w for _, w in pairs]]),
        )

    def _near(self, queries, edits, right):
        sizes = np.array([len(q) for q in queries], dtype=np.int64)
        text = self.symbols("".join(q if right else q[::-1] for q in queries))
        starts = np.cumsum(sizes) - sizes
        text = np.append(text, -1)
        exact = sizes // 2 if right else sizes - sizes // 2
        replace, insert, delete = edits.T

        q = np.arange(len(queries))
        match = tuple(np.full(len(q), v, dtype=np.int64) for v in (self.before[_EDGE], self.before[_EDGE], self.edges))
        waiting = []
        for at in range(int(exact.max(initial=0)) + 1):
            ready = exact[q] == at
            if ready.any():
                waiting.append((q[ready], *[m[ready] for m in match]))
            q, match = q[~ready], tuple(m[~ready] for m in match)
            match = self.extend(right, match, text[starts[q] + at])
            alive = match[2] > 0
            q, match = q[alive], tuple(m[alive] for m in match)

        # rows of a front: query, place in it, then the match
        clean = _joined([(w[0], exact[w[0]], *w[1:]) for w in waiting])
        edited = _joined([])
        found = []
        while len(clean[0]) or len(edited[0]):
            q, at = clean[:2]
            inside = at < sizes[q]
            here = text[np.where(inside, starts[q] + at, len(text) - 1)]
            after = text[np.where(at + 1 < sizes[q], starts[q] + at + 1, len(text) - 1)]
            dropped = inside & delete[q] & ~((at + 1 < sizes[q]) & (here == after) & (here >= 0))
            edited = _joined([edited, (q[dropped], at[dropped] + 1, *[c[dropped] for c in clean[2:]])])

            own, other, size = clean[2:]
            child, symbol, rank, count, smaller = self.ranks[right].all(own, own + size)
            letter = symbol > _EDGE
            child, symbol = child[letter], symbol[letter]
            row = (self.before[symbol] + rank[letter], other[child] + smaller[letter], count[letter])
            cq, cat, cin = q[child], at[child], inside[child]
            same = cin & (symbol == here[child])
            swapped, added = cin & ~same & replace[cq], ~same & insert[cq]
            clean = (cq[same], cat[same] + 1, *[r[same] for r in row])

            q, at = edited[:2]
            inside = at < sizes[q]
            symbol = np.where(inside, text[np.where(inside, starts[q] + at, len(text) - 1)], _EDGE)
            match = self.extend(right, edited[2:], symbol)
            alive = match[2] > 0
            ended, going = alive & ~inside, alive & inside
            found.append((q[ended], (match[1] if right else match[0])[ended] - 2))
            edited = _joined([
                (q[going], at[going] + 1, *[m[going] for m in match]),
                (cq[swapped], cat[swapped] + 1, *[r[swapped] for r in row]),
                (cq[added], cat[added], *[r[added] for r in row]),
            ])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _joined(fronts: list[tuple]) -> tuple:
    if not fronts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(parts) for parts in zip(*fronts, strict=True))


def _search(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Per query of a shard: how many near words it holds, and the most frequent of them."""
    texts = texts.drop_duplicates("word").sort_values("word", key=lambda w: w.map(lambda s: s.encode("utf-32-be")))
    words, n = texts["word"].tolist(), texts["n"].to_numpy(np.int64)
    index = WordIndex(words)
    found: dict[str, list] = {"word": [], "n_near": [], "near": [], "near_n": []}
    for right in (True, False):
        side = asked[asked["ahead"] == right]
        if side.empty:
            continue
        # one search per query, with the edits that lead to the lengths asked for here
        edits = side.assign(
            replace=side["gap"] == 0, insert=side["gap"] == 1, delete=side["gap"] == -1
        ).groupby("query", sort=False)[["replace", "insert", "delete"]].any()
        queries = edits.index.tolist()
        q, w = index.near(queries, edits.to_numpy(bool), right)
        if not right:  # words that keep the first half too are found by the other search
            other = [not words[b].startswith(queries[a][: len(queries[a]) // 2]) for a, b in zip(q, w, strict=True)]
            q, w = q[other], w[other]
        if not len(q):
            continue
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        found["word"] += [queries[i] for i in q[begin]]
        found["n_near"] += np.diff(np.append(begin, len(q))).tolist()
        found["near"] += [words[i] for i in w[begin]]
        found["near_n"] += n[w[begin]].tolist()
    return pd.DataFrame({c: pd.Series(v, dtype=object if c in ("word", "near") else np.int64) for c, v in found.items()})


def _key(word: Column, length: Column, ahead: Column) -> Column:
    """What a word of ``length`` shares with every word that finds it by this half."""
    first, last = F.floor((length - 1) / 2).cast("int"), F.ceil((length - 1) / 2).cast("int")
    return F.xxhash64(ahead, length, F.when(ahead, F.left(word, first)).otherwise(F.right(word, last)))


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every word with a near word: ``word, n_near, near, near_n``.

    ``vocabulary(word, n)`` holds distinct words of two code points or more, none below U+0002.
    Words are near if they differ by exactly one inserted, deleted or replaced code point; near
    is the one of largest n, then the smallest in code-point order.
    """
    sides = F.explode(F.array(F.lit(True), F.lit(False)))
    length = F.char_length("word")
    texts = vocabulary.select("word", "n", sides.alias("ahead")).withColumn("key", _key(F.col("word"), length, F.col("ahead")))
    asked = (
        vocabulary.select(F.col("word").alias("query"), length.alias("length"), sides.alias("ahead"))
        .withColumn("gap", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("key", _key(F.col("query"), F.col("length") + F.col("gap"), F.col("ahead"))).drop("length")
    )
    shards = max(1, -(-2 * vocabulary.count() // shard_words))
    most = max(1, shard_words // 4)
    sizes = (
        texts.select("key", F.lit(1).alias("t"), F.lit(0).alias("a"))
        .unionAll(asked.select("key", F.lit(0).alias("t"), F.lit(1).alias("a")))
        .groupBy("key").agg(F.sum("t").alias("t"), F.sum("a").alias("a"))
    )
    cut = spool(
        sizes.filter((F.col("t") > most) | (F.col("a") > 3 * most)).select(
            "key", F.ceil(F.col("t") / most).cast("int").alias("cut_t"),
            F.ceil(F.col("a") / (3 * most)).cast("int").alias("cut_a"),
        )
    )

    def placed(rows: DataFrame, word: str, own: str, across: str) -> DataFrame:
        """Rows of a cut key go to one of its own parts, times every part of the other side, and
        each such cell is searched by itself, so that no pair meets twice."""
        def cuts(column):
            return F.greatest(F.coalesce(column, F.lit(1)), F.lit(1))

        alone = F.coalesce("cut_t", "cut_a").isNotNull()
        spread = (
            lookup(rows, cut, ["key"], ["cut_t", "cut_a"])
            .withColumn("own", F.pmod(F.xxhash64(word), cuts(own).cast("bigint")).cast("int"))
            .withColumn("across", F.explode(F.sequence(F.lit(0), cuts(across) - 1)))
        )
        of_text, of_query = ("own", "across") if own == "cut_t" else ("across", "own")
        return spread.select(
            *[c for c in rows.columns if c != "key"],
            F.when(alone, F.lit(-1)).otherwise(F.pmod("key", F.lit(shards))).alias("shard"),
            F.when(alone, F.col("key")).otherwise(0).alias("cell"),
            F.col(of_text).alias("text_part"), F.col(of_query).alias("query_part"),
        )

    group = ["shard", "cell", "text_part", "query_part"]
    found = (
        placed(texts, "word", "cut_t", "cut_a").groupBy(*group)
        .cogroup(placed(asked, "query", "cut_a", "cut_t").groupBy(*group))
        .applyInPandas(_search, "word string, n_near long, near string, near_n long")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "best.near", (-F.col("best.neg")).alias("near_n")
    )


def variants(vocabulary: DataFrame, times: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every word with its form and root: ``word, form, root, n, n_near, form_n``.

    The form is the near word of largest n (ties: smallest in code-point order) if that n is at
    least ``times`` the word's, else null; the root ends the chain of forms and is the word
    itself where there is none. An empty vocabulary gives an empty table.
    """
    near = spool(near_words(vocabulary, shard_words))
    known = vocabulary.join(near, "word", "left").withColumn(
        "follows", F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False))
    ).select(
        "word", F.when(F.col("follows"), F.col("near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("follows"), F.col("near_n")).alias("form_n"),
    )
    known = spool(known)
    roots = _roots(known.filter("form is not null").select(F.col("word").alias("v"), F.col("form").alias("to")))
    return known.join(roots.select(F.col("v").alias("word"), F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
