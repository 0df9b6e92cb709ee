"""Token counts of whole texts by a unigram model, shared along a trie of pre-tokens.

Distinct pre-tokens are put into a trie. The best forward score of a prefix depends on that
prefix alone, so it is computed once per trie node: the best over the pieces that end there of
the score where the piece begins plus the piece's own. The number of pieces on the best path is
carried along and stored where a pre-token ends; a text's count is the sum over its pre-tokens.
Very long pre-tokens are counted alone, in blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import BLOCK, KEPT_LENGTH, Pieces, pieces_at, units

#: pre-tokens whose counts a worker keeps
MAX_KEPT = 400_000


class TrieCounter:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.kept = pieces, {}
        # pieces spelt from their last character, so that a walk towards the root reads them
        nodes, moves, ends = 1, {}, {}
        for piece in pieces.ids:
            at = 0
            for char in reversed(piece):
                move = (at << 21) | ord(char)
                if move not in moves:
                    moves[move] = nodes
                    nodes += 1
                at = moves[move]
            ends[at] = pieces.logp[piece]
        self.keys = np.array(sorted(moves), dtype=np.int64)
        self.to = np.array([moves[m] for m in self.keys.tolist()], dtype=np.int64)
        self.is_end, self.score = np.zeros(nodes, dtype=bool), np.zeros(nodes)
        for at, score in ends.items():
            self.is_end[at], self.score[at] = True, score
        self.byte_logp = pieces.byte_logp

    @staticmethod
    def trie(words: list[str]):
        """Nodes of the trie, breadth first: parent, character, first node of each depth, and
        the node at which each word ends. ``words`` are sorted and distinct."""
        lengths = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begins = np.concatenate(([0], lengths.cumsum()[:-1]))
        parents, letters, depths = [np.array([-1])], [np.array([-1])], [0, 1]
        ends = np.zeros(len(words), dtype=np.int64)
        active, at, nodes, depth = np.flatnonzero(lengths), np.zeros(len(words), dtype=np.int64), 1, 0
        while len(active):
            letter = chars[begins[active] + depth]
            above = at[active]
            # sorted words keep those of one prefix together
            new = np.concatenate(([True], (above[1:] != above[:-1]) | (letter[1:] != letter[:-1])))
            at[active] = nodes + new.cumsum() - 1
            parents.append(above[new])
            letters.append(letter[new])
            nodes += int(new.sum())
            depths.append(nodes)
            depth += 1
            done = lengths[active] == depth
            ends[active[done]] = at[active[done]]
            active = active[~done]
        return np.concatenate(parents), np.concatenate(letters), depths, ends

    def count_new(self, words: list[str]) -> list[int]:
        """Pieces on the best path of each word; equal scores prefer the longer last piece."""
        parent, letter, depths, ends = self.trie(words)
        found = []
        node = np.arange(1, len(parent))
        above, walk = node, np.zeros(len(node), dtype=np.int64)
        size = 0
        while len(node):
            keys = (walk << 21) | letter[above]
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[spot] == keys
            node, above, walk = node[hit], parent[above[hit]], self.to[spot[hit]]
            size += 1
            full = self.is_end[walk]
            found.append((node[full], above[full], self.score[walk[full]], np.ones(int(full.sum()), dtype=np.int64)))
            if size == 1:
                bare = np.ones(len(parent), dtype=bool)
                bare[0] = False
                bare[node[full]] = False
                bare = np.flatnonzero(bare)
                code = letter[bare]
                width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                found.append((bare, parent[bare], width * self.byte_logp, width))
            more = above > 0
            node, above, walk = node[more], above[more], walk[more]
        node, start, score, pieces = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((start, node))
        node, start, score, pieces = node[order], start[order], score[order], pieces[order]
        cuts = np.searchsorted(node, depths)
        best, count = np.full(len(parent), -np.inf), np.zeros(len(parent), dtype=np.int64)
        best[0] = 0.0
        for low, high in zip(cuts[1:-1], cuts[2:], strict=True):
            own = node[low:high]
            value = best[start[low:high]] + score[low:high]
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best[own[heads]] = np.maximum.reduceat(value, heads)
            first = np.flatnonzero(value == best[own])[::-1]  # the shortest start is written last
            count[own[first]] = count[start[low:high][first]] + pieces[low:high][first]
        return count[ends].tolist()

    def count_long(self, word: str) -> int:
        """``count_new`` of one word in blocks: the scores of as many last places as a piece is
        long go on to the next block."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        reach = self.pieces.longest
        best, count = [0.0] + [-math.inf] * reach, [0] * (reach + 1)
        for begin in range(0, len(chars), BLOCK):
            size, start, width, piece, logp = self.pieces.block(chars, begin)
            best += [-math.inf] * size
            count += [0] * size
            # what stands for a character without a piece is minus its code point
            code = np.maximum(-piece - 1, 0)
            tokens = np.where(piece >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
            edges = zip(start.tolist(), (start + width).tolist(), logp.tolist(), tokens.tolist(), strict=True)
            for at, goes, score, own in edges:
                value = best[at] + score
                if value > best[goes]:
                    best[goes], count[goes] = value, count[at] + own
            best, count = best[size:], count[size:]
        return count[0]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        flat, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            own = units(text)
            sizes[i] = len(own)
            flat += own
        numbers = list(map(self.kept.get, flat))
        if None in numbers:
            new = sorted({u for u, n in zip(flat, numbers, strict=True) if n is None})
            long = {u: self.count_long(u) for u in new if len(u) > BLOCK}
            new = [u for u in new if u not in long]
            fresh = dict(zip(new, self.count_new(new), strict=True)) if new else {}
            kept = {u: n for u, n in fresh.items() if len(u) <= KEPT_LENGTH}
            if len(self.kept) + len(kept) <= MAX_KEPT:
                self.kept.update(kept)
            fresh |= long
            numbers = [fresh[u] if n is None else n for u, n in zip(flat, numbers, strict=True)]
        run = np.concatenate(([0], np.array(numbers, dtype=np.int64).cumsum()))
        return sizes, np.diff(run[np.concatenate(([0], sizes.cumsum()))])


@lru_cache(maxsize=1)
def _counter(path: str, sharpness: float) -> TrieCounter:
    return TrieCounter(pieces_at(path, sharpness))


def token_counts(docs: DataFrame, path: str, *, sharpness: float = 1.0) -> DataFrame:
    """One row per document: doc_id, n_chars, n_pretokens, n_tokens.

    Counts cover whole texts and need no shuffle; a worker keeps the counts of a bounded number
    of pre-tokens. Null and empty texts count 0. Rows that repeat a doc_id are each returned; an
    empty table gives no rows.
    """

    def run(batches):
        counter = _counter(path, sharpness)
        for batch in batches:
            texts = batch["text"].tolist()
            start, found = 0, []
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                found.append(counter.count(texts[start:stop]))
                start = stop
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": [len(t) for t in texts]})
            out["n_pretokens"] = np.concatenate([f[0] for f in found]) if found else []
            out["n_tokens"] = np.concatenate([f[1] for f in found]) if found else []
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInPandas(run, "doc_id string, n_chars long, n_pretokens long, n_tokens long")
    return counted.withColumn("doc_id", F.col("doc_id").cast("long"))
