"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The segmentations of a text form a lattice whose edges are pieces. A unigram score per piece and
one backward pass per word suffix turn it into a Markov chain with exact probabilities. The
k segmentations of largest perturbed log-probability are a sample without replacement; they come
out of a best-first search over sets of segmentations: a popped set is split along one sampled
path, and what departs from the path at each step is one new set whose perturbed maximum is a
Gumbel value truncated at that of the set it left. The search is exact and touches one path's
steps per sample. Every draw is a hash of (seed, row key, sample, place), so results depend on
the row alone.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, mixed

#: longer words are scored in blocks of this many characters; scores run on across the blocks
BLOCK = 4096
#: longer words are forgotten after their call
KEPT_LENGTH = 256
#: states of words that a worker keeps between calls
MAX_STATES = 800_000
_WORDS_AT_ONCE = 75_000
_END = 0
_UNIT = re.compile(r" *[^ \n]+|\n| +")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Pieces:
    """Ids, bytes and unigram log-probabilities of a piece model, with a trie over the pieces.

    The file stores merge ranks, not probabilities; they become Zipf probabilities 1 / rank,
    normalised over the vocabulary and raised to ``sharpness``. Byte pieces stand in where a
    character has no piece. Spaces are kept as they are inside, so a literal U+2581 is spelt in
    bytes and every text decodes to itself.
    """

    def __init__(self, path: str, sharpness: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        total = sum(1 / (rank + 1) for rank in range(size))
        self.ids: dict[str, int] = {}
        self.logp: dict[str, float] = {}
        self.raw: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.raw[i], self.byte_ids[value] = bytes([value]), i
                continue
            piece = piece.replace("▁", " ")
            if "\n" in piece or re.search("[^ ] ", piece):
                continue  # would cross the border of two units
            rank = min(-model.get_score(i), float(size)) + 1
            self.ids[piece] = i
            self.logp[piece] = -sharpness * (math.log(max(rank, 1.0)) + math.log(total))
            self.raw[i] = piece.encode()
        self.ascii_ids = np.array(self.byte_ids[:0x80], dtype=np.int32)
        self.byte_logp = -sharpness * (math.log(size) + math.log(total))
        self.longest = max(map(len, self.ids), default=1)
        self._build_trie()
        self.raw_sizes = np.array([len(raw) for raw in self.raw], dtype=np.int64)
        self.raw_begins = self.raw_sizes.cumsum() - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

    def _build_trie(self) -> None:
        nodes, moves, ends = 1, {}, {}
        for piece, number in self.ids.items():
            at = 0
            for char in piece:
                move = (at << 21) | ord(char)
                if move not in moves:
                    moves[move] = nodes
                    nodes += 1
                at = moves[move]
            ends[at] = (number, self.logp[piece])
        keys, targets = (np.fromiter(part, dtype=np.int64, count=len(moves)) for part in (moves, moves.values()))
        # moves by an open hash table, an eighth of it or less in use
        bits = (8 * len(moves) + 8).bit_length()
        self.move_shift, self.move_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.move_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.move_to = np.zeros(1 << bits, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.move_keys[slots] < 0
            self.move_keys[slots[free]] = keys[free]
            placed = self.move_keys[slots] == keys
            self.move_to[slots[placed]] = targets[placed]
            keys, targets, slots = keys[~placed], targets[~placed], (slots[~placed] + 1) & self.move_mask
        self.end_piece = np.full(nodes, -1, dtype=np.int32)
        self.end_logp = np.zeros(nodes)
        for at, (number, score) in ends.items():
            self.end_piece[at], self.end_logp[at] = number, score

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _A) >> self.move_shift).astype(np.int64)

    def _moved(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which moves exist, and the nodes that those lead to."""
        slots = self._slots(keys)
        met = self.move_keys[slots]
        off = np.flatnonzero((met != keys) & (met >= 0))
        while len(off):
            slots[off] = (slots[off] + 1) & self.move_mask
            met[off] = self.move_keys[slots[off]]
            off = off[(met[off] != keys[off]) & (met[off] >= 0)]
        hit = met == keys
        return hit, self.move_to[slots[hit]].astype(np.int64)

    def matches(self, chars: np.ndarray, left: np.ndarray):
        """Every piece that starts at each place and ends within its word: (place, size, piece,
        log-probability). ``left`` is the number of characters up to the word's end. A place
        without a piece of one character gets its byte spelling, as minus its code point."""
        found = []
        places, nodes = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        size = 0
        while len(places):
            keys = (nodes << 21) | chars[places + size]
            hit, nodes = self._moved(keys)
            places = places[hit]
            size += 1
            ends = self.end_piece[nodes] >= 0
            own = places[ends]
            found.append((own, np.full(len(own), size), self.end_piece[nodes[ends]], self.end_logp[nodes[ends]]))
            if size == 1:
                spelt = np.ones(len(chars), dtype=bool)
                spelt[own] = False
                rare = np.flatnonzero(spelt)
                code = chars[rare]
                width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                found.append((rare, np.ones(len(rare), dtype=np.int64), -code - 1, width * self.byte_logp))
            more = left[places] > size
            places, nodes = places[more], nodes[more]
        return [np.concatenate(part) for part in zip(*found, strict=True)]

    def sorted_matches(self, chars: np.ndarray, left: np.ndarray):
        """``matches`` by place and size. Matches of one size come by place, so a place's next
        free slot is counted up size by size instead of sorting."""
        place, size, piece, logp = self.matches(chars, left)
        free = np.concatenate(([0], np.bincount(place, minlength=len(chars)).cumsum()))[:-1]
        slot = np.empty(len(place), dtype=np.int64)
        cuts = np.flatnonzero((place[1:] <= place[:-1])) + 1
        for start, stop in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(place)])), strict=True):
            own = place[start:stop]
            slot[start:stop] = free[own]
            free[own] += 1
        order = np.empty(len(place), dtype=np.int64)
        order[slot] = np.arange(len(place))
        return place[order], size[order], piece[order], logp[order]

    def block(self, chars: np.ndarray, start: int):
        """``matches`` of the places of one block of a word, counted from its start, by place and
        size; the pieces may end behind the block."""
        size = min(BLOCK, len(chars) - start)
        near = chars[start : start + size + self.longest + 1].astype(np.int64)
        place, width, piece, logp = self.matches(near, len(near) - np.arange(len(near)))
        own = np.flatnonzero(place < size)
        own = own[np.lexsort((width[own], place[own]))]
        return size, place[own], width[own], piece[own], logp[own]

    def spelled(self, path: np.ndarray) -> np.ndarray:
        """Piece ids of a path; byte spellings become their byte pieces."""
        if not len(path) or path.min() >= 0:
            return path
        path = np.where((path < 0) & (path >= -0x80), self.ascii_ids[np.clip(-path - 1, 0, 0x7F)], path)
        if path.min() >= 0:
            return path
        out: list[int] = []
        for code in path.tolist():
            if code >= 0:
                out.append(code)
            else:
                out.extend(self.byte_ids[b] for b in chr(-code - 1).encode("utf-8", "surrogatepass"))
        return np.array(out, dtype=np.int32)

    def all_spelled(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """``spelled`` of many paths at once."""
        bounds = np.concatenate(([0], np.cumsum([len(path) for path in paths])))
        flat = np.concatenate(paths)
        letters = np.flatnonzero((flat < 0) & (flat >= -0x80))
        flat[letters] = self.ascii_ids[-flat[letters] - 1]
        out = [flat[start:stop] for start, stop in itertools.pairwise(bounds.tolist())]
        rare = np.flatnonzero(flat < 0)
        for at in np.unique(np.searchsorted(bounds, rare, side="right") - 1).tolist() if len(rare) else []:
            out[at] = self.spelled(out[at])
        return out

    def round_trips(self, paths: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether each id sequence decodes to its text; the bytes of all are put together at once."""
        ids = np.concatenate(paths)
        sizes = self.raw_sizes[ids]
        run = np.concatenate(([0], sizes.cumsum()))
        spelt = self.raw_bytes[np.repeat(self.raw_begins[ids] - run[:-1], sizes) + np.arange(run[-1])].tobytes()
        bounds = run[np.concatenate(([0], np.cumsum([len(path) for path in paths])))].tolist()
        out = []
        for path, text, (start, stop) in zip(paths, texts, itertools.pairwise(bounds), strict=True):
            wanted = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            out.append(spelt[start:stop] == wanted or self.decode(path.tolist()) == text)
        return out

    def decode(self, ids) -> str:
        """Text of an id sequence; the space that encoding put in front is dropped again."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces_at(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


class Chain:
    """The lattices of words as one Markov chain: a state per place of a word.

    Edges of state s stand together, likely ones first, with the cumulative probabilities
    s + (0, 1], so a short scan draws the next piece of many words at once. Words stay until ``MAX_STATES`` are kept;
    from then on new words are built for one call and forgotten, as long words always are, so
    memory is bounded by the kept words and the texts of one call.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.kept: dict[str, int] = {}
        self.states, self.edges = 1, 0
        self.first = np.zeros(1 << 16, dtype=np.int32)
        self.upto, self.logq = np.zeros(1 << 16), np.zeros(1 << 16)
        self.target, self.piece = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.all_edges, self.all_states = 0, 1

    def _room(self, states: int, edges: int) -> None:
        for need, names in ((states + 1, ("first",)), (edges, ("upto", "logq", "target", "piece"))):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    more = max(need - len(old), len(old) // 8)
                    setattr(self, name, np.concatenate((old, np.zeros(more, dtype=old.dtype))))

    def _build(self, words: list[str]) -> np.ndarray:
        """Add the lattices of ``words`` behind the kept ones; their start states."""
        lengths = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = lengths.cumsum()
        end_of = np.repeat(ends, lengths)
        left = end_of - np.arange(len(chars))
        place, size, piece, logp = self.pieces.sorted_matches(chars, left)
        # backwards over the distance to the word's end, all words at once
        order = np.argsort(left.astype(np.int16)[place], kind="stable")
        beta = np.zeros(len(chars) + 1)
        own = place[order]
        goes = own + size[order]
        inside, logs = goes < end_of[own], logp[order]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bounds = np.searchsorted(left[own[heads]], np.arange(1, left.max() + 2)).tolist()
        cuts = np.append(heads, len(order))
        ordered = np.empty(len(order))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            start, stop = cuts[low], cuts[high]
            value = logs[start:stop] + np.where(inside[start:stop], beta[goes[start:stop]], 0.0)
            first = heads[low:high] - start
            top = np.maximum.reduceat(value, first)
            counts = cuts[low + 1 : high + 1] - heads[low:high]
            total = np.add.reduceat(np.exp(value - np.repeat(top, counts)), first)
            beta[own[heads[low:high]]] = top + np.log(total)
            ordered[start:stop] = value
        score = np.empty(len(order))
        score[order] = ordered
        base, edge_base = self.all_states, self.all_edges
        self._room(base + len(chars) + 1, edge_base + len(place))
        self._store(base, edge_base, place, place + size, piece, score, beta, place + size == end_of[place])
        self.first[base + len(chars)] = edge_base + len(place)
        self.all_edges, self.all_states = edge_base + len(place), base + len(chars)
        return base + ends - lengths

    def _store(self, base, edge_base, place, goes, piece, score, beta, last) -> None:
        """Put the edges of successive states, the first of them ``base``, from ``edge_base`` on.

        They come by ``place`` and are put likely ones first, equal ones as they came.
        """
        heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        counts = np.diff(np.append(heads, len(place)))
        gap = beta[place] - score
        order = np.arange(len(place))
        pairs = heads[counts == 2]
        turned = pairs[gap[pairs] > gap[pairs + 1]]
        order[turned], order[turned + 1] = turned + 1, turned
        for count in range(3, counts.max(initial=0) + 1):
            several = heads[counts == count, None] + np.arange(count)
            order[several] = several[:, :1] + np.argsort(gap[several], axis=1, kind="stable")
        goes, piece, last = goes[order], piece[order], last[order]
        logq = np.where(np.repeat(counts, counts) == 1, 0.0, -gap[order])
        run = np.exp(logq).cumsum()
        reached = run - np.repeat(np.concatenate(([0.0], run))[heads], counts)
        reached[heads + counts - 1] = 2.0  # the last edge takes what rounding leaves
        to = slice(edge_base, edge_base + len(place))
        self.upto[to] = base + place + reached
        self.logq[to], self.piece[to] = logq, piece
        self.target[to] = np.where(last, _END, base + goes)
        self.first[base : base + len(heads)] = edge_base + heads

    def _build_long(self, word: str) -> int:
        """Add the lattice of one long word block by block from its end; its start state.

        A block needs the backward scores of as many places behind it as a piece is long; they
        are carried relative to the first of them, so their size doesn't grow with the word.
        """
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blocks = range(0, len(chars), BLOCK)
        base = self.all_states
        stop = self.all_edges + sum(len(self.pieces.block(chars, start)[1]) for start in blocks)
        self._room(base + len(chars) + 1, stop)
        self.first[base + len(chars)] = stop
        self.all_edges, self.all_states = stop, base + len(chars)
        behind = [0.0] * (self.pieces.longest + 1)
        for start in reversed(blocks):
            size, place, width, piece, logp = self.pieces.block(chars, start)
            goes = place + width
            heads = np.searchsorted(place, np.arange(size)).tolist()
            beta, score, ahead, high = [0.0] * size + behind, logp.tolist(), goes.tolist(), len(place)
            for at in range(size - 1, -1, -1):
                low = heads[at]
                value = [a + beta[b] for a, b in zip(score[low:high], ahead[low:high], strict=True)]
                top = max(value)
                beta[at] = top + math.log(sum([math.exp(v - top) for v in value]))
                score[low:high] = value
                high = low
            stop -= len(place)
            self._store(
                base + start, stop, place, goes, piece, np.array(score), np.array(beta), start + goes == len(chars)
            )
            behind = [b - beta[0] for b in beta[: len(behind)]]
        return base

    def starts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Start states of the units of each text; valid until the next call."""
        kept, sizes = self.kept, [len(own) for own in texts]
        flat = list(itertools.chain.from_iterable(texts))
        numbers = np.fromiter(map(kept.get, flat, itertools.repeat(-1)), dtype=np.int64, count=len(flat))
        self.first[self.states] = self.all_edges = self.edges
        self.all_states = self.states
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            lacking = [flat[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lacking))
            short = [unit for unit in new if len(unit) <= KEPT_LENGTH]
            middle = [unit for unit in new if KEPT_LENGTH < len(unit) <= BLOCK]
            built = dict(zip(short, self._build(short).tolist(), strict=True)) if short else {}
            if self.states <= MAX_STATES:
                kept.update(built)
                self.states, self.edges = self.all_states, self.all_edges
            if middle:
                built |= zip(middle, self._build(middle).tolist(), strict=True)
            built |= {unit: self._build_long(unit) for unit in new if len(unit) > BLOCK}
            numbers[missing] = np.fromiter(map(built.__getitem__, lacking), dtype=np.int64, count=len(lacking))
        return np.split(numbers, np.cumsum(sizes)[:-1]) if texts else []


def units(text: str) -> list[str]:
    """Runs of spaces with the characters that follow, line ends apart."""
    return _UNIT.findall(" " + text) if text else []


def _uniform(seeds: np.ndarray, place: np.ndarray | int, step: np.ndarray | int, purpose: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on these values alone."""
    place = np.asarray(place, dtype=np.uint64)
    step = np.asarray(step, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = mix64(seeds + place * _A + step * _B + np.uint64(purpose) * _C)
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _uniform_one(seed: int, place: int, step: int, purpose: int) -> float:
    """``_uniform`` of single numbers."""
    bits = mixed(seed + place * int(_A) + step * int(_B) + purpose * int(_C))
    return ((bits >> 12) + 0.5) / 2.0**52


class Sampler:
    """Samples for a list of documents at once."""

    def __init__(self, pieces: Pieces, samples: int, seed: int) -> None:
        self.chain, self.k, self.seed = Chain(pieces), samples, seed

    def _walk(self, starts, seeds, places, purpose):
        """Sampled paths from many states: edges in order and the number of steps of each."""
        chain = self.chain
        upto, target, first = chain.upto[: chain.all_edges], chain.target, chain.first
        steps = np.zeros(len(starts), dtype=np.int64)
        active = np.flatnonzero(starts != _END)
        states, taken = starts[active].astype(np.int64), []
        step = 0
        while len(active):
            draws = _uniform(seeds[active], places[active], step, purpose)
            edges, goal = first[states].astype(np.int64), states + draws
            # likely edges come first, so few walks go past the first of a state
            late = np.flatnonzero(upto[edges] < goal)
            while len(late):
                edges[late] += 1
                late = late[upto[edges[late]] < goal[late]]
            taken.append((active, edges))
            steps[active] += 1
            states = target[edges].astype(np.int64)
            going = states != _END
            active, states = active[going], states[going]
            step += 1
        offsets = np.concatenate(([0], steps.cumsum()))
        flat = np.zeros(offsets[-1], dtype=np.int64)
        for step, (active, edges) in enumerate(taken):
            flat[offsets[active] + step] = edges
        return flat, steps

    def _departures(self, path, lengths, fixed, gumbel, seeds, purpose, most):
        """Per document the ``most`` best sets that leave its path, as (G, step, log mass before).

        ``fixed`` steps at the start of each path are not departed from.
        """
        logq = self.chain.logq[path]
        ends = lengths.cumsum()
        begins = ends - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(path)) - begins[doc]
        run = np.concatenate(([0.0], logq.cumsum()))
        before = run[:-1] - run[begins][doc]
        total = run[ends] - run[begins]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            rest = before + np.log(-np.expm1(logq))
            waits = -np.log(_uniform(seeds[doc], at, 0, purpose))
            value = rest - np.log(waits + np.exp(np.minimum(rest - gumbel[doc], 700)))
        value[(at < fixed[doc]) | ~np.isfinite(rest)] = -np.inf
        found: list[list[tuple[float, int, float]]] = [[] for _ in lengths]
        some = np.flatnonzero(lengths)
        for _ in range(most if len(some) else 0):
            best = np.maximum.reduceat(value, begins[some])
            alive = np.isfinite(best)
            some, best = some[alive], best[alive]
            if not len(some):
                break
            full = np.full(len(lengths), np.inf)
            full[some] = best
            hits = np.flatnonzero(value == full[doc])
            _, unique = np.unique(doc[hits], return_index=True)
            for place in hits[unique]:
                found[doc[place]].append((value[place], int(at[place]), before[place]))
            value[hits[unique]] = -np.inf
        return found, total

    def _other(self, edges: range, barred: set[int], draw: float) -> tuple[int, float]:
        """An edge outside ``barred`` in proportion to its probability, and the mass left over."""
        logq = self.chain.logq
        free = [e for e in edges if e not in barred]
        mass = [math.exp(logq[e]) for e in free]
        goal, total = draw * sum(mass), sum(mass)
        for edge, part in zip(free, mass, strict=True):
            goal -= part
            if goal <= 0:
                return edge, total - part
        return free[-1], total - mass[-1]

    def _pass(self, docs, number):
        """Sample path ``number`` for every document that still has a set to split."""
        starts, seeds, places, counts = [], [], [], []
        for doc in docs:
            begin = doc["word"] + 1 if number else 0
            tail = doc["starts"][begin:]
            if number:
                tail = np.concatenate(([doc["goes_to"]], tail))
            starts.append(tail)
            counts.append(len(tail))
            places.append(np.arange(len(doc["starts"]) - len(tail), len(doc["starts"])))
        counts = np.array(counts)
        own = np.array([d["seed"] for d in docs], dtype=np.uint64)
        flat, steps = self._walk(
            np.concatenate(starts), np.repeat(own, counts), np.concatenate(places), 2 * number
        )
        bounds = np.concatenate(([0], steps.cumsum()))[np.concatenate(([0], counts.cumsum()))]
        lengths, fixed, whole = [], [], []
        word_bounds = np.concatenate(([0], counts.cumsum()))
        for i, doc in enumerate(docs):
            new, taken = flat[bounds[i] : bounds[i + 1]], steps[word_bounds[i] : word_bounds[i + 1]]
            if number:
                cut = doc["cut"]
                head = np.concatenate((doc["parent"][:cut], [doc["edge"]]))
                words = doc["parent_steps"][: doc["word"]]
                inside = cut + 1 - words.sum()
                doc["path"] = np.concatenate((head, new)).astype(np.int64)
                doc["steps"] = np.concatenate((words, [inside + taken[0]], taken[1:]))
            else:
                doc["path"], doc["steps"] = new, taken
            fixed.append(doc["cut"] + 1 if number else 0)
            lengths.append(len(doc["path"]))
            whole.append(doc["path"])
        return self._departures(
            np.concatenate(whole), np.array(lengths), np.array(fixed),
            np.array([d["gumbel"] for d in docs]), own, 2 * number + 1, self.k - number,
        )

    def sample(self, keys: list[str], texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text its samples, best first: (ids, log_prob, perturbed, log_inclusion)."""
        chain = self.chain
        docs = []
        for key, starts in zip(keys, chain.starts([units(text) for text in texts]), strict=True):
            row = zlib.crc32(key.encode()) + (zlib.adler32(key.encode()) << 32) + self.seed * 0x632BE5AB
            seed = mixed(row)
            gumbel = -math.log(-math.log(_uniform_one(seed, 0, 0, 1_000_003)))
            docs.append({
                "starts": starts, "seed": seed, "gumbel": gumbel,
                "heap": [], "samples": [],
            })
        live = docs
        for number in range(self.k):
            if not live:
                break
            departures, totals = self._pass(live, number)
            for doc, sets, total in zip(live, departures, totals, strict=True):
                doc["samples"].append((doc["path"], float(total), doc["gumbel"]))
                self._queue(doc, sets, number)
            live = [d for d in live if self._pop(d, number)] if number + 1 < self.k else []
        spelt = iter(chain.pieces.all_spelled([chain.piece[path] for doc in docs for path, *_ in doc["samples"]]))
        out = []
        for doc in docs:
            bar = -doc["heap"][0][0] if doc["heap"] else -math.inf
            out.append([
                (next(spelt), logp, gumbel, _log_inclusion(logp, bar)) for _, logp, gumbel in doc["samples"]
            ])
        return out

    def _queue(self, doc, sets, number) -> None:
        for value, cut, before in sets:
            heapq.heappush(doc["heap"], (-value, number, cut, before, doc["path"], doc["steps"], frozenset([int(doc["path"][cut])])))
        left = doc.pop("left", None)
        if left is not None:
            mass, before, barred, cut, parent, steps = left
            if mass > 1e-13:
                rest = before + math.log(mass)
                wait = -math.log(_uniform_one(doc["seed"], cut, number, 1_000_033))
                value = rest - math.log(wait + math.exp(min(rest - doc["gumbel"], 700)))
                heapq.heappush(doc["heap"], (-value, number, cut, before, parent, steps, barred))

    def _pop(self, doc, number) -> bool:
        """Take the set of largest perturbed value and choose where it goes at its first step."""
        if not doc["heap"]:
            return False
        value, _, cut, before, parent, steps, barred = heapq.heappop(doc["heap"])
        chain = self.chain
        first = chain.first
        state = int(np.searchsorted(first[: chain.all_states + 1], np.int32(parent[cut]), side="right")) - 1
        draw = _uniform_one(doc["seed"], cut, number, 1_000_019)
        edge, mass = self._other(range(first[state], first[state + 1]), barred, draw)
        doc.update(
            gumbel=-value, cut=cut, parent=parent, parent_steps=steps, edge=edge,
            goes_to=int(chain.target[edge]),
            word=int(np.searchsorted(steps.cumsum(), cut, side="right")),
            left=(mass, before, barred | {edge}, cut, parent, steps),
        )
        return True


def _log_inclusion(logp: float, bar: float) -> float:
    """log P(a Gumbel at logp exceeds the first perturbed value left out)."""
    if bar == -math.inf:
        return 0.0
    gap = logp - bar
    return gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 50.0)))) + 0.0


def sample_encodings(
    docs: DataFrame, path: str, *, samples: int = 2, seed: int = 17, sharpness: float = 1.0
) -> DataFrame:
    """One row per document and sample: doc_id, sample, ids, n_pieces, log_prob, perturbed,
    inclusion, log_inclusion, ids_crc32, round_trip.

    Segmentations of one document differ from each other; a text with fewer than ``samples`` of
    them gives all it has. log_prob is relative to all segmentations of the text, inclusion the
    probability that a threshold sample holds this one, given the first value left out. Draws
    are seeded by doc_id (null: an own key), so equal rows give equal samples. Null and empty
    texts have one empty segmentation. round_trip says that decoding returns the text.
    """
    schema = (
        "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, "
        "inclusion double, log_inclusion double, ids_crc32 long, round_trip boolean"
    )

    def run(batches):
        pieces = pieces_at(path, sharpness)
        sampler = _sampler(path, sharpness, samples, seed)
        for batch in batches:
            keys = batch["key"].tolist()
            texts = batch["text"].tolist()
            ids = batch["doc_id"].tolist()
            start = 0
            while start < len(keys):
                stop, size = start, 0
                while stop < len(keys) and (stop == start or size + len(texts[stop]) // 4 < _WORDS_AT_ONCE):
                    size += len(texts[stop]) // 4
                    stop += 1
                found = sampler.sample(keys[start:stop], texts[start:stop])
                yield _frame(pieces, ids[start:stop], texts[start:stop], found)
                start = stop

    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # ids travel as text key; doc_id as an object column keeps nulls exact
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text").mapInPandas(
        run, schema
    )


@lru_cache(maxsize=1)
def _sampler(path: str, sharpness: float, samples: int, seed: int) -> Sampler:
    return Sampler(pieces_at(path, sharpness), samples, seed)


def _frame(pieces: Pieces, ids, texts, found) -> pd.DataFrame:
    rows = []
    held = iter(pieces.round_trips(
        [path for samples in found for path, *_ in samples],
        [text for text, samples in zip(texts, found, strict=True) for _ in samples],
    ))
    for doc_id, samples in zip(ids, found, strict=True):
        for number, (path, logp, perturbed, inclusion) in enumerate(samples):
            rows.append((
                None if doc_id is None else int(doc_id), number, path, len(path), logp, perturbed,
                math.exp(inclusion), inclusion, zlib.crc32(path.astype("<u4", copy=False).data), next(held),
            ))
    out = pd.DataFrame(rows, columns=[
        "doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion",
        "log_inclusion", "ids_crc32", "round_trip",
    ])
    return out.astype({"doc_id": "Int64"})
