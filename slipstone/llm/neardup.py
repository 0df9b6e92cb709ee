"""Near-duplicate groups by a chosen-path set similarity join.

Every text becomes the set of its word shingles and a row of minwise tokens. A tree starts at
one minwise coordinate and sends each document down the branch of its token there; a node that
still holds more documents than ``node_limit`` picks further coordinates by hashing its own path
and branches again. Small nodes are compared exhaustively on sketches, candidates are confirmed
on the full shingle sets, and independent trees repeat the walk until the target recall holds.

Equal sets are one vertex from the start, so exact copies cost nothing. A node that branching
can't split because most members resemble each other is compared with two pivots. Such nodes of
all trees whose pivots are then in one component become one node; members that the confirmed
links leave outside that component meet, in tiles, all members that their distances to the pivot
leave possible.
Groups of bounded size are confirmed where they are: members with a candidate bring their full
sets, pairs are tried strongest first, and pairs already joined are skipped, so a group gives a
spanning forest of its links and no pair list is ever written. Nothing is capped.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spool
from .common import WordHasher, mix64, shingle_set
from .components import components

COORDS = 64
NODE_LIMIT = 48
BRANCHES = 2
DEPTH = 6
#: sketch agreement that sends a pair to the exact check: four standard deviations under 0.8
ASK = 0.6
#: a node with this share of members like its pivot is not branched any more
DENSE_SHARE, DENSE_AGREE = 0.3, 0.7
_TILE = 64
#: sketches of a candidate pair differ in this many places at most
_REACH = COORDS - math.ceil(ASK * COORDS)
#: width of the bands of distance to the pivot in which members of a dense node meet
_BAND = 5
#: ids that one broadcast holds, and how often the texts are scanned at most before they are shuffled
_IDS_AT_ONCE, _SCANS = 1 << 20, 4


def trees_for(recall: float, similarity: float) -> int:
    """Trees after which a pair just at ``similarity`` is met with probability ``recall``.

    A branching node passes the pair on unless all its branches part it; the fixed point of
    that recursion times the first branch is one tree's chance.
    """
    meets = 1.0
    for _ in range(DEPTH):
        meets = 1 - (1 - similarity * meets) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity * meets, 0.999999))))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_601)
    top = np.iinfo(np.uint64).max
    return (
        draw.integers(0, top, COORDS, dtype=np.uint64) | np.uint64(1),
        draw.integers(0, top, COORDS, dtype=np.uint64),
    )


def minwise(members: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set under each coordinate's own hash function."""
    times, plus = _multipliers()
    lowest = np.full(COORDS, np.iinfo(np.uint32).max, dtype=np.uint64)
    for start in range(0, len(members), 4096):
        block = members[start : start + 4096, None] * times + plus
        lowest = np.minimum(lowest, (block >> np.uint64(32)).min(axis=0))
    return lowest.astype(np.uint32)


def _fingerprint(members: np.ndarray) -> bytes:
    """128 bits that stand for the whole set, order of the text aside."""
    parts = [
        int(np.bitwise_xor.reduce(members * np.uint64(m))) + s * int(members.sum(dtype=np.uint64))
        for m, s in ((0x9FB21C651E98DF25, 3), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    ]
    return b"".join((p % 2**64).to_bytes(8, "little") for p in parts)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), fp (16 bytes), sig (minwise tokens), sketch (their low bytes)."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                members = shingle_set(hasher(text or ""), words)
                if not len(members):
                    rows.append((0, None, None, None))
                    continue
                low = minwise(members)
                rows.append((
                    len(members), _fingerprint(members), low.view(np.int32),
                    low.astype(np.uint8).tobytes(),
                ))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].array,
                "n": np.array([r[0] for r in rows], dtype=np.int64),
                "fp": [r[1] for r in rows],
                "sig": [r[2] for r in rows],
                "sketch": [r[3] for r in rows],
            })

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n long, fp binary, sig array<int>, sketch binary"
    )


def _child_keys(parent: Column | None, sig: Column, trees: int) -> Column:
    """Node keys of the next level: the token at coordinates that the node's path selects."""
    if parent is None:
        return F.array(*[
            F.xxhash64(F.lit(tree), F.element_at(sig, tree % COORDS + 1)) for tree in range(trees)
        ])
    picks = []
    for branch in range(BRANCHES):
        where = F.pmod(F.xxhash64(parent, F.lit(branch)), F.lit(COORDS)).cast("int")
        picks.append(F.xxhash64(parent, where, F.element_at(sig, where + 1)))
    return F.array(*picks)


def _candidates(ids, sizes, part, asks, sketch, similarity: float):
    """Positions i < j of the pairs of one group that may be similar, and their agreement."""
    i, j = np.triu_indices(len(ids), 1)
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    near = (low >= similarity * high) & (asks[i] | asks[j]) & (part[i] != part[j]) & (ids[i] != ids[j])
    i, j = i[near], j[near]
    agree = (sketch[i] == sketch[j]).mean(axis=1) if len(i) else np.zeros(0)
    return i[agree >= ASK], j[agree >= ASK], agree[agree >= ASK]


def _linked_parts(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The positions that the pairs i, j connect, part by part."""
    if len(i) == 1:
        return [np.array([i[0], j[0]])]
    some, ends = np.unique(np.concatenate((i, j)), return_inverse=True)
    left, right = ends[: len(i)], ends[len(i) :]
    label = np.arange(len(some))
    while True:
        low = np.minimum(label[left], label[right])
        lower = label.copy()
        np.minimum.at(lower, left, low)
        np.minimum.at(lower, right, low)
        if (lower == label).all():
            break
        label = lower
    return [some[label == part] for part in np.unique(label)]


def _promising(groups: DataFrame, similarity: float) -> DataFrame:
    """Members (g, id, ask) of bounded groups that have a candidate by size and sketch.

    What candidates connect is a group of its own, named by its members, so that one met in
    several trees and nodes is confirmed once.

    Groups carry members (id, n, sketch, part, ask); pairs of one part (component) and pairs
    without an asking member are no candidates.
    """

    def run(batches):
        for batch in batches:
            out = []
            for members in batch["members"]:
                part = np.array([m["part"] for m in members], dtype=np.int64)
                if (part == part[0]).all():
                    continue
                ids = np.array([m["id"] for m in members], dtype=np.int64)
                sizes = np.array([m["n"] for m in members], dtype=np.int64)
                asks = np.array([m["ask"] for m in members], dtype=bool)
                sketch = np.frombuffer(b"".join(bytes(m["sketch"]) for m in members), dtype=np.uint8).reshape(-1, COORDS)
                i, j, _ = _candidates(ids, sizes, part, asks, sketch, similarity)
                for some in _linked_parts(i, j) if len(i) else []:
                    name = mix64(ids[some].view(np.uint64) * np.uint64(2) + asks[some]).sum(dtype=np.uint64)
                    out.append((np.full(len(some), name).view(np.int64), ids[some], asks[some]))
            yield pd.DataFrame({
                "g": np.concatenate([o[0] for o in out]) if out else np.zeros(0, dtype=np.int64),
                "id": np.concatenate([o[1] for o in out]) if out else np.zeros(0, dtype=np.int64),
                "ask": np.concatenate([o[2] for o in out]) if out else np.zeros(0, dtype=bool),
            })

    return groups.select("members").mapInPandas(run, "g long, id long, ask boolean").distinct()


def _links_of(rows: list[tuple], percent: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the true links of one group (id, n, sketch, part, ask, members)."""
    ids, sizes, part = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 3))
    asks = np.array([r[4] for r in rows], dtype=bool)
    sketch = np.frombuffer(b"".join(bytes(r[2]) for r in rows), dtype=np.uint8).reshape(-1, COORDS)
    sets = [np.frombuffer(bytes(r[5]), dtype=np.uint64) for r in rows]
    i, j, agree = _candidates(ids, sizes, part, asks, sketch, similarity)
    above = {int(p): int(p) for p in part}

    def root(v: int) -> int:
        while above[v] != v:
            above[v] = v = above[above[v]]
        return v

    found = []
    for at in np.argsort(-agree, kind="stable").tolist():
        x, y = int(i[at]), int(j[at])
        a, b = root(int(part[x])), root(int(part[y]))
        if a == b:
            continue
        small, big = sorted((sets[x], sets[y]), key=len)
        spots = np.searchsorted(big, small)
        shared = int((big[np.minimum(spots, len(big) - 1)] == small).sum())
        if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
            above[max(a, b)] = min(a, b)
            found.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
    return found


def _confirm_groups(promising: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside bounded groups, confirmed on full sets; groups stream by their key."""
    full = promising.join(nodes.select("id", "n", "sketch", "part"), "id").join(sets.select("id", "members"), "id")

    def run(batches):
        held: list[tuple] = []
        current, similarity = None, percent / 100
        for batch in batches:
            out = []
            for g, *row in batch[["g", "id", "n", "sketch", "part", "ask", "members"]].itertuples(index=False):
                if g != current:
                    if len(held) > 1:
                        out += _links_of(held, percent, similarity)
                    held, current = [], g
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if len(held) > 1:
            yield pd.DataFrame(_links_of(held, percent, similarity), columns=["a", "b"], dtype=np.int64)

    return full.repartition("g").sortWithinPartitions("g").mapInPandas(run, "a long, b long").distinct()


def _with_sketch(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select("id", "n", "sketch", "part"), "id")


def _members(*extra: Column) -> Column:
    return F.collect_list(F.struct("id", "n", "sketch", "part", *extra)).alias("members")


def _small(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of each small node (key, id) as one group of bounded size."""
    return _with_sketch(rows, nodes).groupBy(F.col("key").alias("g")).agg(_members(F.lit(True).alias("ask")))


def _against(rows: DataFrame, pivots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (key, id) with their agreement to the pivot (key, pivot) of their node."""
    own = nodes.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("sketch").alias("psketch"))
    joined = rows.join(nodes.select("id", "n", "sketch"), "id").join(pivots.join(own, "pivot"), "key")
    same = F.lit(0)
    for at in range(0, COORDS, 8):
        same = same + _same_bytes(F.substring("sketch", at + 1, 8), F.substring("psketch", at + 1, 8))
    return joined.select("key", "id", "n", "pivot", "pn", (same / F.lit(COORDS)).alias("agree"))


def _pivoted(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of large nodes against two pivots: one by hash, and the member most like it.

    Copies of one text are nearer to that text than to each other, so the second pivot lies
    nearer to the middle of a group.
    """
    first = rows.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("pivot"))
    met = spool(_against(rows, first, nodes))
    nearest = met.groupBy("key").agg(
        F.max_by("id", F.struct(F.when(F.col("id") != F.col("pivot"), F.col("agree")), "id")).alias("pivot")
    )
    return met, spool(_against(rows, nearest, nodes))


def _same_bytes(left: Column, right: Column) -> Column:
    """How many of eight bytes are equal: zero bytes of the difference."""
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("long")
    diff = number(left).bitwiseXOR(number(right))
    total = F.lit(0)
    for byte in range(8):
        total = total + (F.shiftrightunsigned(diff, 8 * byte).bitwiseAND(F.lit(255)) == 0).cast("int")
    return total


def _merged(dense: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dense nodes whose pivots lie in one component as one node (key, id, pivot, agree).

    Every tree meets a dense group again, in a node of its own with much the same members; the
    union of those nodes holds all their pairs and is dealt into tiles once. Its pivot is the
    one that most rows name, and distances are measured from that one.
    """
    homes = nodes.select(F.col("id").alias("pivot"), F.col("part").alias("home")).dropDuplicates(["pivot"])
    homed = spool(dense.join(homes, "pivot").select(F.col("home").alias("key"), "id", "pivot"))
    named = homed.groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("rows"))
    pivots = named.groupBy("key").agg(F.max_by("pivot", F.struct("rows", "pivot")).alias("pivot"))
    return spool(_against(homed.select("key", "id").distinct(), pivots, nodes).select("key", "id", "pivot", "agree"))


def _tiles(dense: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of dense nodes outside their pivot's component against the node, in tiles.

    ``dense`` has key, id, pivot and agree. Places in which sketches differ are a distance, so two
    members whose distances to the pivot are further apart than ``_REACH`` are no candidates: a
    member meets only the bands of distance within its reach. The asking members of a band are
    dealt into rows of tiles by hash, those they meet into columns; each tile is a group of
    bounded size, so no task holds a node.
    """
    parts = nodes.select("id", "part").dropDuplicates(["id"])
    of_pivot = parts.select(F.col("id").alias("pivot"), F.col("part").alias("home"))
    band = F.floor((COORDS - F.round(F.col("agree") * COORDS)) / _BAND)
    rows = spool(dense.join(parts, "id").join(of_pivot, "pivot").select(
        "key", "id", (F.col("part") != F.col("home")).alias("asks"), band.alias("band")
    ))
    counts = rows.groupBy("key", "band").agg(
        F.sum(F.col("asks").cast("long")).alias("askers"), F.count(F.lit(1)).alias("size")
    )
    askers = counts.filter("askers > 0").select("key", F.col("band").alias("own"), "askers")
    meets = F.abs(F.col("band") - F.col("own")) <= -(-_REACH // _BAND)
    sizes = spool(askers.join(counts.select("key", "band", "size"), "key").filter(meets).groupBy("key", "own").agg(
        F.ceil(F.max("askers") / _TILE).alias("rows"), F.ceil(F.sum("size") / _TILE).alias("cols")
    ))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = rows.filter("asks").withColumnRenamed("band", "own").join(sizes, ["key", "own"]).select(
        "key", "own", "id", F.lit(True).alias("ask"), spot("rows").alias("row"), upto("cols").alias("col")
    )
    asked = rows.join(sizes, "key").filter(meets).select(
        "key", "own", "id", F.lit(False).alias("ask"), spot("cols").alias("col"), upto("rows").alias("row")
    ).select("key", "own", "id", "ask", "row", "col")
    tiles = _with_sketch(asking.union(asked), nodes)
    return tiles.groupBy(F.xxhash64("key", "own", "row", "col").alias("g")).agg(_members("ask"))


def _branched(rows: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """Members (key, id) sent down the branches of their node."""
    return rows.join(nodes.select("id", "sig"), "id").select(
        F.explode(F.array_distinct(_child_keys(F.col("key"), F.col("sig"), trees))).alias("key"), "id"
    )


def tree_nodes(
    nodes: DataFrame, similarity: float, recall: float, node_limit: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walk the trees: small nodes (key, id), dense nodes (key, id, pivot, agree), pivot pairs (a, b)."""
    trees = trees_for(recall, similarity)
    small: list[DataFrame] = []
    dense: list[DataFrame] = []
    pairs: list[DataFrame] = []
    rows = nodes.select(F.explode(_child_keys(None, F.col("sig"), trees)).alias("key"), "id")
    for depth in range(DEPTH + 1):
        rows = spool(rows)
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = spool(rows.join(counts, "key"))
        small.append(sized.filter(F.col("size") <= node_limit).select("key", "id"))
        large = sized.filter(F.col("size") > node_limit).select("key", "id")
        if large.isEmpty():
            break
        if depth == 0:
            # the first nodes are common shingles' nodes for the most part: branch them all
            rows = _branched(large, nodes, trees)
            continue
        outer, met = _pivoted(large, nodes)
        pairs.append(outer.union(met).filter(
            (F.col("agree") >= ASK) & (F.col("id") != F.col("pivot"))
            & (F.least("n", "pn") >= similarity * F.greatest("n", "pn"))
        ).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))
        stuck = met.groupBy("key").agg(
            F.avg((F.col("agree") >= DENSE_AGREE).cast("int")).alias("share")
        ).filter((F.col("share") >= DENSE_SHARE) | F.lit(depth == DEPTH)).select("key")
        marked = spool(met.select("key", "id", "pivot", "agree").join(stuck.withColumn("stuck", F.lit(True)), "key", "left"))
        dense.append(marked.filter("stuck").select("key", "id", "pivot", "agree"))
        rows = _branched(marked.filter("stuck is null"), nodes, trees)
    none = nodes.select(
        F.lit(0).cast("long").alias("key"), "id", F.col("id").alias("pivot"), F.lit(0.0).alias("agree")
    ).limit(0)
    merged = lambda parts, default: reduce(DataFrame.union, parts) if parts else default
    return (
        merged(small, none.select("key", "id")), merged(dense, none),
        merged(pairs, none.select(F.col("id").alias("a"), F.col("pivot").alias("b"))),
    )


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and text of the documents named in ``wanted``.

    Few are, so their ids are broadcast in parts of bounded size and the texts scanned where they
    are; beyond ``_SCANS`` scans a shuffle of the texts costs less.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    names = spool(wanted.select("id").distinct())
    scans = max(1, math.ceil(names.count() / _IDS_AT_ONCE))
    if scans > _SCANS:
        return texts.join(names, "id", "left_semi")
    part = F.pmod(F.xxhash64("id"), F.lit(scans))
    return reduce(DataFrame.union, [
        texts.join(F.broadcast(names.filter(part == at)), "id", "left_semi") for at in range(scans)
    ])


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, fp and members (sorted 64-bit hashes, packed) of the documents named in ``wanted``."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            sets = [shingle_set(hasher(t or ""), words) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"],
                "fp": [_fingerprint(s) if len(s) else None for s in sets],
                "members": [s.tobytes() for s in sets],
            })

    made = _texts_of(docs, wanted).mapInPandas(run, "id long, fp binary, members binary")
    return made.filter("fp is not null").dropDuplicates(["id", "fp"])


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    recall: float = 0.9999,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. A document is the
    set of its distinct shingles of ``words`` words (bytes A-Z lower-cased, split at space and
    \\x09-\\x0D); shorter texts are one shingle. Null, empty and blank texts have the empty set
    and link with nothing. Documents with equal sets always link. Others link if the shared
    shingles are at least ``percent`` of the union, confirmed on the full sets. component_id is
    the smallest doc_id reachable, ``kept`` marks the document that bears it. Rows with a null
    doc_id can't be named by a link: component_id is null and they are kept. Rows that repeat a
    doc_id are one vertex and each returned. An empty table gives no rows.
    """
    similarity = percent / 100
    sets = spool(signatures(docs, words))
    vertex = F.col("doc_id").isNotNull() & F.col("fp").isNotNull()
    firsts = spool(
        sets.filter(vertex).groupBy("fp").agg(F.min("doc_id").alias("id"))
    )
    nodes = spool(
        sets.filter(vertex).join(
            firsts, (sets["doc_id"] == firsts["id"]) & (sets["fp"] == firsts["fp"]), "left_semi"
        ).select(F.col("doc_id").alias("id"), "n", "sig", "sketch").dropDuplicates(["id", "sig"])
    )
    own = nodes.withColumn("part", F.col("id"))
    small, dense, pivots = tree_nodes(own, similarity, recall, node_limit)
    # pivot pairs: each is a group of two, the node's pivot asks
    paired = pivots.distinct().select(F.xxhash64("a", "b").alias("g"), "a", "b")
    starred = paired.select("g", F.col("a").alias("id")).union(paired.select("g", F.col("b").alias("id")))
    starred = spool(starred.withColumn("ask", F.lit(True)))
    sets_of = spool(full_sets(docs, starred, words))
    links = spool(_confirm_groups(starred, own, sets_of, percent).union(_repeats(sets.filter(vertex), firsts)))
    parted = spool(own.drop("part").join(
        components(links).withColumnRenamed("v", "id"), "id", "left"
    ).select("id", "n", "sketch", F.coalesce("component", "id").alias("part")))
    groups = _small(small, parted).union(_tiles(_merged(dense, parted), parted))
    promising = spool(_promising(groups, similarity))
    more = full_sets(docs, promising.select("id").distinct().join(sets_of.select("id"), "id", "left_anti"), words)
    found = _confirm_groups(promising, parted, spool(sets_of.union(more)), percent)
    grouped = components(links.union(found))
    named = firsts.join(grouped, firsts["id"] == grouped["v"], "left").select(
        "fp", F.coalesce("component", "id").alias("first")
    )
    wide = sets.select("doc_id", "n", "fp").join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return wide.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _repeats(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links between the sets of a doc_id that occurs with several texts."""
    several = sets.groupBy("doc_id").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high")
    ).filter("low <> high").select("doc_id")
    own = sets.select("doc_id", "fp").join(several, "doc_id", "left_semi").join(firsts, "fp")
    return own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
