"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares p are raised to an exponent: weights are proportional to p ** exponent. The
exponent is found by bisection, many candidates to a pass, as one combined aggregate over the
sources. The weights and the token budget give each source a quota; it is filled by whole
epochs of the source and a part of one more. In every epoch a keyed hash deals the documents into
blocks and a keyed hash of the block gives its place, so the stream is shuffled without a global
sort. The part of an epoch ends at one block and one key in it, which sums over the blocks and a
look at that block alone find; whether a document is used is then decided in its own row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spool

#: uses of a document that one array holds before it is exploded
_SPAN = 10_000
_PROBES = 16
_PASSES = 8
#: weights are rounded to this many decimals before quotas are taken from them
DECIMALS = 9


@dataclass(frozen=True)
class MixTarget:
    """Give ``entropy_share`` (of the highest possible entropy) or ``max_repeats``; with both, the
    limit on repeats comes first and the entropy may stay below its target.

    ``budget`` is the number of tokens of the mixture; None takes the smallest budget that
    holds every document at least once, so that nothing is lost.
    """

    entropy_share: float | None = None
    max_repeats: float | None = None
    budget: int | None = None
    seed: int = 7


def token_count(text: Column) -> Column:
    """White-space tokens of a whole text; null and blank texts have none."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def _measure(sources: DataFrame, exponents: list[float], target: MixTarget) -> DataFrame:
    """Per exponent (x): whether the weights still reach the target there."""
    powered = sources.filter("tokens > 0").select(
        "share", "tokens", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("x")
    ).withColumn("w", F.pow("share", "x"))
    sums = powered.groupBy("x").agg(
        F.sum("w").alias("z"),
        F.sum(F.col("w") * F.log("w")).alias("wlogw"),
        F.max(F.col("w") / F.col("share")).alias("most"),
        F.min(F.col("w") / F.col("share")).alias("least"),
        F.sum("tokens").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    if target.entropy_share is not None:
        entropy = F.log("z") - F.col("wlogw") / F.col("z")
        good = entropy >= target.entropy_share * F.log("n")
    else:
        # repeats of a source: weight * budget / tokens; without a budget, against the source
        # that is used once
        repeats = (
            F.col("most") / F.col("least") if target.budget is None
            else F.col("most") / F.col("z") * target.budget / F.col("total")
        )
        good = repeats > target.max_repeats
    return sums.select("x", good.alias("good"))


def exponent_for(sources: DataFrame, target: MixTarget) -> float:
    """The largest exponent in [0, 1] that reaches the entropy, or the smallest that keeps
    within the repeats; 0 or 1 where the target lies outside.

    Entropy falls and repeats rise as the exponent falls towards natural shares and even
    weights, so each pass keeps the one gap between its probes where the answer lies.
    """
    if target.entropy_share is None and target.max_repeats is None:
        raise ValueError("give entropy_share or max_repeats")
    if target.entropy_share is not None and target.max_repeats is not None:
        return max(
            exponent_for(sources, replace(target, max_repeats=None)),
            exponent_for(sources, replace(target, entropy_share=None)),
        )
    low, high = 0.0, 1.0
    for _ in range(_PASSES):
        probes = [low + (high - low) * i / _PROBES for i in range(_PROBES + 1)]
        row = _measure(sources, probes, target).agg(
            F.max(F.when(F.col("good"), F.col("x"))).alias("good"),
            F.min(F.when(~F.col("good"), F.col("x"))).alias("bad"),
        ).first()
        if row["good"] is None:  # not even the lowest exponent does
            return low
        if row["bad"] is None:
            return high
        low, high = row["good"], row["bad"]
    return low if target.entropy_share is not None else high


def weights(sized: DataFrame, target: MixTarget) -> DataFrame:
    """Per source: docs, tokens, share, weight, quota (tokens), epochs, rest (tokens of a part)."""
    sources = spool(sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")
    ))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shared = sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = exponent_for(shared, target)
    powered = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    raised = spool(shared.withColumn("raised", powered))
    whole = raised.agg(F.sum("raised")).first()[0] or 1.0
    weighted = raised.withColumn("weight", F.round(F.col("raised") / F.lit(whole), DECIMALS))
    if target.budget is None:
        need = weighted.filter("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0]
        budget = need or 0
    else:
        budget = target.budget
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    if target.budget is None:
        quota = F.greatest(quota, F.col("tokens"))
    filled = weighted.withColumn("quota", quota)
    epochs = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1 if target.budget is None else 0))
    rest = F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(F.lit(0))
    return filled.select(
        "source", "docs", "tokens", "share", "weight", "quota",
        epochs.cast("long").alias("epochs"), rest.cast("long").alias("rest"),
    )


def _order_key(seed: int, epoch: Column, doc: Column) -> Column:
    """Hex digest that deals and orders documents; the same text in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), doc.cast("string")))


def _block(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


def _places(frame: DataFrame, seed: int) -> DataFrame:
    """``key``, ``block`` and ``block_key`` (the block's place) of doc_id in ``epoch``."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    of_block = F.concat(F.lit(f"{seed}:block:"), F.col("epoch").cast("string"), F.lit(":"), F.col("block").cast("string"))
    return (
        frame.withColumn("key", _order_key(seed, F.col("epoch"), doc))
        .withColumn("block", _block(F.col("key")))
        .withColumn("block_key", F.md5(of_block))
    )


def _cuts(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per source with a part epoch: ``last_block`` (the last block_key used whole), ``cut_block``
    and ``cut_key`` (the block that crosses the rest of the quota and the last key used of it)."""
    open_part = plan.filter("rest > 0").select(F.col("source").alias("s"), (F.col("epochs") + 1).alias("epoch"), "rest")
    part = spool(_places(
        sized.join(open_part, F.col("source").eqNullSafe(F.col("s"))).drop("s"), seed
    ))
    # 256 blocks to a source, so this window holds few rows however hot the source is
    ahead = Window.partitionBy("source").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)
    blocks = part.groupBy("source", "block_key").agg(
        F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest")
    ).withColumn("before", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)))
    whole = F.col("before") + F.col("in_block") <= F.col("rest")
    ends = spool(blocks.groupBy("source").agg(
        F.max(F.when(whole, F.col("block_key"))).alias("last_block"),
        F.min(F.when(~whole, F.struct("block_key", "before"))).alias("crossing"),
    ).select(
        F.col("source").alias("s"), "last_block", F.col("crossing.block_key").alias("cut_block"),
        F.col("crossing.before").alias("before"),
    ))
    # the crossing block: running sums within 256 slots of it, offset by the slots before
    edge = part.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block_key") == F.col("cut_block"))).drop(
        "s", "last_block", "cut_block"
    ).withColumn("slot", F.conv(F.substring("key", 3, 2), 16, 10).cast("int"))
    slots = edge.groupBy("source", "slot").agg(F.sum("n_tokens").alias("in_slot"))
    slots = slots.select(
        F.col("source").alias("s"), F.col("slot").alias("t"),
        F.coalesce(F.sum("in_slot").over(
            Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("slots_before"),
    )
    # rows of one key share their fate: the sum up to a key holds all of its rows
    running = Window.partitionBy("source", "slot").orderBy("key")
    upto = F.sum("n_tokens").over(running) + F.col("before") + F.col("slots_before")
    keys = edge.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("t"))).withColumn(
        "upto", upto
    ).filter(F.col("upto") <= F.col("rest")).groupBy(F.col("source").alias("k")).agg(F.max("key").alias("cut_key"))
    return ends.join(keys, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "last_block", "cut_block", "cut_key")


def uses(docs: DataFrame, target: MixTarget, *carry: str) -> DataFrame:
    """``mixture`` with the columns named in ``carry`` as well.

    The plan has one narrow row per source. Spark broadcasts it where it is small by its stored
    size; the documents are then not shuffled at all. Otherwise it is an ordinary join.
    """
    sized = spool(docs.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    plan = spool(weights(sized, target))
    cuts = _cuts(sized, plan, target.seed)
    rules = spool(
        plan.select(F.col("source").alias("p"), "epochs", "rest")
        .join(cuts, F.col("p").eqNullSafe(F.col("s")), "left").drop("s")
    )
    own = ["doc_id", "source", "n_tokens", *carry]
    joined = docs.select(*own).join(rules, F.col("source").eqNullSafe(F.col("p")))
    at_cut = _places(joined.withColumn("epoch", F.col("epochs") + 1), target.seed)
    inside = (F.col("rest") > 0) & (
        (F.col("block_key") <= F.col("last_block"))
        | ((F.col("block_key") == F.col("cut_block")) & (F.col("key") <= F.col("cut_key")))
    )
    counted = at_cut.withColumn(
        "times", F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long")
    ).filter("times > 0").select(*own, "times")
    # in spans, since one array can't hold the repeats of a tiny source beside a huge one
    spans = counted.withColumn(
        "span", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {_SPAN}")))
    )
    rows = spans.withColumn("epoch", F.explode(F.sequence(
        F.col("span") * _SPAN + 1, F.least(F.col("times"), (F.col("span") + 1) * _SPAN)
    )))
    return _places(rows, target.seed).select(*own, "epoch", "block", "block_key", "key")


def mixture(docs: DataFrame, target: MixTarget) -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, epoch, block, block_key, key.

    ``docs`` has doc_id, source and n_tokens (long; null counts as 0). Sorting by (epoch,
    block_key, key) within a source is its training order. Every source gets its whole epochs,
    then the documents of one further epoch in that order while the running sum stays within the
    rest of its quota. A null source is a source of its own; sources without a token are used once
    if no budget is given and left out otherwise. Documents with a null or repeated doc_id share
    their place and are used equally often. An empty table gives no rows, further columns of
    ``docs`` are ignored.
    """
    return uses(docs, target)
