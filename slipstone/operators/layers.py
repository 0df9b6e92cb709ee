"""The three duplicate layers: content hash, exact key, scored candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScoringConfig
from ..functions import similarity as sim
from ..functions.amounts import amount_similarity
from ..functions.dates import date_similarity
from ..session import spool, spool_alone
from .keyed import attach_first, lookup
from .textpairs import named_in, text_pair_similarity

ORDER = ["fecha_registro", "id_comprobante"]
TRIO = ["referencia", "monto", "fecha_deposito"]
_SLACK = 1e-9
#: a voucher with more candidates of other texts in its window is bounded by text sketches
CROWDED = 4
#: a scope of at most so many rows, queries and candidates together, is one block whatever its dates
SMALL_SCOPE = 64
#: the digest of a survivor's text, where layer 1 has taken it
TEXT_KEY = "__text_key"

# text keys -> (text_key, text)
TextLookup = Callable[[DataFrame], DataFrame]


def layer1(new: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split ``new`` into survivors and rejected rows by document hash.

    A row is rejected when its hash is already stored, or belongs to an earlier new row
    (by registration time, then id). Rejected rows name the voucher that holds the hash. Rows
    without a hash can't be told apart by it and are rejected for that reason (``sin_hash``).
    Survivors with a text also carry its digest, in a column for the scored layer.
    """
    own = F.struct(*ORDER)
    if "texto_extraido" in new.columns:
        # taken before any row moves, so that later steps need not carry the text itself
        new = new.withColumn(TEXT_KEY, text_key("texto_extraido"))
    unhashed = new.filter("hash_documento is null").select(
        "id_comprobante", "hash_documento",
        F.lit(None).cast(new.schema["id_comprobante"].dataType).alias("id_existente"),
        F.lit("sin_hash").alias("metodo_deteccion"),
    )
    new = new.filter("hash_documento is not null")
    firsts = new.groupBy("hash_documento").agg(
        F.min(own)["id_comprobante"].alias("id_existente"), F.count(F.lit(1)).alias("n")
    )
    if store is None:
        clashes = firsts.filter("n > 1")
    else:
        held = store.groupBy("hash_documento").agg(F.min("id_comprobante").alias("id_guardado"))
        clashes = (
            firsts.join(held, "hash_documento", "left")
            .filter("n > 1 or id_guardado is not null")
            .withColumn("id_existente", F.coalesce("id_guardado", "id_existente"))
        )
    # stored once: every later use of the survivors joins this short list, not all hashes again
    clashes = spool(clashes)
    tagged = lookup(new, clashes, ["hash_documento"], ["id_existente"])
    first_or_alone = F.col("id_existente").isNull() | (
        F.col("id_existente") == F.col("id_comprobante")
    )
    survivors = tagged.filter(first_or_alone).drop("id_existente")
    rejected = tagged.filter(~first_or_alone).select(
        "id_comprobante",
        "hash_documento",
        "id_existente",
        F.lit("hash_exacto").alias("metodo_deteccion"),
    )
    return survivors, rejected.unionByName(unhashed)


def layer2(
    v: DataFrame, *, store: DataFrame | None = None, scope: str | None = None
) -> DataFrame:
    """Rows whose (reference, amount, date) equals that of an earlier live row.

    Any missing part means no match. With ``store``, stored live rows are earlier than all of
    ``v``. Returns ``id_comprobante, id_comprobante_original``.
    """
    keys = TRIO + ([scope] if scope else [])
    narrow = keys + ORDER + ["deleted_at"]
    rows = v.select(*narrow, F.lit(1).alias("batch"))
    if store is not None:
        rows = rows.unionByName(store.select(*narrow, F.lit(0).alias("batch")))
    complete = rows.dropna(subset=TRIO)
    stamped = attach_first(
        complete, keys, ["batch"] + ORDER, "first", where=F.col("deleted_at").isNull()
    )
    earlier = F.col("first") < F.struct("batch", *ORDER)
    return stamped.filter((F.col("batch") == 1) & earlier).select(
        "id_comprobante", F.col("first.id_comprobante").alias("id_comprobante_original")
    )


# --- layer 3 ---------------------------------------------------------------------------------

_PROFILE = ["scope", "referencia", "monto", "fecha_deposito", "text_key"]


def text_key(text) -> Column:
    """Digest naming a text; null when it has no terms (its similarity is then always 0)."""
    value = F.col(text) if isinstance(text, str) else text
    return F.when(value.rlike(sim.TERM_PATTERN), F.unhex(F.sha2(value, 256)))


def scoring_rows(v: DataFrame, cfg: ScoringConfig, batch: int, queries: Column) -> DataFrame:
    """The narrow columns scoring needs; the text itself is replaced by its digest."""
    digest = F.col(TEXT_KEY) if TEXT_KEY in v.columns else text_key("texto_extraido")
    return v.select(
        "id_comprobante",
        F.struct(F.lit(batch).alias("batch"), *ORDER).alias("ord"),
        F.col(cfg.scope).alias("scope"),
        F.nullif("referencia", F.lit("")).alias("referencia"),
        F.col("monto").cast("double").alias("monto"),
        "fecha_deposito",
        digest.alias("text_key"),
        F.col("deleted_at").isNull().alias("live"),
        queries.alias("wanted"),
    )


def _buckets(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(width)).cast("int")


#: the date bucket of rows whose scope is one block
_WHOLE = -(2**31)


def _tiled(
    queries: DataFrame, candidates: DataFrame, width: int, tile_rows: int
) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, list[str]]:
    """What gives queries their blocks of the band join, the candidates in theirs, and the names of
    the block columns.

    A block is (scope, date bucket). A query goes to its own and both adjacent buckets; a scope of
    few rows is a single block, so that its queries move once instead of three times. Blocks
    larger than a tile are cut on both sides into a grid, so no task holds more than about one
    tile of each, whatever the size of the table. Ids are left to the ``ord`` columns, see ``_met``.
    """
    both = queries.select(F.col("q_scope").alias("scope")).unionAll(candidates.select(F.col("c_scope").alias("scope")))
    wide = spool(
        both.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min(SMALL_SCOPE, tile_rows)).select("scope")
    )

    def marked(rows: DataFrame, scope: str) -> DataFrame:
        return lookup(rows.withColumnRenamed(scope, "scope"), wide.withColumn("wide", F.lit(True)), ["scope"], ["wide"])

    def reaching(rows: DataFrame) -> DataFrame:
        near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: k + _buckets(F.col("q_day"), width))
        return marked(rows, "q_scope").withColumn(
            "bucket", F.explode(F.when(F.col("wide"), near).otherwise(F.array(F.lit(_WHOLE))))
        ).drop("wide")

    right = marked(candidates, "c_scope").withColumn(
        "bucket", F.when(F.col("wide"), _buckets(F.col("c_day"), width)).otherwise(F.lit(_WHOLE))
    ).drop("wide")
    sizes = (
        reaching(queries).select("scope", "bucket", F.lit(1).alias("q"), F.lit(0).alias("c"))
        .unionByName(right.select("scope", "bucket", F.lit(0).alias("q"), F.lit(1).alias("c")))
        .filter(F.col("bucket") != F.lit(_WHOLE))
        .groupBy("scope", "bucket")
        .agg(F.sum("q").alias("nq"), F.sum("c").alias("nc"))
        .filter("nq > 0 and nc > 0")
    )
    big = spool(
        sizes.filter(F.greatest("nq", "nc") > tile_rows).select(
            "scope",
            "bucket",
            F.ceil(F.col("nq") / F.lit(tile_rows)).cast("int").alias("cut_q"),
            F.ceil(F.col("nc") / F.lit(tile_rows)).cast("int").alias("cut_c"),
        )
    )

    def place(df: DataFrame, own: str, own_cut: str, other: str, other_cut: str, key: str):
        cut = df.join(big, ["scope", "bucket"], "left")
        return (
            cut.withColumn(
                own,
                F.pmod(F.xxhash64(key), F.coalesce(own_cut, F.lit(1)).cast("bigint")).cast("int"),
            )
            .withColumn(
                other,
                F.explode(
                    F.sequence(F.lit(0), F.coalesce(other_cut, F.lit(1)) - F.lit(1))
                ),
            )
            .drop("cut_q", "cut_c", key)
        )

    return (
        lambda rows: place(reaching(rows), "tile_q", "cut_q", "tile_c", "cut_c", "q_id"),
        place(right, "tile_c", "cut_c", "tile_q", "cut_q", "c_id"),
        ["scope", "bucket", "tile_q", "tile_c"],
    )


def _met(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """The pairs of every block, with the ids of both sides."""
    return left.join(right, block).withColumns(
        {"q_id": F.col("q_ord.id_comprobante"), "c_id": F.col("c_ord.id_comprobante")}
    )


def _as_queries(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id_comprobante").alias("q_id"),
        F.col("ord").alias("q_ord"),
        F.col("scope").alias("q_scope"),
        F.col("referencia").alias("q_ref"),
        F.col("monto").alias("q_monto"),
        F.col("fecha_deposito").alias("q_day"),
        F.col("text_key").alias("q_text"),
    )


def _as_candidates(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("first.id_comprobante").alias("c_id"),
        F.col("first").alias("c_ord"),
        F.col("scope").alias("c_scope"),
        F.col("referencia").alias("c_ref"),
        F.col("monto").alias("c_monto"),
        F.col("fecha_deposito").alias("c_day"),
        F.col("text_key").alias("c_text"),
    )


def _in_window(width: int) -> Column:
    return (F.abs(F.datediff("q_day", "c_day")) <= width) & (F.col("c_ord") < F.col("q_ord"))


def candidate_counts(v: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Per voucher: how many earlier live vouchers of its scope lie within the date window."""
    rows = scoring_rows(v, cfg, 1, F.lit(True)).dropna(subset=["scope", "fecha_deposito"])
    own = rows.filter("live").withColumn("first", F.col("ord"))
    asked = _as_queries(rows)
    placed, right, block = _tiled(asked, _as_candidates(own), cfg.window_days, cfg.tile_rows)
    return (
        _met(placed(asked), right, block)
        .filter(_in_window(cfg.window_days))
        .groupBy(F.col("q_id").alias("id_comprobante"))
        .agg(F.count(F.lit(1)).alias("candidatos"), F.min("c_day").alias("desde"),
             F.max("c_day").alias("hasta"))
    )


def best_matches(rows: DataFrame, text_of: TextLookup, cfg: ScoringConfig) -> DataFrame:
    """Best earlier candidate for every wanted row of ``rows`` (see ``scoring_rows``).

    Exact, without writing out all pairs of a block:

    1. equal profiles (scope, reference, amount, date, text) collapse to their first live row;
       a later row of the same profile can only be beaten to it by a row that ties with it;
    2. a first pass over the band join keeps two things per voucher: the best score that cheap
       bounds already guarantee and the candidate of the highest bound, which is then scored in
       full; the better of both is the floor. Edit distance bounds the reference measure. A
       voucher with many candidates of other texts passes again with sketches of fixed width
       (norms of the terms by hash bucket), which bound the text measure; only these vouchers and
       the blocks they meet carry sketches;
    3. a second pass measures the reference exactly where the bound reaches the floor and writes
       only pairs that still reach it with the bound of the text, a few to a voucher;
    4. the text measure runs on those alone.

    Returns ``id_comprobante, id_comprobante_original, raw_score`` for every wanted row, nulls
    where no earlier candidate scores above 0. ``rows`` should be a stored table.
    """
    profiles = spool(
        rows.dropna(subset=["scope", "fecha_deposito"])
        .groupBy(*_PROFILE)
        .agg(
            F.min(F.when(F.col("live"), F.col("ord"))).alias("first"),
            F.max("wanted").alias("wanted"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    pool = _as_candidates(profiles.filter("first is not null"))
    # stored, so that its size is known: where it is small the rows need not be shuffled to meet it
    repeated = spool(profiles.filter("n > 1"))
    own = F.when(F.col("live") & F.col("fecha_deposito").isNotNull(), F.col("ord"))
    stamped = (
        lookup(rows.filter("wanted"), repeated, _PROFILE, ["first"])
        .withColumn("first", F.coalesce("first", own))
        .withColumn("tail", F.coalesce(F.col("first") < F.col("ord"), F.lit(False)))
    )
    heads = stamped.filter("not tail and fecha_deposito is not null and scope is not null")
    # firsts of profiles that have later rows are scored too, wanted or not
    leaders = repeated.filter("wanted and first is not null").select(
        F.col("first.id_comprobante").alias("id_comprobante"), F.col("first").alias("ord"), *_PROFILE
    )
    asked = _as_queries(
        heads.select("id_comprobante", "ord", *_PROFILE)
        .unionByName(leaders)
        # dealt first, so that plain rows move and not aggregates of every column
        .repartition("id_comprobante")
        .dropDuplicates(["id_comprobante"])
    )
    best = _best_of_heads(spool(asked), pool, text_of, cfg)
    answered = stamped.join(
        best.select(
            F.col("q_id").alias("id_comprobante"), "raw_score", "id_comprobante_original"
        ),
        "id_comprobante",
        "left",
    )
    # a tail's best score is its profile's own maximum, held by its leader or an earlier tie
    def has(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))

    full = sim.weighted_score(has("referencia"), has("text_key"), has("monto"), F.lit(1.0), cfg)
    tied = F.col("raw_score") >= F.col("full")
    led = spool(
        repeated.filter("wanted and first is not null")
        .select(*_PROFILE, "n", F.col("first.id_comprobante").alias("leader"), full.alias("full"))
        .join(best, F.col("leader") == F.col("q_id"), "left")
        .select(
            *_PROFILE,
            "n",
            F.col("full").alias("led_score"),
            F.when(tied, F.col("id_comprobante_original"))
            .otherwise(F.col("leader"))
            .alias("led_original"),
        )
    )
    positive = F.col("tail") & (F.col("led_score") > 0)
    return lookup(answered, led, _PROFILE, ["led_score", "led_original"]).select(
        "id_comprobante",
        F.when(positive, F.col("led_original"))
        .when(~F.col("tail"), F.col("id_comprobante_original"))
        .alias("id_comprobante_original"),
        F.when(positive, F.col("led_score"))
        .when(~F.col("tail"), F.col("raw_score"))
        .alias("raw_score"),
    )


def _with_sketches(
    asked: DataFrame, pool: DataFrame, text_of: TextLookup, cfg: ScoringConfig
) -> tuple[DataFrame, DataFrame]:
    """``asked`` and the candidates in the blocks it meets, with the sketches of their texts."""
    width = cfg.window_days
    asked = spool(asked)
    met = asked.select(
        F.col("q_scope").alias("c_scope"),
        F.explode(F.array(*[_buckets(F.col("q_day"), width) + F.lit(k) for k in (-1, 0, 1)])).alias("bucket"),
    ).distinct()
    near = spool(
        pool.withColumn("bucket", _buckets(F.col("c_day"), width)).join(met, ["c_scope", "bucket"], "left_semi")
        .select(*pool.columns)
    )
    keys = spool(
        asked.select(F.col("q_text").alias("text_key")).union(near.select("c_text")).filter("text_key is not null")
        .distinct()
    )
    sketches = spool(text_of(keys).select("text_key", sim.text_sketch(F.coalesce("text", F.lit(""))).alias("sketch")))

    def attached(rows: DataFrame, key: str, into: str) -> DataFrame:
        return spool(lookup(rows, sketches.select(F.col("text_key").alias(key), F.col("sketch").alias(into)), [key], [into]))

    return attached(asked, "q_text", "q_sketch"), attached(near, "c_text", "c_sketch")


def _best_of_heads(
    asked: DataFrame, pool: DataFrame, text_of: TextLookup, cfg: ScoringConfig
) -> DataFrame:
    """``q_id, raw_score, id_comprobante_original`` of the best earlier profile, stored."""
    width = cfg.window_days
    placed, facing, block = _tiled(asked, pool, width, cfg.tile_rows)

    same_text = F.coalesce(F.col("q_text") == F.col("c_text"), F.lit(False))
    open_text = F.col("q_text").isNotNull() & F.col("c_text").isNotNull() & ~same_text
    known_text = F.when(same_text, F.lit(1.0)).otherwise(F.lit(0.0))
    # without the sketches: what a pair could reach if its open texts were equal
    any_text = F.when(same_text | open_text, F.lit(1.0)).otherwise(F.lit(0.0))
    sketched = (
        F.when(same_text, F.lit(1.0)).when(open_text, sim.cosine_bound("q_sketch", "c_sketch")).otherwise(F.lit(0.0))
    )
    s_monto = amount_similarity("q_monto", "c_monto")
    s_fecha = date_similarity("q_day", "c_day", width)
    if cfg.similarity == "indel":
        low_ref, top_ref = sim.reference_bounds("q_ref", "c_ref")
        measure = sim.indel_ratio
    else:
        has = F.col("q_ref").isNotNull() & F.col("c_ref").isNotNull()
        low_ref = F.when(F.col("q_ref") == F.col("c_ref"), F.lit(1.0)).otherwise(F.lit(0.0))
        top_ref = F.when(has, F.lit(1.0)).otherwise(F.lit(0.0))
        measure = sim.sequence_ratio

    in_window = _in_window(width)
    rough = sim.weighted_score(top_ref, any_text, s_monto, s_fecha, cfg)

    def floors(pairs: DataFrame, top_text: Column) -> DataFrame:
        """Per voucher: its sure score, the candidate of the highest ceiling, its open texts; stored."""
        bounded = pairs.filter(in_window).select(
            "q_id", "c_id", sim.weighted_score(top_ref, top_text, s_monto, s_fecha, cfg).alias("ceiling"),
            sim.weighted_score(low_ref, known_text, s_monto, s_fecha, cfg).alias("sure"),
            open_text.cast("long").alias("open"),
        )
        return spool(bounded.groupBy("q_id").agg(
            # by a number, so that the pass stays a hash aggregate whatever the type of the ids
            F.max("sure").alias("sure"), F.max_by(F.xxhash64("c_id"), "ceiling").alias("lead"),
            F.sum("open").alias("open"),
        ))

    def measured(pairs: DataFrame, top_text: Column, *carry: str) -> DataFrame:
        """The parts of the score that need no text, and the pair of texts where it is open."""
        return pairs.withColumn("s_ref", measure("q_ref", "c_ref")).select(
            *carry, "q_id", "c_id", "c_ord", "s_ref", s_monto.alias("s_monto"), s_fecha.alias("s_fecha"),
            F.when(same_text, F.lit(1.0)).when(~open_text, F.lit(0.0)).alias("s_text"),
            top_text.alias("top_text"),
            F.when(open_text, F.least("q_text", "c_text")).alias("key_a"),
            F.when(open_text, F.greatest("q_text", "c_text")).alias("key_b"),
        )

    known: list[tuple[DataFrame, DataFrame]] = []

    def with_cosine(scored: DataFrame) -> DataFrame:
        """``cosine`` for the pairs whose texts are open; each pair of texts is measured once."""
        pairs = scored.filter("key_a is not null").select("key_a", "key_b").distinct()
        for seen, _ in known:
            pairs = pairs.join(seen, ["key_a", "key_b"], "left_anti")
        pairs = spool(pairs)
        known.append((pairs, spool_alone(lambda: text_pair_similarity(pairs, text_of(named_in(pairs))))))
        found = reduce(DataFrame.unionByName, [f for _, f in known])
        return lookup(
            scored, found.withColumnRenamed("s_text", "cosine"), ["key_a", "key_b"], ["cosine"]
        )

    def total(text: Column) -> Column:
        return sim.weighted_score("s_ref", text, "s_monto", "s_fecha", cfg)

    floor = floors(_met(placed(asked), facing, block), any_text)
    crowded = spool(floor.filter(F.col("open") > CROWDED).select("q_id"))
    passes = [(asked.join(crowded, "q_id", "left_anti"), placed, facing, block, any_text)]
    if not crowded.isEmpty():
        many = _with_sketches(asked.join(crowded, "q_id", "left_semi"), pool, text_of, cfg)
        passes.append((many[0], *_tiled(*many, width, cfg.tile_rows), sketched))
        floor = floor.join(crowded, "q_id", "left_anti").unionByName(
            floors(_met(passes[1][1](many[0]), *passes[1][2:4]), sketched)
        )
    # the candidate of the highest ceiling is scored in full, which lifts the floor of the rest
    leading = spool(measured(
        floor.select("q_id", "lead").join(asked, "q_id")
        # the number is no id: another scope's voucher may share it
        .join(pool.withColumn("lead", F.xxhash64("c_id")), "lead")
        .filter(in_window & (F.col("q_scope") == F.col("c_scope"))),
        any_text,
    ).drop("top_text"))
    exact = with_cosine(leading).groupBy("q_id").agg(
        F.max(total(F.coalesce("s_text", "cosine", F.lit(0.0)))).alias("exact")
    )
    floor = spool(floor.join(exact, "q_id").select("q_id", F.greatest("sure", "exact").alias("floor")))
    reached = F.col("floor") - _SLACK

    def finalists_of(
        rows: DataFrame, placed: Callable[[DataFrame], DataFrame], right: DataFrame, on: list[str], top_text: Column
    ) -> DataFrame:
        """The pairs whose exact reference and text bound still reach the floor."""
        ceiling = sim.weighted_score(top_ref, top_text, s_monto, s_fecha, cfg)
        contenders = _met(placed(rows.join(floor, "q_id")), right, on).filter(
            # the ceiling is costly and named once: above a positive floor it is positive itself
            in_window & (rough >= reached) & F.when(reached > 0, ceiling >= reached).otherwise(ceiling > 0)
        )
        return measured(contenders, top_text, "floor").filter(total(F.col("top_text")) >= reached).drop(
            "floor", "top_text"
        )

    # only these pairs are written
    finalists = spool(reduce(DataFrame.unionByName, [finalists_of(*p) for p in passes]))
    top = F.min(F.struct((-F.col("score")).alias("neg"), "c_ord")).alias("top")
    return spool(
        with_cosine(finalists)
        .withColumn("score", total(F.coalesce("s_text", "cosine", F.lit(0.0))))
        .filter("score > 0")
        .groupBy("q_id")
        .agg(top)
        .select(
            "q_id",
            (-F.col("top.neg")).alias("raw_score"),
            F.col("top.c_ord.id_comprobante").alias("id_comprobante_original"),
        )
    )


def layer3(
    v: DataFrame,
    cfg: ScoringConfig = ScoringConfig(),
    *,
    store: DataFrame | None = None,
    settled: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Score every row of ``v`` against earlier live rows of its scope.

    ``settled(id_comprobante)`` rows are candidates only (layer 2 has decided them). With
    ``store``, stored rows are candidates and earlier than all of ``v``. Rows without a
    candidate come back as ``valido`` with score 0. ``texts`` is a table that holds the texts of ``v``
    by voucher and is cheaper to read than ``v``, such as the uploads that ``v`` was joined from.
    Returns ``id_comprobante, id_comprobante_original, score_similitud, clasificacion``.
    """
    if store is None:
        return layer3_against(v, cfg, settled=settled, texts=texts)
    rows = spool(scoring_rows(store, cfg, 0, F.lit(False)))
    return layer3_against(
        v, cfg, settled=settled, texts=texts, earlier=rows, earlier_texts=lambda keys: held_texts(store, rows, keys)
    )


def held_texts(wide: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``text_key, text`` of the texts that ``keys`` names, from vouchers and their scoring rows.

    ``wide`` may hold more vouchers than ``rows``.
    """
    # one voucher stands for each text; the list of holders is stored first, so the wide table is
    # filtered by a side of known size instead of being shuffled for it
    holders = (
        rows.join(keys, "text_key", "left_semi")
        .groupBy("text_key")
        .agg(F.min("id_comprobante").alias("id_comprobante"))
    )
    held = wide.select("id_comprobante", F.col("texto_extraido").alias("text")).join(spool(holders), "id_comprobante")
    # an id that comes twice may stand for another text as well
    return held.filter(text_key("text") == F.col("text_key")).select("text_key", "text")


def layer3_against(
    v: DataFrame,
    cfg: ScoringConfig = ScoringConfig(),
    *,
    settled: DataFrame | None = None,
    texts: DataFrame | None = None,
    earlier: DataFrame | None = None,
    earlier_texts: TextLookup | None = None,
) -> DataFrame:
    """``layer3`` against stored scoring rows, whose texts are looked up only where a pair needs
    them."""
    own = scoring_rows(v, cfg, 1, F.lit(True))
    if settled is not None:
        # narrow by now: no text takes part in the join
        done = settled.select("id_comprobante", F.lit(False).alias("__done"))
        own = own.join(done, "id_comprobante", "left").withColumn(
            "wanted", F.coalesce("__done", F.lit(True))
        ).drop("__done")
    own = spool(own)
    rows = own if earlier is None else spool(own.unionByName(earlier))

    def text_of(keys: DataFrame) -> DataFrame:
        found = held_texts(v if texts is None else texts, own, keys)
        if earlier_texts is None:
            return found
        found = spool(found)
        return found.unionByName(earlier_texts(keys.join(found, "text_key", "left_anti")))

    raw = F.coalesce("raw_score", F.lit(0.0))
    return best_matches(rows, text_of, cfg).select(
        "id_comprobante",
        "id_comprobante_original",
        sim.published(raw).alias("score_similitud"),
        sim.classify(raw, cfg).alias("clasificacion"),
    )
