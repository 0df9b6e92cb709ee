"""SpotSigs fingerprints with built-in functions only.

A signature is the common words (anchors) in front of a content word, that word and the content
word after it. Content that repeats elsewhere keeps its signatures whatever surrounds it. The
set of a text's signatures is its fingerprint; two fingerprints compare by Jaccard. For joins
the sets are dealt into bands of set length, of which only neighbours can be similar, and meet
on their rarest signatures only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import ranked
from ..session import spool

#: fixed values: common words of English, German, French and Spanish that serve as anchors
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its of on or "
    "she that the their there they this to was were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer es für "
    "hat ich im ist mit nach nicht oder sich sie sind und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne "
    "nous ou par pas pour que qui sa se ses son sont sur un une vous "
    "al como con cual del el ella ellos era esta este fue ha las lo los más muy no o para pero "
    "por se ser si sin sobre su sus también un una y ya"
).split()
_MARK = "^"


def _content(text: Column) -> Column:
    """Content words of a text in order, each with the anchors in front of it attached."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.transform(
        words,
        lambda w: F.when(w.isin(sorted(set(ANCHORS))), F.concat(w, F.lit(_MARK))).otherwise(F.concat(w, F.lit(" "))),
    )
    # "the^of^cat sat on^mat " falls into content words with the anchors in front of them
    return F.split(F.array_join(marked, ""), " ")


def _chains(parts: Column) -> Column:
    """Sorted distinct hashes of each anchored content word with the content word after it."""
    pairs = F.zip_with(
        parts,
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda here, after: F.when(
            here.contains(_MARK) & ~here.endswith(_MARK) & after.isNotNull() & (after != "") & ~after.endswith(_MARK),
            F.hash(here, F.substring_index(after, _MARK, -1)),
        ),
    )
    return F.sort_array(F.array_distinct(F.array_compact(pairs)))


def with_signatures(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``, the sorted distinct 32-bit signature hashes of string column ``text``.

    Words are runs of letters and digits, lower-cased. A text without a signature (null as
    empty) gets the hash of the whole text as its only one, so equal texts always compare as
    equal and others not.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("__parts", _content(whole)).withColumn(into, _chains(F.col("__parts")))
    own = F.when(F.size(into) > 0, F.col(into)).otherwise(F.array(F.hash(F.lit("whole"), whole)))
    return staged.withColumn(into, own).drop("__parts")


def fingerprint(sigs: Column) -> Column:
    """The signature set as one string: eight hex digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0").substr(9, 8)), "")


def jaccard(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    ``docs`` has doc_id and text (null: empty). The edited text replaces the last half
    (floor(n_chars / 2) code points) by the beginning of the next document's text, in ascending
    doc_id order (nulls first, equal ids by a hash of the text), the first one after the last.
    Rows that repeat both doc_id and text count as one in that order and are each returned. A
    single document is its own neighbour. An empty table gives no rows.

    Only narrow rows are ordered; texts move once by their own key and their heads once more to
    the document before, as plain keyed joins.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    narrow = base.select(
        "doc_id", "h", F.floor(F.length("text") / 2).cast("int").alias("half")
    ).distinct()
    order = spool(ranked(narrow, ["doc_id", "h"]))
    count = order.count()
    before = order.select(
        F.col("rank").alias("r"), F.col("doc_id").alias("a_doc"), F.col("h").alias("a_h"), "half"
    )
    links = order.select(
        F.col("doc_id").alias("b_doc"), F.col("h").alias("b_h"),
        F.when(F.col("rank") == 1, F.lit(count)).otherwise(F.col("rank") - 1).alias("r"),
    ).join(before, "r").drop("r")
    # signatures are made on either side of the one text shuffle, so they don't travel with it
    following = base.join(links, base["doc_id"].eqNullSafe(links["b_doc"]) & (base["h"] == links["b_h"]))
    heads = with_signatures(following, "text", "sigs").select(
        "a_doc", "a_h", F.left(F.col("text"), F.col("half")).alias("head"), F.col("sigs").alias("next_sigs")
    ).repartition("a_doc", "a_h").dropDuplicates(["a_doc", "a_h"])
    both = base.join(heads, base["doc_id"].eqNullSafe(heads["a_doc"]) & (base["h"] == heads["a_h"]))
    n_chars = F.length("text").cast("long")
    kept = F.left(F.col("text"), (F.length("text") - F.floor(F.length("text") / 2)).cast("int"))
    edited = with_signatures(both, "text", "sigs").select(
        "doc_id", n_chars.alias("n_chars"), F.concat(kept, F.col("head")).alias("edited"), "sigs", "next_sigs"
    )
    return with_signatures(edited, "edited", "edited_sigs").select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard("sigs", "edited_sigs").alias("near_edited"),
        jaccard("sigs", "next_sigs").alias("near_next"),
    )


def similar_classes(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Exact Jaccard join of the signature sets: (membership, pairs).

    membership has doc_id and class_id (the smallest doc_id of equal fingerprints; null ids
    stay out); pairs has a, b and likeness for classes with likeness >= ``threshold``, a < b.
    A set of n signatures lies in band floor(log n / log 1/threshold), so only sets of one or of
    neighbouring bands can be similar; they meet on the n - ceil(threshold n) + 1 rarest of
    their signatures, which any similar pair must share.
    """
    sets = with_signatures(docs.filter("doc_id is not null").select("doc_id", "text"), "text", "sigs")
    sets = spool(sets.select("doc_id", "sigs", fingerprint(F.col("sigs")).alias("fp")))
    classes = sets.groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    membership = sets.select("doc_id", "fp").join(classes, "fp").select("doc_id", "class_id")
    alone = spool(sets.join(
        classes, (sets["doc_id"] == classes["class_id"]) & (sets["fp"] == classes["fp"]), "left_semi"
    ).select(F.col("doc_id").alias("id"), "sigs").dropDuplicates(["id"]))
    flat = alone.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = flat.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rare = spool(flat.join(counts, "sig").groupBy("id", "n").agg(
        F.collect_list(F.struct("df", "sig")).alias("all")
    ).select("id", "n", F.slice(
        F.sort_array("all"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    )["sig"].alias("prefix")))
    band = F.floor(F.log("n") / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    left = rare.select(
        F.col("id").alias("x"), F.col("n").alias("nx"), F.explode("prefix").alias("sig"), band.alias("band")
    )
    right = rare.select(
        F.col("id").alias("y"), F.col("n").alias("ny"), F.col("prefix"), band.alias("own")
    ).select("y", "ny", F.explode("prefix").alias("sig"), "own").select(
        "y", "ny", "sig", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band")
    )
    met = left.join(right, ["band", "sig"]).filter(
        (F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")) & (F.col("nx") >= threshold * F.col("ny") - 1e-9)
    ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of_a = alone.select(F.col("id").alias("a"), F.col("sigs").alias("sa"))
    of_b = alone.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(of_a, "a").join(of_b, "b").select("a", "b", jaccard("sa", "sb").alias("likeness"))
    return membership, pairs.filter(F.col("likeness") >= threshold)
