"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams (lower-cased, within words, hashed
into a fixed number of buckets), followed by a linear softmax over the learned languages. Both
layers are trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts; a temperature fitted on rows kept out of training calibrates the scores, and the same
rows set the score below which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMS = 16
GRAMS = (2, 3, 4)
#: bytes looked at in one step, so that memory does not follow the length of a text
_STEP = 1 << 20
#: fixed value: the multiplier that rolls a byte into an n-gram hash
_ROLL = np.uint32(0x01000193)


@dataclass(frozen=True)
class TrainingPlan:
    """Bounds and settings of the fit; the sample is the only thing that is bounded."""

    per_language: int = 600
    max_languages: int = 200
    pieces: int = 8
    piece_bytes: tuple[int, ...] = (24, 48, 96, 192)
    epochs: int = 4
    batch: int = 64
    rate: float = 8.0
    calibration_share: float = 0.25
    false_reject: float = 0.0001
    #: a score above this multiple of chance is never rejected, so short clean texts stay
    chance_factor: float = 1.5
    seed: int = 13


def _byte_classes() -> np.ndarray:
    """Letters stay (A-Z lower-cased, every byte of a multi-byte character), others are breaks."""
    to = np.full(256, 0x20, dtype=np.uint8)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0x80 or char.isalpha():
            to[byte] = ord(char.lower()) if byte < 0x80 else byte
    return to


_CLASSES = _byte_classes()


def bucket_ids(data: bytes) -> np.ndarray:
    """Buckets of the n-grams of ``data``; words are bounded by one break on either side."""
    plain = _CLASSES[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    breaks = plain == 0x20
    plain = plain[~(breaks & np.concatenate(([False], breaks[:-1])))]
    inner = plain == 0x20
    found = []
    hashed = plain.astype(np.uint32)
    for size in range(2, max(GRAMS) + 1):
        if len(plain) < size:
            break
        hashed = hashed[:-1] * _ROLL + plain[size - 1 :]
        if size in GRAMS:
            # a break may stand at either end, not inside
            whole = np.ones(len(hashed), dtype=bool)
            for at in range(1, size - 1):
                whole &= ~inner[at : at + len(hashed)]
            mixed = (hashed ^ np.uint32(size)) * np.uint32(0x9E3779B1)
            found.append((mixed >> np.uint32(32 - 15))[whole])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "surrogatepass")
        total, count = np.zeros(len(self.languages)), 0
        for start in range(0, len(data), _STEP):
            ids = bucket_ids(data[start : start + _STEP])
            count += len(ids)
            hits = np.bincount(ids, minlength=BUCKETS) if len(ids) > BUCKETS else None
            total += hits @ self.table if hits is not None else self.table[ids].sum(axis=0)
        return total / max(count, 1) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        scaled = self.logits(text) / self.temperature
        odds = np.exp(scaled - scaled.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _softmax(scores: np.ndarray) -> np.ndarray:
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    def loss(log_t: float) -> float:
        odds = _softmax(scores / np.exp(log_t))
        return float(-np.log(odds[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: list[tuple[str, list[bytes]]], plan: TrainingPlan) -> LanguageModel:
    """Fit on (language, pieces) rows; needs at least one row."""
    draw = np.random.default_rng(plan.seed)
    languages = sorted({language for language, _ in rows})
    number = {language: i for i, language in enumerate(languages)}
    kept_out = draw.random(len(rows)) < plan.calibration_share
    samples: tuple[list, list] = ([], [])
    for (language, pieces), out in zip(rows, kept_out, strict=True):
        for piece in pieces:
            ids = bucket_ids(piece)
            if len(ids):
                samples[int(out)].append((ids, number[language]))
    fit = samples[0] or samples[1]
    held = samples[1] or samples[0]
    embed = draw.normal(0, 0.1, (BUCKETS, DIMS))
    output, bias = np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    steps = plan.epochs * max(1, -(-len(fit) // plan.batch))
    step = 0
    for _ in range(plan.epochs):
        order = draw.permutation(len(fit))
        for start in range(0, len(order), plan.batch):
            part = [fit[i] for i in order[start : start + plan.batch]]
            rate = plan.rate * (1 - step / steps)
            step += 1
            sizes = np.array([len(ids) for ids, _ in part])
            flat = np.concatenate([ids for ids, _ in part])
            labels = np.array([label for _, label in part])
            mean = np.add.reduceat(embed[flat], np.concatenate(([0], sizes.cumsum()[:-1]))) / sizes[:, None]
            error = _softmax(mean @ output + bias)
            error[np.arange(len(part)), labels] -= 1
            back = error @ output.T / sizes[:, None]
            output -= rate * mean.T @ error / len(part)
            bias -= 0.1 * rate * error.mean(axis=0)
            np.add.at(embed, flat, np.repeat(-rate * back / len(part), sizes, axis=0))
    model = LanguageModel(languages, embed @ output, bias, 1.0, 0.0)
    if held:
        scores = np.array([model.table[ids].mean(axis=0) + bias for ids, _ in held])
        labels = np.array([label for _, label in held])
        model.temperature = _temperature(scores, labels)
        odds = _softmax(scores / model.temperature).max(axis=1)
        # at most this share of the labelled pieces kept out of training may be refused
        quantile = float(np.quantile(odds, plan.false_reject))
        model.reject_below = min(quantile, plan.chance_factor / len(languages))
    return model


def _pieces(plan: TrainingPlan):
    """Evenly spread byte pieces of each sampled text, of several lengths, so short texts fit in."""
    def cut(text: str, seed: int) -> list[bytes]:
        data = text.lower().encode("utf-8", "surrogatepass")
        draw = np.random.default_rng(seed % 2**63)
        found = []
        for at in range(plan.pieces):
            size = plan.piece_bytes[at % len(plan.piece_bytes)]
            start = int(draw.integers(0, max(1, len(data) - size + 1)))
            found.append(data[start : start + size])
        return found

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({
                "lang": batch["lang"],
                "pieces": [cut(t, int(h)) for t, h in zip(batch["text"], batch["h"], strict=True)],
            })

    return run


def fit(labelled: DataFrame, plan: TrainingPlan | None = None) -> LanguageModel | None:
    """Train on up to ``plan.per_language`` rows of each language, chosen by a hash of doc_id.

    ``labelled`` has doc_id, text and lang; rows with a null among them or no letter are left
    out. The sample reaches the driver as bounded byte pieces. None if no row is left, as then
    there is no language to learn. Beyond ``max_languages`` the fit is refused.
    """
    plan = plan or TrainingPlan()
    usable = labelled.filter("doc_id is not null and lang is not null").filter(has_letter("text"))
    ranked = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn(
        "at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    )
    chosen = ranked.filter(F.col("at") <= plan.per_language).select("doc_id", "lang", "h")
    count = chosen.select("lang").distinct().count()
    if count > plan.max_languages:
        raise ValueError(f"{count} languages exceed max_languages={plan.max_languages}")
    if not count:
        return None
    # at most per_language * max_languages rows, so the broadcast is bounded
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = sample.select("lang", "text", "h").mapInPandas(_pieces(plan), "lang string, pieces array<binary>")
    found = [(r["lang"], [bytes(p) for p in r["pieces"]]) for r in rows.toLocalIterator()]
    return train(sorted(found), plan)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def guess(spark: SparkSession, model: LanguageModel | None, text: str = "text") -> Column:
    """Struct column (lang_pred, score, rejected) of a text column, from whole texts alone.

    Texts that are null or hold no letter get ``und``, score 0 and are rejected; so does every
    text where no language was learned. ``rejected`` also marks scores below the calibrated
    bound. Ties go to the first language in alphabetical order. The model (buckets x languages
    numbers) is broadcast; other columns of a row stay untouched on the JVM's side.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        own = shared.value
        found = [
            own.predict(t) if has and own else (UNKNOWN, 0.0)
            for t, has in zip(texts, letters, strict=True)
        ]
        return pd.DataFrame({
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
            "rejected": [f[0] == UNKNOWN or f[1] < own.reject_below for f in found],
        })

    return judge(F.col(text), has_letter(text))


def predict(docs: DataFrame, model: LanguageModel | None, into: str = "language") -> DataFrame:
    """``docs`` with the struct of ``guess`` as column ``into``; an empty table stays empty."""
    return docs.withColumn(into, guess(docs.sparkSession, model))
