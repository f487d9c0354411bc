"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every text. What they say together
is one of at most 3**8 patterns, so one grouped count of patterns over all documents is
all that expectation maximisation needs: it estimates the share of good documents and
how often each labeller is right when it votes, without any true label. The posterior
of a pattern is the soft label of its documents.

A linear scorer over hashed three-byte grams (share of each bucket in the text) is then
fitted to the posteriors of a sample, by logistic loss. `SAMPLE` bounds the different
texts it is fitted on, each taken once; votes, patterns, posteriors and scores cover all documents and whole texts.

Defined results: a null text counts as empty; it gets the posterior of its votes and the
score of the bias alone; rows are judged one by one, so repeated rows and ids and null ids
pass through; extra columns pass through `kept_only`; without documents (an empty table)
the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.quality_rules import STOP_WORDS, SYMBOLS
from tierflow.llm.words import lowered, sliced, text_bytes, word_hashes

#: Most different texts that the scorer is fitted on.
#: Their features, at most 128 KB each and mostly a tenth of that, are collected to the driver.
SAMPLE = 4_000
BUCKET_BITS = 14
GRAM = 3
#: Documents stay whose score (probability of good) is at least this.
KEEP = 0.5
#: No labeller is taken to be right less often than this.
LEAST_ACCURACY = 0.7
_CHUNK = 2 << 20
_EPOCHS, _RATE, _DECAY = 300, 2.0, 1e-6


@dataclass(frozen=True)
class Labeller:
    """Votes bad outside [bad_low, bad_high], good inside [good_low, good_high], else nothing."""

    measure: str
    bad_low: float
    bad_high: float
    good_low: float
    good_high: float


_INF = float("inf")
_NEVER = (_INF, -_INF)
LABELLERS = (
    Labeller("symbols", -_INF, 0.06, *_NEVER),
    Labeller("stop_words", 0.05, _INF, 0.10, _INF),
    Labeller("shouts", -_INF, 0.2, *_NEVER),
    Labeller("new_windows", 0.75, _INF, *_NEVER),
    Labeller("capitals", -_INF, 0.4, *_NEVER),
    Labeller("words", 1, _INF, *_NEVER),
    Labeller("word_length", 3.0, 8.0, *_NEVER),
    Labeller("repeats", -_INF, 0.15, *_NEVER),
)


def _stop_hashes() -> np.ndarray:
    texts = pa.array(sorted(set(STOP_WORDS)), pa.string())
    return np.unique(word_hashes(*text_bytes(texts))[0])


_STOP = _stop_hashes()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The labellers' measures of every text; nan where a text has too few words to tell."""
    data, borders = text_bytes(texts)
    hashes, places = word_hashes(data, borders)
    per_text = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    n = np.diff(places).astype(float)
    some = np.where(n > 0, n, np.nan)
    lower = lowered(data)
    letters = per_text((lower >= 97) & (lower <= 122), borders).astype(float)
    chars = per_text((data > 32) & ((data & 0xC0) != 0x80), borders).astype(float)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[places[:-1][places[:-1] < len(hashes)]] = False
    three = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] if len(hashes) > 2 else hashes[:0]
    new = np.array([len(np.unique(three[a : b - 2])) if b - a >= 20 else np.nan for a, b in zip(places[:-1].tolist(), places[1:].tolist())], float)
    return {
        "symbols": per_text(_IS_SYMBOL[data], borders) / np.where(chars > 0, chars, np.nan),
        "stop_words": per_text(np.isin(hashes, _STOP) & ~same, places) / np.where(n >= 10, n, np.nan),
        "shouts": per_text(data == 33, borders) / some,
        "new_windows": new / np.maximum(1, n - 2),
        "capitals": per_text((data >= 65) & (data <= 90), borders) / np.where(letters > 20, letters, np.nan),
        "words": n,
        "word_length": chars / some,
        "repeats": per_text(same, places) / np.where(n >= 10, n, np.nan),
    }


def patterns(texts: pa.Array) -> np.ndarray:
    """The votes of every text as a number in base 3; digits 0 nothing, 1 bad, 2 good."""
    found, out = measures(texts), np.zeros(len(texts), np.int64)
    for i, x in enumerate(LABELLERS):
        m = found[x.measure]
        with np.errstate(invalid="ignore"):
            bad, good = (m < x.bad_low) | (m > x.bad_high), (m >= x.good_low) & (m <= x.good_high)
        out += np.where(bad, 1, np.where(good, 2, 0)) * 3**i
    return out


def digits(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def posteriors(pattern: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """P(good | pattern), the share of good documents, and the accuracy of every labeller.

    A labeller that votes is right with its accuracy, whatever the class; no vote tells
    nothing. Starts from the majority of votes, which also fixes which class is good.
    """
    votes = digits(pattern)
    sign = np.where(votes == 2, 1.0, np.where(votes == 1, -1.0, 0.0))
    good = 0.5 + 0.4 * np.sign(sign.sum(axis=1) + 0.5)
    share, accuracy = 0.5, np.full(len(LABELLERS), 0.5)
    for _ in range(rounds):
        share = float((good @ counts + 1) / (counts.sum() + 2))
        right = np.where(votes == 2, good[:, None], np.where(votes == 1, 1 - good[:, None], 0.0))
        accuracy = np.clip((counts @ right + 1.8) / (counts @ (votes > 0) + 2), LEAST_ACCURACY, 0.99)
        logit = np.log(share / (1 - share)) + sign @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-logit))
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return good, share, accuracy


def _buckets(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every three-byte gram, and each text's first gram (n + 1 places)."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    inside = np.ones(len(bucket), bool)
    for back in (1, 2):
        at = borders[1:-1] - back
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    firsts = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside], firsts[np.minimum(borders, len(bucket))]


def _linear(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    data, borders = text_bytes(texts)
    bucket, places = _buckets(data, borders)
    total = np.diff(np.concatenate([[0.0], np.cumsum(weights[bucket])])[places])
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, np.diff(places)) + bias, -50, 50)))


def _pattern_of_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in sliced(whole, 1, _CHUNK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(patterns(b.column(1)))], ["h", "pattern"])


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern and bucket shares of each different text of a task; h is the hash of the text."""
    seen: set[int] = set()
    for whole in batches:
        for b in sliced(whole, 1, _CHUNK):
            new = []
            for h in b.column(0).to_pylist():
                new.append(h not in seen)
                seen.add(h)
            b = b.filter(pa.array(new, pa.bool_()))
            data, borders = text_bytes(b.column(1))
            bucket, places = _buckets(data, borders)
            both = [np.unique(bucket[i:j], return_counts=True) for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(patterns(b.column(1))), pa.array([x.astype("<i4").tobytes() for x, _ in both], pa.binary()), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes() for _, n in both], pa.binary())], ["h", "pattern", "buckets", "shares"])


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs; its size doesn't depend on the number of documents."""

    posterior: dict[int, float]
    weights: np.ndarray
    bias: float
    share: float
    accuracies: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Count texts by pattern over all documents, run EM, fit the scorer on at most `sample` texts."""
    texts = docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), F.col("text").cast("string").alias("text"))
    each = texts.mapInArrow(_pattern_of_each, "h long, pattern long")
    found = each.groupBy("pattern").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy("pattern").collect()
    pattern, counts = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float)
    good, share, accuracies = posteriors(pattern, counts)
    posterior = dict(zip(pattern.tolist(), good.tolist()))
    weights, bias = np.zeros(1 << BUCKET_BITS), float(np.log(share / (1 - share)))
    n = counts.sum()
    if n:
        # A fixed hash of the text picks the texts; the smallest hashes stay if they are too many.
        part = min(1.0, 1.2 * sample / n)
        hashed = texts
        if part < 1:
            hashed = hashed.where(F.col("h") <= int(part * (1 << 64)) - (1 << 63))
        own = hashed.mapInArrow(_features, "h long, pattern long, buckets binary, shares binary").dropDuplicates(["h"])
        rows = own.orderBy("h").limit(sample).collect()
        weights, bias = _fitted([(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.shares, "<f4"), posterior.get(r.pattern, share)) for r in rows], bias)
    return Model(posterior, weights, bias, share, accuracies)


def _fitted(rows: list[tuple[np.ndarray, np.ndarray, float]], bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradients with a rate of its own for every bucket."""
    rows = [r for r in rows if len(r[0])]
    weights = np.zeros(1 << BUCKET_BITS)
    if not rows:
        return weights, bias
    columns, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    target = np.array([r[2] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Both classes weigh the same, however rare one is.
    mean = min(max(target.mean(), 1e-3), 1 - 1e-3)
    importance = target / (2 * mean) + (1 - target) / (2 * (1 - mean))
    seen, seen_bias, bias = np.full(len(weights), 1e-12), 1e-12, 0.0
    for _ in range(_EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[columns] * x, starts) + bias, -50, 50)))
        error = (p - target) * importance / len(rows)
        gradient = np.bincount(columns, weights=np.repeat(error, sizes) * x, minlength=len(weights)) + _DECAY * weights
        seen, seen_bias = seen + gradient**2, seen_bias + error.sum() ** 2
        weights = weights - _RATE * gradient / np.sqrt(seen)
        bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def _judged(model: Model, column: int, with_scores: bool, keep: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, column, _CHUNK):
                texts = b.column(column)
                score = _linear(texts, model.weights, model.bias)
                kept = pa.array(score >= keep)
                if not with_scores:
                    yield b.filter(kept)
                    continue
                weak = [model.posterior.get(p, model.share) for p in patterns(texts).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak, pa.float64()), pa.array(score), kept], ["doc_id", "weak_label", "score", "kept"])

    return run


def scored(docs: DataFrame, model: Model | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score and kept of every row."""
    model = model or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(_judged(model, 1, True, keep), f"doc_id {kind}, weak_label double, score double, kept boolean")


def kept_only(docs: DataFrame, model: Model | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the scorer keeps, with the columns of docs."""
    model = model or fit(docs)
    return docs.mapInArrow(_judged(model, docs.columns.index("text"), False, keep), docs.schema)
