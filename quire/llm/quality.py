"""Operator 8: a quality classifier by ordinal cumulative-link regression.

Ratings 0 < 1 < ... < K-1 share one weight per hashed text feature; K-1 ordered thresholds turn
the score into the tail probabilities P(grade >= k) = sigmoid(score - threshold[k]).  The model is
fitted on a bounded sample of the labelled rows (``sample``, in the order of a hash of the id, so
the same rows are drawn whatever the partitioning); every whole text is scored.

Features are the distinct words of the text (ASCII letters lower-cased, ASCII punctuation taken as
white space), their first bytes,
and a few bands of style: share of capitals, exclamation marks, bars, symbols, repeated words.

Null and empty texts have only the style features.  Labels with a null are not used; without
usable labels of at least two grades there is no model, every probability is null and every
document is accepted.  Repeated rows are scored row by row, an empty table gives an empty result,
and columns to keep may have any names but those of the result.  Very long texts cost time and, in
a worker, memory in proportion to their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1 << 18
#: Step of the fit.
STEP = 0.1
#: Distinct words whose weight a worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000

#: Letters at the beginning of a word that are a feature of their own, for inflected words.
STEMS = (4, 5)

_SYMBOL = np.array([chr(b) in "#$%&*+<=>@[]^_{}~|\\" for b in range(256)])
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def style(raw: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """The bands of style that a text reaches, as named features; a space begins the name, so no word has it."""
    count = max(1, len(words))
    letters = np.frombuffer(raw, np.uint8)
    capitals = int(((letters >= 0x41) & (letters <= 0x5A)).sum())
    small = int(((letters >= 0x61) & (letters <= 0x7A)).sum())
    bands = {
        b" capitals": min(9, 10 * capitals // max(1, capitals + small)),
        b" marks": min(9, 20 * raw.count(b"!") // count),
        b" bars": min(9, 20 * raw.count(b"|") // count),
        b" symbols": min(9, 10 * int(_SYMBOL[letters].sum()) // count),
        b" repeats": min(9, 10 * (count - distinct) // count),
        b" length": min(7, len(words).bit_length() // 2),
    }
    return [name + b"%d" % k for name, band in bands.items() for k in range(1, band + 1)]


def features(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().translate(_BLANKED).split()
    distinct = set(words)
    stems = {b" %d" % k + w[:k] for w in distinct for k in STEMS}
    return [*distinct, *stems, *style(raw, words, len(distinct))]


def slot(feature: bytes) -> int:
    return zlib.crc32(feature) % DIMENSIONS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_in_all: int, rounds: int = 160, lasso: float = 1e-3, least: int = 5, most: float = 0.3) -> Model:
    """Full-batch proximal Adagrad on the cumulative-link likelihood; the later half of the steps is averaged.

    Features of fewer than ``least`` rows or more than a share ``most`` of them stay at 0, and
    ``lasso`` keeps those at 0 that say little.
    """
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int32)
    spread = np.bincount(flat, minlength=DIMENSIONS)
    chosen = (spread >= least) & (spread <= most * len(rows))
    used = np.flatnonzero(chosen)
    place = np.cumsum(chosen, dtype=np.int32) - 1
    use = chosen[flat]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[use]
    flat = place[flat[use]]
    del use
    # Temporaries are made for so many entries at once.
    parts = [slice(a, a + (1 << 18)) for a in range(0, len(flat), 1 << 18)]
    n, k = len(rows), grades_in_all - 1
    weights = np.zeros(len(used))
    # The thresholds begin where the grades' shares put them.
    below = np.cumsum(np.bincount(grades, minlength=grades_in_all))[:-1] / n
    gaps = np.log((below + 1e-3) / (1 - below + 1e-3))
    sums, gap_sums = np.full(len(used), 1e-8), np.full(k, 1e-8)
    mean, mean_gaps = np.zeros(len(used)), np.zeros(k)
    for turn in range(rounds):
        scores, slope = np.zeros(n), np.zeros(len(used))
        for part in parts:
            scores += np.bincount(owner[part], weights=weights[flat[part]], minlength=n)
        d_score, by_gap = slopes(scores, gaps, grades)
        for part in parts:
            slope += np.bincount(flat[part], weights=d_score[owner[part]], minlength=len(used))
        slope /= n
        sums += slope * slope
        pace = STEP / np.sqrt(sums)
        moved = weights + pace * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * lasso, 0)
        gap_sums += (by_gap / n) ** 2
        gaps = np.maximum.accumulate(gaps + STEP * by_gap / n / np.sqrt(gap_sums))  # the thresholds stay in order
        if 2 * turn >= rounds:
            mean += weights * 2 / rounds
            mean_gaps += gaps * 2 / rounds
    full = np.zeros(DIMENSIONS)
    full[used] = mean
    return Model(full, mean_gaps)


def slopes(scores: np.ndarray, gaps: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood by each row's score and by each threshold."""
    n, k = len(scores), len(gaps)
    tails = 1 / (1 + np.exp(-np.clip(scores[:, None] - gaps[None, :], -40, 40)))
    # P(grade) is a difference of neighbouring tails; its logarithm's derivative by the two ends.
    ends = np.hstack([np.ones((n, 1)), tails, np.zeros((n, 1))])
    high, low = ends[np.arange(n), grades], ends[np.arange(n), grades + 1]
    chance = np.maximum(high - low, 1e-9)
    d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
    by_gap = np.zeros(k)
    np.add.at(by_gap, np.maximum(grades - 1, 0), np.where(grades > 0, -d_high, 0))
    np.add.at(by_gap, np.minimum(grades, k - 1), np.where(grades < k, d_low, 0))
    return d_high - d_low, by_gap


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The default rating: 0 toxic, 1 low quality, 2 good; null if a label is null."""
    q, t = F.col(quality), F.col(toxic)
    return F.when(q.isNull() | t.isNull(), None).when(t > 0, 0).when(q <= 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, grade: Column, grades_in_all: int = 3, sample: int = 6000, slots: int = 8_000_000, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on at most ``sample`` labelled rows, and in their order only as many as have ``slots`` features in all.

    Both are bounds on what one task holds.  The fit runs in that task; the driver gets the weights.
    """
    drawn = (
        labels.select(F.col(key).alias("key"), grade.alias("grade"))
        .where("key IS NOT NULL AND grade IS NOT NULL")
        .orderBy(F.xxhash64(F.col("key").cast("string")), "key", "grade")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({slot(f) for f in features(t.as_py())}) for t in batch.column(2)]
            packed = pa.array([np.array(s, "<u4").tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["key", "grade", "slots"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades, held = [], [], 0
        for batch in batches:
            for g, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(packed.as_py(), "<u4")
                held += len(row)
                if held <= slots:
                    rows.append(row)
                    grades.append(g)
        if len(set(grades)) >= 2:
            model = fit(rows, np.array(grades, np.int64), grades_in_all)
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in (model.weights.astype(np.float32), model.thresholds)]
            yield pa.RecordBatch.from_arrays(arrays, ["weights", "thresholds"])

    # At most `sample` pairs of id and grade: a bound that does not grow with the data.
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key").select("key", "grade", "text")
    schema = T.StructType([joined.schema["key"], T.StructField("grade", T.IntegerType()), T.StructField("slots", T.BinaryType())])
    rows = joined.mapInArrow(run, schema).orderBy(F.xxhash64(F.col("key").cast("string")), "key", "grade", "slots").limit(sample)
    model = rows.select("grade", "slots").coalesce(1).mapInArrow(fitted, "weights binary, thresholds binary").first()
    return model and Model(np.frombuffer(model["weights"], np.float32), np.frombuffer(model["thresholds"], np.float64))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, keep..., expected_grade, tails): the expected grade and P(grade >= 1), P(grade >= 2), ..."""
    if {"expected_grade", "tails"} & {key, *keep}:
        raise ValueError("expected_grade and tails are columns of the result; rename those to keep")
    fields = [docs.schema[c] for c in (key, *keep)]
    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]
    if model is None:
        return docs.select(key, *keep, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # of fixed size
    names = [f.name for f in (*fields, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        own = Model(weights, thresholds)
        known: dict[bytes, float] = {}

        class Known(dict):
            def __missing__(self, feature: bytes) -> float:
                self[feature] = weight = float(weights[slot(feature)])
                return weight

        known = Known()
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, len(whole), 500)):
            scores = np.array([sum(map(known.__getitem__, features(t.as_py()))) for t in batch.column(0)], np.float64)
            if len(known) > REMEMBERED:
                known.clear()
            tails = own.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names
            )

    return docs.select(F.col(text).alias(" text"), *[F.col(f.name) for f in fields]).mapInArrow(run, T.StructType([*fields, *added]))


def accepted(least: float = 0.5) -> Column:
    """Whether the top grade is at least so likely; without a model, yes."""
    return F.coalesce(F.element_at("tails", -1) >= least, F.lit(True))
