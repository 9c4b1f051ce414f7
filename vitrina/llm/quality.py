"""Graded quality by cumulative-link (ordinal) regression on hashed text.

One weight per hashed feature is shared by all grades, ordered thresholds cut the score
into grades: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the
probability of the upper grades serve for selection.

Features are the words of a document and their beginnings (each once), the share of every
word shape (letters as one class, digits as another, signs kept) and the share of words
that repeat the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.llm.common import free_name, words_of

DIMENSIONS = 1 << 18
# Letters of a beginning, which inflected forms of a word share.
BEGINNING = 5
# The bound of the fit: so many labelled rows, those with the smallest hashes of their ids.
SAMPLE_ROWS = 10_000
STEPS = 200
LEARNING_RATE = 0.05
PENALTY = 1e-4
# Weight of a share against that of a word.
SHARE_SCALE = 4.0
# Bytes of text that a task turns into features at once; one longer text is a step of its own.
STEP_CHARS = 1 << 20
# Entries of the sample that the fit multiplies at once.
PIECE = 1 << 18

GRADING = T.StructType([
    T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType()),
])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where a batch of texts is cut for ``features``, whose memory is some twenty times its input.

    What the last step left unused goes back to the system between steps, as a worker that is
    done may stay and wait while others run beside it.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + STEP_CHARS)))
        yield start, stop
        pa.default_memory_pool().release_unused()
        start = stop


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all features of a batch of texts; a text without words has none."""
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    kinds = coded.dictionary
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(kinds, r"\pL+", "a"), r"\pN+", "0")
    beginnings = pc.utf8_slice_codeunits(pc.replace_substring_regex(kinds, r"^\PL+", ""), 0, BEGINNING)
    of_word, of_beginning, of_shape = (
        np.array([xxhash.xxh32_intdigest(w, seed=seed) % DIMENSIONS for w in part.to_pylist()], np.int64)
        for seed, part in enumerate((kinds, beginnings, shapes))
    )
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(sizes)), sizes)

    def counted(feature: np.ndarray):
        key, count = np.unique(rows * DIMENSIONS + feature, return_counts=True)
        return key // DIMENSIONS, key % DIMENSIONS, count

    row, feature, _ = counted(of_word[at] if len(at) else at)
    begin_row, beginning, _ = counted(of_beginning[at] if len(at) else at)
    shape_row, shape, count = counted(of_shape[at] if len(at) else at)
    repeats = np.zeros(len(rows), bool)
    repeats[1:] = (at[1:] == at[:-1]) & (rows[1:] == rows[:-1])
    repeated = np.bincount(rows, repeats, len(sizes))
    again = np.nonzero(repeated)[0]
    return (
        np.concatenate([row, begin_row, shape_row, again]),
        np.concatenate([feature, beginning, shape, np.full(len(again), DIMENSIONS)]),
        np.concatenate([
            np.ones(len(row) + len(begin_row)), SHARE_SCALE * np.sqrt(count / sizes[shape_row]),
            SHARE_SCALE * np.sqrt(repeated[again] / sizes[again]),
        ]),
    )


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def trained(self) -> bool:
        """Whether any rated document shaped the weights."""
        return bool(np.any(self.weights))

    def score(self, texts: pa.Array) -> np.ndarray:
        row, feature, value = features(texts)
        return np.bincount(row, self.weights[feature] * value, len(texts))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one row per text and one column per threshold."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - score[:, None])


def fit_ordinal(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS,
    rate: float = LEARNING_RATE, penalty: float = PENALTY,
) -> OrdinalModel:
    """Weights and ordered thresholds by gradient steps on the penalised likelihood.

    A grade that does not occur leaves its threshold beside its neighbour's. Features, sorted by
    row, are multiplied piece by piece, so that narrow arrays stay narrow: only the products of
    one piece are wide. All of a row's features are in one piece, and what is added up for a
    feature is added in the same order whatever the pieces.
    """
    if np.any(row[1:] < row[:-1]):
        order = np.argsort(row, kind="stable")
        row, feature, value = row[order], feature[order], value[order]
    ends = np.searchsorted(row, row[PIECE::PIECE], "right")
    cuts = np.unique(np.concatenate([[0], ends, [len(row)]])).tolist()
    pieces = [slice(*cut) for cut in zip(cuts[:-1], cuts[1:], strict=True)]
    n, cuts = max(len(grade), 1), grades - 1
    shares = (np.arange(1, grades) - 0.5 * cuts - 0.5) / max(cuts, 1)
    state = np.concatenate([np.zeros(DIMENSIONS + 1), shares])
    first, second = np.zeros_like(state), np.zeros_like(state)
    has_upper, has_lower = grade < cuts, grade > 0
    upper, lower = np.minimum(grade, cuts - 1), np.maximum(grade - 1, 0)
    for step in range(1, steps + 1):
        weights, thresholds = state[:-cuts], state[-cuts:]
        score, slope = np.zeros(len(grade)), np.zeros(DIMENSIONS + 1)
        for piece in pieces:
            base = row[piece.start]
            sums = np.bincount(row[piece] - base, weights[feature[piece]] * value[piece])
            score[base:base + len(sums)] = sums
        below = np.where(has_upper, _sigmoid(thresholds[upper] - score), 1.0)
        under = np.where(has_lower, _sigmoid(thresholds[lower] - score), 0.0)
        likely = np.maximum(below - under, 1e-9)
        rise, fall = below * (1 - below) / likely, under * (1 - under) / likely
        by_score = rise - fall
        for piece in pieces:
            np.add.at(slope, feature[piece], value[piece] * by_score[row[piece]])
        gradient = np.concatenate([
            slope / n + penalty * weights,
            (np.bincount(lower[has_lower], fall[has_lower], cuts) - np.bincount(upper[has_upper], rise[has_upper], cuts)) / n,
        ])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        state[-cuts:] = np.sort(state[-cuts:])
    return OrdinalModel(state[:-cuts], state[-cuts:])


def fit(
    docs: DataFrame, ratings: DataFrame, grades: int, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text"
) -> OrdinalModel:
    """The model of a bounded sample of rated documents.

    ``ratings`` has the key and grade (0 to grades - 1); null keys and grades are left out
    and the smallest of several ratings counts. The sample is the ``rows`` keys with the
    smallest hashes, each with one text: of several texts of a key the one with the smallest
    hash. One task trains on their features, and the weights alone come to the driver. No
    rated documents give a model that finds all grades alike and is not ``trained``.
    """
    rated = ratings.select(F.col(key).alias("key"), F.col("grade").cast("int").alias("grade")).where(
        F.col("key").isNotNull() & F.col("grade").between(0, grades - 1)
    ).groupBy("key").agg(F.min("grade").alias("grade"))
    # A list of at most ``rows`` keys.
    chosen = F.broadcast(rated.orderBy(F.xxhash64("key"), "key").limit(rows))
    sample = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(chosen, "key")
    sample = sample.withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in portions(batch.column("text")):
                part = batch.slice(start, stop - start)
                row, feature, value = features(part.column("text"))
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order]))
                    for x in (feature.astype(np.int32), value.astype(np.float32))
                ]
                own = [part.column(c) for c in ("key", "grade", "h")]
                yield pa.RecordBatch.from_arrays([*own, *lists], ["key", "grade", "h", "f", "v"])

    kind = sample.schema["key"].dataType.simpleString()
    # One row per key, whatever the table repeats.
    found = sample.mapInArrow(run, f"key {kind}, grade int, h long, f array<int>, v array<float>")
    found = found.groupBy("key").agg(F.min_by(F.struct("grade", "f", "v"), "h").alias("one")).select("key", "one.*")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole sample, at most ``rows`` rows of numbers, in one task."""
        taken = (
            (lambda b: b.column("f").value_lengths(), np.int32), (lambda b: b.column("f").flatten(), np.int32),
            (lambda b: b.column("v").flatten(), np.float32), (lambda b: b.column("grade"), np.int64),
        )
        # Copies, so that no batch stays in memory.
        parts = [[np.zeros(0, kind) for _, kind in taken]]
        parts += [[np.array(take(b).to_numpy(zero_copy_only=False), kind) for take, kind in taken] for b in batches]
        columns = list(zip(*parts, strict=True))
        del parts
        sizes, feature, value, grade = (np.concatenate(columns.pop(0)) for _ in taken)
        model = fit_ordinal(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), feature, value, grade, grades)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights], "thresholds": [model.thresholds]})

    trained = found.repartition(1).sortWithinPartitions("key").mapInArrow(train, "weights array<double>, thresholds array<double>")
    model = trained.toArrow()
    return OrdinalModel(*(model.column(c).combine_chunks().flatten().to_numpy() for c in ("weights", "thresholds")))


def grading(model: OrdinalModel, text: Column) -> Column:
    """Struct of expected_grade and p_top, the probability of the highest grade.

    A null or wordless text has score 0: the grade that the thresholds alone give.
    """

    @F.arrow_udf(GRADING)
    def grade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.above(model.score(batch.slice(start, stop - start))) for start, stop in portions(batch)]
            above = np.concatenate([np.zeros((0, len(model.thresholds))), *parts])
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], names=["expected_grade", "p_top"])

    return grade.asNondeterministic()(text.cast("string"))


def selected(docs: DataFrame, model: OrdinalModel, least_p_top: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose highest grade is likely enough, with their own columns, whatever their names.

    A model that saw no rated document tells nothing, so all rows stay. Null and empty texts
    go by the thresholds alone; repeated rows stay or go together; an empty table stays empty.
    """
    if not model.trained:
        return docs
    own = free_name(docs, "__grading")
    return docs.withColumn(own, grading(model, F.col(text))).where(F.col(f"{own}.p_top") >= least_p_top).drop(own)
