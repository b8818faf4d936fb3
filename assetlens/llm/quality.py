"""Quality scores by random Fourier features of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm import frames, shingles

FEATURES = 128
FOLDS = 3
RIDGE = 1e-2
SEED = 7
BINS = 1000
#: Statistics further from the mean than so many deviations count as that far.
FAR = 4.0

#: Kinds of bytes whose shares are statistics: lower case, upper case, digits, spaces, line ends,
#: marks of sentences, exclamations, bars, other symbols, bytes beyond ASCII.
KIND = np.full(256, 8, dtype=np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 9
KIND[[0x20, 0x09]], KIND[[0x0A, 0x0D]] = 3, 4
KIND[list(b".,;:'\"-?()")], KIND[33], KIND[124] = 5, 6, 7
KINDS = 10
STATISTICS = KINDS + 8


def repeated(items: np.ndarray) -> float:
    return 1 - len(np.unique(items)) / len(items) if len(items) else 0.0


def statistics(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers that describe a text: shares of kinds of bytes, lengths and repetition."""
    out = np.zeros(STATISTICS)
    n = len(raw)
    if not n:
        return out
    out[:KINDS] = np.bincount(KIND[raw], minlength=KINDS) / n
    count = len(words)
    lines = 1 + int(np.count_nonzero(raw == 10))
    spaces = out[3] + out[4]
    out[KINDS:] = (
        np.log1p(count),
        np.log1p((1 - spaces) * n / max(count, 1)),
        repeated(words),
        repeated(shingles.windows(words, 2)),
        repeated(shingles.windows(words, 5)),
        float(np.mean(words[1:] == words[:-1])) if count > 1 else 0.0,
        np.log1p(count / lines),
        np.log1p(lines),
    )
    return out


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text of an Arrow column without nulls."""
    rows = [
        statistics(np.frombuffer(text.as_buffer() or b"", np.uint8), words)
        for text, words in zip(column, shingles.texts_words(column), strict=True)
    ]
    return np.array(rows).reshape(-1, STATISTICS)


@dataclass(frozen=True)
class Classifier:
    """Everything a score needs."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    raw_points: np.ndarray
    calibrated: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = mapped(rows, self.mean, self.deviation) @ self.weights
        return np.interp(raw, self.raw_points, self.calibrated)


def mapped(rows: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant.

    Their inner products approach a Gaussian kernel whose width is the square root of the number
    of statistics.
    """
    draw = np.random.default_rng(SEED)
    directions = draw.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
    shifts = draw.uniform(0, 2 * np.pi, FEATURES)
    near = np.clip((rows - mean) / deviation, -FAR, FAR)
    out = np.ones((len(rows), FEATURES + 1))
    out[:, :-1] = np.sqrt(2 / FEATURES) * np.cos(near @ directions + shifts)
    return out


def is_held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; a row without an id has no label."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to sums / counts, by pooling neighbours out of order."""
    pools: list[list[float]] = []
    for total, count in zip(sums, counts, strict=True):
        pools.append([total, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, count, width = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + count, pools[-1][2] + width]
    return np.concatenate([np.full(int(w), t / c) for t, c, w in pools])


def summed(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sum of square matrices (fold, part) over partitions; a few numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for fold, row, part in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                values = part.values.to_numpy()
                total[fold, row] = total[fold, row] + values if (fold, row) in total else values.copy()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))],
                ["fold", "row", "part"],
            )

    rows = partials.repartition("fold", "row").mapInArrow(add, "fold int, row int, part array<double>").collect()
    out = {fold: np.zeros((FEATURES + 2, FEATURES + 2)) for fold in range(FOLDS)}
    for row in rows:
        out[row.fold][row.row] = row.part
    return out


def solved(gram: np.ndarray) -> np.ndarray:
    """Ridge weights from sums of products; the last row and column are those with the label."""
    n = max(gram[-2, -2], 1.0)
    penalty = RIDGE * n / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and statistics of each row, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["id", *names()])

    read = docs.select(F.col(id_col).alias("id"), frames.whole(F.col(text_col)).alias("text"))
    fields = [read.schema["id"], *[T.StructField(n, T.DoubleType()) for n in names()]]
    return frames.staged(read.mapInArrow(run, T.StructType(fields)), "statistics")


def names() -> list[str]:
    return [f"s{k}" for k in range(STATISTICS)]


def matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(first, first + STATISTICS)])


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Classifier:
    """A classifier from statistics (`described`) and labels, without the held-out rows' labels.

    Means and deviations are over all rows. Normal equations are summed by partition and fold, over
    every labelled row; the driver sees sums only. Scores for the calibration come from the
    folds a row is not in, summed into bins. Missing labels are passed over; several labels of
    one id count as their mean. Without labels every score is 1/2.
    """
    moments = rows.agg(*[f(F.col(n)).alias(f"{n}_{f.__name__}") for n in names() for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[f"{n}_avg"] or 0.0 for n in names()])
    deviation = np.array([moments[f"{n}_stddev_pop"] or 0.0 for n in names()])
    deviation[deviation < 1e-9] = 1.0
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & ~is_held_out(F.col("id")))
        .groupBy("id").agg(F.avg("label").alias("label"))
    )
    fold = (F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")) % FOLDS).cast("int").alias("fold")
    train = frames.staged(rows.join(known, "id").select(fold, "label", *names()), "training")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            folds = batch.column(0).to_numpy()
            whole = np.column_stack([mapped(matrix(batch, 2), mean, deviation), batch.column(1).to_numpy()])
            for f in range(FOLDS):
                total[f] += whole[folds == f].T @ whole[folds == f]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * (FEATURES + 2), pa.int32()), pa.array(range(FEATURES + 2), pa.int32()), pa.array(list(total[f]), pa.list_(pa.float64()))],
                    ["fold", "row", "part"],
                )

    grams = summed(train.mapInArrow(products, "fold int, row int, part array<double>"))
    everything = sum(grams.values())
    if not everything[-2, -2]:
        return Classifier(mean, deviation, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    others = np.array([solved(everything - grams[f]) if (everything - grams[f])[-2, -2] else solved(everything) for f in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, BINS))
        for batch in batches:
            raw = np.einsum("ij,ij->i", mapped(matrix(batch, 2), mean, deviation), others[batch.column(0).to_numpy()])
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            found[0] += np.bincount(at, minlength=BINS)
            found[1] += np.bincount(at, batch.column(1).to_numpy(), BINS)
            found[2] += np.bincount(at, raw, BINS)
        some = np.flatnonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(v[some]) for v in found]], ["bin", "n", "label", "raw"])

    bins = train.mapInArrow(binned, "bin bigint, n double, label double, raw double").groupBy("bin")
    bins = bins.agg(*[F.sum(c).alias(c) for c in ("n", "label", "raw")]).orderBy("bin").collect()
    n, label, raw = (np.array([b[c] for b in bins]) for c in ("n", "label", "raw"))
    return Classifier(mean, deviation, solved(everything), raw / n, isotonic(label, n))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Per row of `docs`: id, held_out, score (0 to 1), predicted (1 from a score of 1/2).

    Scores follow from the whole text alone; missing and empty texts get that of an empty one.
    Equal texts get equal scores. A row without an id is scored and not held out. An empty
    table gives an empty one; further columns are not read.
    """
    rows = described(docs, id_col, text_col)
    model = fit(rows, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch, 1)))], ["id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select(
        F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, as they are, without a shuffle of texts."""
    model = fit(described(docs, id_col, text_col), labels, id_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).fill_null("")
            yield batch.filter(pa.array(model.score(text_statistics(text)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
