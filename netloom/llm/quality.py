"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are taken once per document over its whole text and written to the shared folder. Random Fourier features
approximate a Gaussian kernel over the standardised statistics. Each partition sums its part of the normal equations,
so what travels is one D x D matrix per partition, whatever the number of documents. Scores are calibrated by
pool-adjacent-violators over BINS score bins. All labelled training rows are used; none is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import binary, modest, pack, slices, stored, table, unpack

WIDTH, SEED, BINS = 192, 7, 2048
GAMMA, RIDGE = 0.02, 1.0  # chosen on the training rows whose remainder is 1, fitted on the rest of them
CLASSES = np.zeros(256, np.uint8)  # 0 control, 1 white space, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 other mark, 7 lead byte, 8 continuation
CLASSES[[32, 9, 10, 11, 12, 13]] = 1
CLASSES[97:123] = 2
CLASSES[65:91] = 3
CLASSES[48:58] = 4
CLASSES[list(b".,;:?'\"-()")] = 5
CLASSES[[b for b in range(33, 127) if not CLASSES[b]]] = 6
CLASSES[192:] = 7
CLASSES[128:192] = 8
NAMES = ("length", "lower", "upper", "digit", "mark", "odd", "high", "space", "odd_words", "upper_words", "word_length", "word_spread", "distinct", "top_word", "bigrams", "line_length", "line_repeats", "line_starts", "stops", "long_words")
DIM = len(NAMES)


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text, most of them shares in 0..1; an empty text: zeros."""
    if not text:
        return [0.0] * DIM
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(CLASSES[raw], minlength=9)
    n = max(1, len(raw) - int(kinds[8]))
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n)) / 10, *[0.0] * 6, kinds[1] / n, *[0.0] * (DIM - 8)]
    size = np.fromiter(map(len, words), np.float64, m)
    low = [w.lower().strip(b".,") for w in words]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in low), np.int64, m)
    top = int(np.bincount(ids).max())
    pairs = len(np.unique(ids[:-1] * len(known) + ids[1:])) / (m - 1) if m > 1 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?'\")" for w in words)
    upper = sum(w.isupper() for w in words)
    return [
        float(np.log1p(n)) / 10, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[1] / n,
        odd / m, upper / m, min(1.0, float(size.mean()) / 20), min(1.0, float(size.std()) / 20), len(known) / m, top / m, pairs,
        min(1.0, m / len(lines) / 100), 1 - len(set(lines)) / len(lines), len({x[:12] for x in lines}) / len(lines), float((size <= 3).mean()), float((size > 14).mean()),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats blob) per row; null is empty."""
    modest(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = np.array([statistics(t) for t in binary(b.column("text"))], np.float32).reshape(-1, DIM)
            column = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), DIM).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), column], names=["id", "stats"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)


class Model:
    """Standardisation, random features, weights and calibration; a few hundred kB whatever the corpus."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.frequency = rng.normal(0, np.sqrt(2 * GAMMA), (DIM, WIDTH))
        self.phase = rng.uniform(0, 2 * np.pi, WIDTH)
        self.weights, self.edges, self.levels = np.zeros(WIDTH + 1), np.zeros(0), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / WIDTH) * np.cos(z @ self.frequency + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(stats[k : k + 4096]) @ self.weights for k in range(0, len(stats), 4096)] or [np.zeros(0)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.edges, self.raw(stats), "right")]

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(((self.raw(stats) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def calibrate(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Pool adjacent violators over the bins, upper edges at the bins' ends."""
        blocks: list[list[float]] = []
        for k in np.flatnonzero(counts):
            blocks.append([k, counts[k], sums[k]])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                _, n, s = blocks.pop()
                blocks[-1][1] += n
                blocks[-1][2] += s
        if blocks:
            self.levels = np.array([s / n for _, n, s in blocks])
            self.edges = np.array([2 * b[0] / BINS - 0.5 for b in blocks[1:]])


def _summed(rows: DataFrame, part) -> list[np.ndarray]:
    """Sum of part(stats, labels) over all rows: per task, then over at most 32 tasks, then here."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                new = part(_matrix(b.column("stats")), b.column("label").to_numpy(zero_copy_only=False))
                total = new if total is None else [x + y for x, y in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*(np.ravel(x) for x in total))], pa.binary())], names=["blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for blob in b.column("blob").to_pylist():
                new = unpack(blob)
                total = new if total is None else [x + y for x, y in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*total)], pa.binary())], names=["blob"])

    sums = [unpack(r.blob) for r in rows.mapInArrow(one, "blob binary").repartition(32).mapInArrow(add, "blob binary").collect()]
    return [np.sum(x, axis=0) for x in zip(*sums, strict=True)]


def fit(train: DataFrame) -> Model:
    """train: (stats, label double). Without rows the model scores 0.5 everywhere."""
    moments = _summed(train, lambda x, y: [np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0)])
    if not moments:
        return Model(np.zeros(DIM), np.ones(DIM))
    n, first, second = moments
    mean = first / n
    model = Model(mean, np.sqrt(np.maximum(second / n - mean**2, 1e-8)))

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.features(x)
        return [z.T @ z, z.T @ y]

    gram, target = _summed(train, equations)
    gram = gram.reshape(WIDTH + 1, WIDTH + 1)
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(WIDTH + 1), target)

    def histogram(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = model.bins(x)
        return [np.bincount(k, minlength=BINS).astype(float), np.bincount(k, y, BINS)]

    model.calibrate(*_summed(train, histogram))
    return model


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Model, DataFrame]:
    """The fitted model, and the statistics of all rows of docs."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.avg("label").alias("label"))
    return fit(stored(stats.join(known, "id").select("stats", "label"), "train")), stats


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of docs, in all their columns, that score `cut` or more; trained as for quality_scores()."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = np.array([statistics(t) for t in binary(b.column(text_col))], np.float32).astype(np.float64).reshape(-1, DIM)
            yield b.filter(pa.array(model.value.score(stats) >= cut))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per row of docs: (id, held_out, score, predicted).

    Learns from the labels of rows whose crc32(id as text) mod 5 is not 0; of repeated labels of an id the mean counts,
    null labels and ids are left out. Only the text's statistics enter a score; null counts as empty, and empty texts
    are scored like any other. Without labels every score is 0.5. Repeated rows get the same score.
    """
    fitted, stats = train(docs, labels, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(_matrix(b.column("stats"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score)], names=["id", "score"])

    scored = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
