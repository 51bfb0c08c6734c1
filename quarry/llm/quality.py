"""Quality scores of texts: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives a few statistics; standardised, they go through random cosines that approximate a Gaussian kernel.
Normal equations are summed by partition over a bounded number of labelled rows and solved on the driver, and scores
are calibrated on labelled rows that the regression has not seen.

Nulls and ties: a null text counts as empty, and empty texts have statistics (zeros) and a score like others. Rows
whose label is null train nothing; several labels of one document count each. Scores are shares of calibration rows
with one row of either kind added half to each, so labels of one kind give a share near that kind, not at it; without
labels, or without any in the calibration fold, all scores are 0.5. Equal texts get equal scores. Texts are used whole; columns other
than doc_id, text and the labels' are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, slices

#: Random features, ridge penalty (as a share of the rows) and kernel width (in standard deviations, for each statistic).
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-4, 1.5, 7
#: Labelled rows that are fitted on, at most: of more, an even part by a hash of the id.
FIT_ROWS = 200_000
#: Partitions of the fit: each sends one matrix of 0.5 MB to the driver.
FIT_PARTS = 16
#: Of four calibration rows, regression rows are three: the rows with this remainder calibrate.
CALIBRATION_FOLDS = 4
BINS = 1000
#: Bytes of text worked on at a time.
SLICE = 1 << 20

_WORD_END_SYMBOL = re.compile(r"[#$%&*@^~|\\<>=+]+")
_STOPS = ".!?…"


def statistics(text: str) -> list[float]:
    """Numbers that describe a text: sizes, shares of kinds of characters, repetition."""
    n = len(text)
    if n == 0:
        return [0.0] * N_STATISTICS
    words = text.split()
    count = len(words) or 1
    lines = text.split("\n")
    ascii_text = text.encode("ascii", "replace").decode()
    upper = sum(map(ascii_text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    symbols = sum(map(text.count, "#$%&*@^~|\\<>=+{}[]_"))
    marks = sum(map(text.count, ".,;:"))
    bangs = text.count("!") + text.count("?")
    ended = sum(line.rstrip()[-1:] in _STOPS for line in lines if line)
    return [
        np.log1p(n), np.log1p(count), n / count, upper / n, digits / n, symbols / n, marks / n, bangs / n,
        len(set(words)) / count, len(set(lines)) / len(lines), count / len(lines), ended / len(lines),
        len(_WORD_END_SYMBOL.findall(text)) / count, sum(w.isupper() for w in words) / count,
        sum(len(w) < 4 for w in words) / count, sum(len(w) > 12 for w in words) / count,
    ]


N_STATISTICS = 16


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, stats): the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, size=SLICE):
                stats = [statistics(t or "") for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    docs = documents.select("doc_id", "text")
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>")


class Model:
    """Maps rows of statistics to calibrated scores."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        draw = np.random.default_rng(SEED)
        self._mean, self._deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self._turn = draw.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), FEATURES))
        self._phase = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.zeros(0), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        # far outliers keep their direction but not their size
        z = np.clip((stats - self._mean) / self._deviation, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self._turn + self._phase)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        edges, levels = self.steps
        return levels[np.searchsorted(edges, self.raw(stats), side="right")]


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares that fit positive/total best, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for n, p in zip(total.tolist(), positive.tolist(), strict=True):
        pools.append([n, p, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, p, k = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + p, pools[-1][2] + k]
    # one row of either kind is added to each pool, so that no score is certain
    return np.repeat([(p + 0.5) / (n + 1) for n, p, _ in pools], [int(k) for _, _, k in pools])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """labelled: (doc_id, stats, label 0/1)."""
    labelled = labelled.where("label is not null").select("doc_id", "stats", F.col("label").cast("double").alias("label"))
    size = labelled.count()
    if size > fit_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_rows / size)))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLDS)) == 0
    labelled = labelled.repartition(FIT_PARTS, "doc_id")
    if not size:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_STATISTICS))
        rows = 0
        for batch in batches:
            x = _stats(batch)
            total += x.sum(axis=0), (x * x).sum(axis=0)
            rows += len(x)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "sums": [total.ravel().tobytes()]})

    found = map_arrow(labelled, moments, "rows long, sums binary").collect()  # FIT_PARTS rows
    rows = sum(r["rows"] for r in found) or 1
    mean, square = sum(np.frombuffer(r["sums"]).reshape(2, -1) for r in found) / rows
    model = Model(mean, np.sqrt(np.maximum(square - mean * mean, 0)))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(_stats(batch))
            left += z.T @ z
            right += z.T @ np.asarray(batch.column("label"))
        yield pa.RecordBatch.from_pydict({"left": [left.tobytes()], "right": [right.tobytes()]})

    sums = map_arrow(labelled.where(~part), equations, "left binary, right binary").collect()  # FIT_PARTS rows
    left = sum(np.frombuffer(r["left"]) for r in sums).reshape(FEATURES + 1, -1)
    right = sum(np.frombuffer(r["right"]) for r in sums)
    model.weights = np.linalg.solve(left + (RIDGE * max(left[0, 0], 1) * np.eye(FEATURES + 1)), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip(np.floor(model.raw(_stats(batch)) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bin": bins, "label": batch.column("label")})

    held = map_arrow(labelled.where(part), binned, "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()  # 3 * BINS rows at most
    if held:
        shares = isotonic(np.array([r["n"] for r in held], float), np.array([r["p"] for r in held], float))
        model.steps = np.array([r["bin"] for r in held][1:]) / BINS, shares
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every described row."""
    sent = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(_stats(batch)))], ["doc_id", "score"])

    return map_arrow(described.select("doc_id", "stats"), run, f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double")


def train_and_score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that labels (doc_id, label) holds."""
    described = materialize(describe(documents), "quality-stats")
    return score(described, fit(described.join(labels.select("doc_id", "label"), "doc_id")))
