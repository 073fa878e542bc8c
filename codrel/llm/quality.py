"""Quality classifier: linear support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text's features are the distinct byte n-grams (one to four bytes) of the whole text,
hashed to a fixed number of slots, and the distinct words likewise. Each indicator is scaled
by its class log-count ratio, each text to unit length, and a hinge-loss model is fitted by
dual coordinate descent. Margins become scores from 0 to 1 by a logistic curve fitted on
rows that the model for it has not seen.

The model is fitted on a bounded sample of labelled rows: ``most_rows`` ids with the lowest
hashes, one text each, in one task of an executor. It is 2**BITS numbers whatever the corpus,
so the driver passes it on and scoring ships it with the task. Nothing but the text enters a score.

Defined results: a null text scores as the empty text, which has no features and so the
score of the bias alone; a very long text counts each n-gram once, like any other; equal texts
score equally; of rows that repeat an id the text of the lowest hash is learned from and each is
scored; rows without a label, or with labels that contradict each other, are not learned from;
with no labels of one class every score is the share of label 1 (0.5 without labels); an empty
table gives an empty table. Other columns pass through ``score``, which replaces a column of the
name it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, shuffle_partitions, text_or_empty

BITS = 18
SLOTS = 1 << BITS
LONGEST = 4
#: Slots of a pattern of repeats: a text has thousands of other slots, and unit length would drown one.
COPIES = 8
#: Labelled rows learned from, at most.
MOST_ROWS = 6000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots_of(kind: int, value: int) -> np.ndarray:
    """Slots of a pattern of repeats, by the mixer that the n-grams use."""
    code = (((kind << 32 | value) << 8) + np.arange(COPIES)).astype(np.uint64) + np.uint64(9 << 56)
    return (code * _MIX ^ (code >> np.uint64(7))) * _MIX >> np.uint64(64 - BITS)


def features(text: str) -> np.ndarray:
    """The slots of a text's n-grams, ascending and distinct."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    seen = np.zeros(SLOTS, bool)
    run = np.zeros(len(raw), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(raw) < n:
            break
        run = (run[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :]
        seen[((run + np.uint64(n << 56)) * _MIX) >> np.uint64(64 - BITS)] = True
    if len(raw):
        # Words: sums of mixed bytes and places between spaces, cut out of one running sum.
        gap = np.flatnonzero(raw <= 32)
        starts, ends = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(raw)]])
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(starts, ends - starts + 1)[: len(raw)].astype(np.uint64)
        mixed = (raw + np.uint64(1)) * _MIX ^ ((place + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * _MIX, dtype=np.uint64)])
        word = (total[ends] - total[starts])[ends > starts]
        seen[(word * _MIX) >> np.uint64(64 - BITS)] = True
        # Which neighbours in a run of words are the same word: one slot for each pattern of each length, and one for each power of two of repeats.
        same = (word[1:] == word[:-1]).astype(np.uint64)
        run = np.zeros(len(same), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(same) < n:
                break
            run = (run[: len(same) - n + 1] << np.uint64(1)) | same[n - 1 :]
            for pattern in np.unique(run).tolist():
                seen[_slots_of(n, pattern)] = True
        seen[_slots_of(0, int(same.sum()).bit_length())] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # for each slot: ratio times support-vector weight
    squares: np.ndarray  # for each slot: ratio squared, to scale texts to unit length
    bias: float
    slope: float
    offset: float

    def score(self, text: str) -> float:
        return float(_logistic(self.slope * self.margin(features(text)) + self.offset))

    def margin(self, slots: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[slots].sum()))
        return (float(self.weights[slots].sum()) / norm if norm else 0.0) + self.bias


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(SLOTS, alpha), np.full(SLOTS, alpha)]
    for slots, y in zip(rows, labels, strict=True):
        counts[int(y)][slots] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; each class weighs the same in total."""
    y = np.where(labels == 1, 1.0, -1.0)
    upper = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    values = [ratios[s] for s in rows]
    values = [v / (np.sqrt((v * v).sum()) or 1.0) for v in values]
    alpha, w, bias = np.zeros(len(y)), np.zeros(SLOTS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            s, v = rows[i], values[i]
            gradient = y[i] * (float(w[s] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[s] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps on smoothed targets."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _logistic(x @ beta)
        gradient = x.T @ (p - target) + 1e-6 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 4) -> Model:
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0, float(np.log(share / (1 - share))))

    def trained(mine: np.ndarray) -> Model:
        own = [rows[i] for i in mine]
        ratios = log_count_ratios(own, labels[mine])
        w, bias = dual_coordinate_descent(own, labels[mine], ratios)
        return Model(w * ratios, ratios * ratios, bias, 1.0, 0.0)

    order, margins = np.random.default_rng(1).permutation(len(labels)), np.zeros(len(labels))
    for k in range(folds):
        held = order[k::folds]
        rest = np.setdiff1d(order, held)
        if labels[rest].min() < labels[rest].max():
            part = trained(rest)
            margins[held] = [part.margin(rows[i]) for i in held]
    model = trained(np.arange(len(labels)))
    model.slope, model.offset = _platt(margins, labels)
    return model


def fit_table(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fits on (doc_id, text) and (doc_id, label 0 or 1); features are made where the texts are."""
    marks = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    marks = marks.filter((F.col("label") == F.col("_other")) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # bounded, so it may be broadcast
    wanted = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")
    one = wanted.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # repeated ids end here, before anything gathers them

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "slots": [features(t).tobytes() for t in pdf["text"]]})
        give_back()

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(d, y, np.frombuffer(x, np.int32)) for pdf in batches for d, y, x in zip(pdf["doc_id"].tolist(), pdf["label"].tolist(), pdf["slots"], strict=True)]
        parts.sort(key=lambda p: p[0])
        m = fit([x for *_, x in parts], np.array([y for _, y, _ in parts], int))
        parts.clear()
        give_back()
        yield pd.DataFrame({"weights": [m.weights.astype("<f4").tobytes()], "squares": [m.squares.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    spread = one.repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    made = spread.mapInPandas(slots, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, slots binary").repartition(1)  # ``most_rows`` rows at most
    found = made.mapInPandas(fitted, "weights binary, squares binary, bias double, slope double, offset double").first()
    if found is None:
        return fit([], np.zeros(0, int))
    return Model(np.frombuffer(found["weights"], "<f4"), np.frombuffer(found["squares"], "<f4"), found["bias"], found["slope"], found["offset"])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score for each whole text, in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.squares.astype(np.float32), model.bias, model.slope, model.offset))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t or "") for t in batch.column("text").to_pylist()]
            yield batch.append_column(column, pa.array(scores, pa.float64()))
        give_back()

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != column) + f", `{column}` double"
    return docs.drop(column).mapInArrow(scored, schema)
