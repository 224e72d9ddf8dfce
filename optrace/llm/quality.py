"""Operator 4: quality verdicts from base counts and a hashed n-gram logistic regression.

Features are hashed word uni- and bigrams and character bi- to tetragrams, as square roots of
their shares (so a text's vector has length 1). The model is fitted in one task on a bounded
sample of labelled rows, and Platt-calibrated on a part of the sample kept out of the fit. Texts
are counted and scored in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optrace.llm.common import hashed_words, mixed, sampled, slices

#: Labelled rows used at most; the documented bound of the training sample.
SAMPLE = 4000
SIZE = 1 << 15
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50  # words, per cent of the words
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
ROUNDS, PENALTY = 120, 3e-5


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def vector(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashed n-gram shares of a whole text, square-rooted; zeros for a text without characters."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams, parts = codes + np.uint64(1), []
    for n in (2, 3, 4):
        if len(codes) < n:
            break
        grams = grams[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        parts.append(grams)
    words = hashed_words(text.encode().split())
    parts += [words, words[:-1] * np.uint64(31) + words[1:]]
    hashed = (mixed(np.concatenate(parts)) & np.uint64(size - 1)).astype(np.int64)
    return np.sqrt(np.bincount(hashed, minlength=size) / max(1, len(hashed)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [vector(x) for x in part.column("text").to_pylist()]
            places = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array([x.astype(np.uint16).tobytes() for x in places], pa.binary()),
                 pa.array([x[p].astype(np.float32).tobytes() for x, p in zip(found, places)], pa.binary())],
                ["doc_id", "label", "places", "shares"],
            )


def fit_logistic(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> np.ndarray:
    """Weights and, last, the intercept: L2-penalised, classes weighted alike, accelerated gradient."""
    owner = np.repeat(np.arange(len(vectors)), [len(p) for p, _ in vectors])
    place = np.concatenate([p for p, _ in vectors]).astype(np.int64)
    share = np.concatenate([s for _, s in vectors]).astype(np.float64)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    now = ahead = np.zeros(size + 1)
    step = 6.0
    for turn in range(ROUNDS):
        margin = np.bincount(owner, ahead[place] * share, len(vectors)) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-margin)) - labels)
        slope = np.append(np.bincount(place, error[owner] * share, size) + PENALTY * ahead[:-1], error.sum())
        new = ahead - step * slope
        ahead, now = new + turn / (turn + 3) * (new - now), new
    return now


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    if len(margins) == 0 or labels.min() == labels.max():
        return 1.0, 0.0
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, float(np.abs(margins).max()))
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    at = np.zeros(2)
    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - target @ z
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (p - target)
        turn = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * turn) > loss(at):
            size /= 2
        at = at - size * turn
        if np.abs(size * turn).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [x for batch in batches for x in batch.to_pylist()]
    rows.sort(key=lambda x: x["doc_id"])
    data = [(np.frombuffer(x["places"], np.uint16), np.frombuffer(x["shares"], np.float32)) for x in rows]
    labels = np.array([x["label"] for x in rows], np.float64)
    if len(rows) < 2 or labels.min() == labels.max():
        weights, slope, offset = np.zeros(SIZE + 1), 0.0, 4.0 if not len(rows) or labels[0] else -4.0
    else:
        out = np.arange(len(rows)) % 4 == 3
        fit = ~out
        if labels[fit].min() == labels[fit].max():
            fit = np.ones(len(rows), bool)
        weights = fit_logistic([x for x, use in zip(data, fit) if use], labels[fit], SIZE)
        margins = np.array([weights[p.astype(np.int64)] @ s + weights[-1] for p, s in data])
        slope, offset = platt(margins[out], labels[out])
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])], ["weights", "slope", "offset"]
    )


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model of the labelled documents: weights, slope and offset. labels has (doc_id, quality);
    of rows that contradict each other the lower quality counts. Without labelled documents of
    both kinds the model's verdict is constant."""
    one = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = sampled(one, "doc_id", sample, "quality")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("label").cast("long").alias("label"))
    vectors = found.mapInArrow(_vectors, "doc_id long, label long, places binary, shares binary")
    row = vectors.repartition(1).mapInArrow(_train, "weights binary, slope double, offset double").first()
    if row is None:
        return {"weights": np.zeros(SIZE + 1).tobytes(), "slope": 0.0, "offset": 4.0}
    return {"weights": bytes(row["weights"]), "slope": row["slope"], "offset": row["offset"]}


def _verdicts(model: dict, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model["weights"])
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    counts = base_counts(text)
                    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
                    margin = vector(text) @ weights[:-1] + weights[-1]
                    p = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -500, 500)))
                    rows.append((*counts, failed, float(p), bool(not failed and p >= threshold)))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))], [*part.schema.names, *names]
                )

    return run


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
VERDICT_NAMES = [x.split()[0] for x in VERDICT.split(", ")]


def quality_verdicts(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of documents with base counts, base_failed, the model's probability of good
    quality and kept (base rules passed and probability at least threshold). Columns that bear
    a result's name are replaced. A null text counts as empty: it fails the base rules."""
    documents = documents.drop(*VERDICT_NAMES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(_verdicts(model, threshold), f"{schema}, {VERDICT}")
