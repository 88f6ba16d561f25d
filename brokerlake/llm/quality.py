"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins and has a table of one number per bin. The tables are learned by
boosting in turn: round after round, every feature gets a shallow tree on the present residuals and
adds it to its own table, so no feature can take what another explains as well. Then the pairs whose
residuals a cross of two cuts explains best get tables of two dimensions in the same way. A score
is the logistic of an intercept plus one look-up per feature and pair: vectorised additions.

The features come from the text alone. The model learns from at most ``FIT_ROWS`` labelled
documents, chosen by hash of the id; documents with contradicting labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, texts

#: Labelled documents that the model learns from.
FIT_ROWS = 20_000
#: The least score of a document that is kept.
THRESHOLD = 0.3
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.15
BINS, PAIR_BINS = 48, 12

FEATURES = (
    "chars", "words", "lines", "word_length", "line_length", "distinct_words", "repeats_next",
    "top_word", "distinct_lines", "upper", "digits", "blanks", "exclaims", "bars", "symbols",
    "stops", "other_marks", "beyond_ascii", "upper_words", "short_words", "mark_ends", "longest",
)


def text_features(text: str) -> list[float]:
    """``FEATURES`` of a whole text; the empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    filled = [line for line in lines if line.strip()]
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)

    def share(marks: str) -> float:
        return float(counts[list(marks.encode())].sum()) / size

    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        float(lengths.sum()) / n, float(np.log1p(len(text) / len(lines))), len(seen) / n,
        sum(map(eq, words, words[1:])) / n, max(seen.values(), default=0) / n,
        len(set(filled)) / max(len(filled), 1), float(counts[65:91].sum()) / letters,
        float(counts[48:58].sum()) / size, share(" \t\n\r"), share("!"), share("|"),
        share("#$%&*<>=@\\^_`{}~[]"), share(".?"), share(",;:'\"()-/+"),
        float(counts[128:].sum()) / size, sum(map(str.isupper, words)) / n,
        float((lengths <= 3).sum()) / n, float(((counts[33:48].sum()) + counts[58:65].sum()) / n),
        float(np.log1p(lengths.max())) if len(words) else 0.0,
    ]


def feature_matrix(batch: list[str]) -> np.ndarray:
    return np.array([text_features(text) for text in batch], float).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Cuts and tables of each feature and each pair of features."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for cut, table, column in zip(self.cuts, self.tables, rows.T):
            total += table[np.searchsorted(cut, column, "left")]
        coarse = [np.searchsorted(c, col, "left") for c, col in zip(self.pair_cuts, rows.T)]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _tree_1d(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """The step of each bin by a tree of ``depth`` levels on sums of slope and curvature."""
    step = np.full(len(g), g.sum() / (h.sum() + penalty))
    if depth == 0 or len(g) < 2:
        return step
    gs, hs = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gs**2 / (hs + penalty) + (g.sum() - gs) ** 2 / (h.sum() - hs + penalty)
    cut = int(gain.argmax()) + 1
    return np.concatenate([
        _tree_1d(g[:cut], h[:cut], depth - 1, penalty), _tree_1d(g[cut:], h[cut:], depth - 1, penalty)
    ])


def _cross(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis: its gain, and the step of each cell."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        low, right, down, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, right - low, down - low, whole - right - down + low]

    qg, qh = quarters(gc), quarters(hc)
    gain = sum(a**2 / (b + penalty) for a, b in zip(qg, qh))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = [float(a[i, j] / (b[i, j] + penalty)) for a, b in zip(qg, qh)]
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :] = steps[0], steps[1]
    table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = steps[2], steps[3]
    return float(gain[i, j] - gc[-1, -1] ** 2 / (hc[-1, -1] + penalty)), table


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between values that occur, at even shares of the rows."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS,
        n_pairs: int = PAIRS, rate: float = RATE, penalty: float = 5.0) -> AdditiveModel:
    """Cyclic boosting of single features, then of the strongest pairs, by the logistic loss.

    Without rows of both labels the model is its intercept alone.
    """
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    width = rows.shape[1]
    cuts = [_cuts(c, BINS) if len(c) else np.zeros(0) for c in rows.T]
    coarse = [_cuts(c, PAIR_BINS) if len(c) else np.zeros(0) for c in rows.T]
    model = AdditiveModel(
        float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts],
        [], coarse, [],
    )
    if len(np.unique(labels)) < 2:
        return model
    bins = [np.searchsorted(c, col, "left") for c, col in zip(cuts, rows.T)]
    margin = np.full(len(rows), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            size = len(cuts[k]) + 1
            step = rate * _tree_1d(
                np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), 2, penalty
            )
            model.tables[k] += step
            margin += step[bins[k]]
    low = [np.searchsorted(c, col, "left") for c, col in zip(coarse, rows.T)]
    shapes = [len(c) + 1 for c in coarse]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = low[i] * shapes[j] + low[j]
        shape = (shapes[i], shapes[j])
        size = shape[0] * shape[1]
        return (cell, np.bincount(cell, g, size).reshape(shape),
                np.bincount(cell, h, size).reshape(shape))

    g, h = slopes()
    gains = {(i, j): _cross(*grids(i, j, g, h)[1:], penalty)[0]
             for i, j in combinations(range(width), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            cell, gs, hs = grids(i, j, g, h)
            step = rate * _cross(gs, hs, penalty)[1]
            table += step
            margin += step.ravel()[cell]
    return model


def fold(name: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(name.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on at most ``fit_rows`` documents whose fold is not 0 and whose label is known.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (0 or 1). Rows without id, label or
    text, and ids with both labels, teach nothing. Everything but those rows' features stays on
    the executors.
    """
    prepare(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where((fold(F.col("doc_id")) != 0) & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_label"))
        .where("_low = _label").orderBy(*order).limit(fit_rows).select("doc_id", "_label")
    )

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = feature_matrix(texts(batch.column("text"))).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"),
                 pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "row"]
            )

    chosen = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(
        F.broadcast(known), "doc_id"  # at most fit_rows rows of two numbers
    )
    taught = (
        chosen.select("doc_id", "_label", "text")
        .mapInArrow(measure, "doc_id long, label int, row array<double>")
        .orderBy(*order, "row").limit(fit_rows).collect()
    )
    rows = np.array([r.row for r in taught], float).reshape(-1, len(FEATURES))
    return fit(rows, np.array([r.label for r in taught], float))


def with_score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of its ``text``; all columns stay. NULL scores as the empty text."""
    prepare(docs.sparkSession)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = model.score(feature_matrix(texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, name]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{kinds}, `{name}` double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    A NULL doc_id counts as held out; repeated rows are scored alike; an empty table gives an empty
    result. Other columns are ignored.
    """
    model = learn(docs, labels)
    rows = with_score(docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text"), model)
    return rows.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
