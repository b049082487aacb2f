"""Operator 1, quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a fixed vector of counts and shares. Boosting goes round the features in turn; in each turn a
shallow tree over one feature's bins is fitted to the logistic loss and added, damped, to that feature's lookup
table. Then the pairs of features with the most left to explain get two-dimensional tables in the same way. A text's
score is the sum of its bins' table entries, so scoring is one gather per table over whole Arrow batches.

Edge cases: null and empty texts have the vector of zeros and get a score like any other; a null doc_id is scored but
never learned from; labels that are null are left out, several labels of one doc_id count as their maximum; rows that repeat
are scored each; an empty table gives an empty result; without a usable label of both kinds the score is the share of label 1
(0.5 with none). Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

#: Rows at most that the model is fitted on: the labelled rows with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("log_words", "log_bytes", "word_bytes", "upper", "digits", "symbols", "marks", "shouts", "wide", "distinct", "top_word", "echo", "twice_lines", "line_words", "short_words", "marked_words", "bare_marks", "repeat_windows")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~=@_/")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:?!\"'()-")] = True


def features(t: textbytes.Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, data = len(t), t.data
    w = textbytes.words(t)
    size = np.diff(t.at).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[t.at[1:]] - sums[t.at[:-1]]).astype(float)

    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    upper = _UPPER[data] | (lead & (data < 0x9F))
    letters = total(_LETTER[data] | (data >= 0xC3))
    count = np.bincount(w.doc, minlength=n).astype(float)
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    width = (w.end - w.begin).astype(float)
    doc, _, often = textbytes.counted(w.doc, w.hash)
    top = np.zeros(n)
    np.maximum.at(top, doc, often)
    echo = np.zeros(n)
    if len(w) > 1:
        same = (w.doc[1:] == w.doc[:-1]) & (w.hash[1:] == w.hash[:-1])
        echo = np.bincount(w.doc[1:][same], minlength=n).astype(float)
    rows = textbytes.lines(t, w)
    row_doc, _, row_often = textbytes.counted(rows.doc, rows.hash)
    n_lines = np.bincount(rows.doc, minlength=n).astype(float)
    repeats = np.bincount(row_doc, weights=row_often - 1, minlength=n)
    win_doc, win = textbytes.windows(w, 3)
    win_doc, _, win_often = textbytes.counted(win_doc, win)
    wins = np.bincount(win_doc, weights=win_often, minlength=n)
    twice = np.bincount(win_doc, weights=np.where(win_often > 1, win_often, 0), minlength=n)
    marked = _MARK[data[w.end - 1]] if len(w) else np.zeros(0, bool)
    bare = ((width == 1) & ~_LETTER[data[w.begin]] & ~_DIGIT[data[w.begin]]) if len(w) else marked
    return np.column_stack([
        np.log1p(count),
        np.log1p(size),
        np.bincount(w.doc, weights=width, minlength=n) / per_word,
        total(upper) / np.maximum(letters, 1),
        total(_DIGIT[data]) / per_byte,
        total(_SYMBOL[data]) / per_word,
        total(_MARK[data]) / per_word,
        total(data == 33) / per_word,
        total(data >= 0xC4) / per_byte,
        np.bincount(doc, minlength=n) / per_word,
        top / per_word,
        echo / per_word,
        repeats / np.maximum(n_lines, 1),
        count / np.maximum(n_lines, 1),
        np.bincount(w.doc, weights=width <= 3, minlength=n) / per_word,
        np.bincount(w.doc, weights=marked, minlength=n) / per_word,
        np.bincount(w.doc, weights=bare, minlength=n) / per_word,
        twice / np.maximum(wins, 1),
    ])


@dataclass
class Model:
    """Bin edges and tables: score = sigmoid(intercept + one entry of each table)."""

    edges: list[np.ndarray]
    intercept: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, entries in enumerate(self.single):
            out += entries[bins[:, k]]
        for a, b, entries in self.pairs:
            out += entries[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return np.divide(g, h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values, by bin, of the best tree of so many leaves, grown by the best cut of any leaf each time."""
    parts = [(0, len(g))]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best, found = 1e-9, None
        for lo, hi in parts:
            cut = np.arange(lo + 1, hi)
            if not len(cut):
                continue
            gl, hl, gr, hr = gs[cut] - gs[lo], hs[cut] - hs[lo], gs[hi] - gs[cut], hs[hi] - hs[cut]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + ridge)
            if gain.max() > best:
                best, found = gain.max(), (lo, hi, int(cut[gain.argmax()]))
        if not found:
            break
        lo, hi, mid = found
        parts = sorted([p for p in parts if p != (lo, hi)] + [(lo, mid), (mid, hi)])
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(gs[hi] - gs[lo], hs[hi] - hs[lo], ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of both features at once (four leaves)."""
    gs, hs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")

    def corners(s: np.ndarray) -> list[np.ndarray]:
        a, top, left = s[i, j], s[i, -1], s[-1, j]
        return [a, top - a, left - a, s[-1, -1] - top - left + a]

    gq, hq = corners(gs), corners(hs)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gq, hq, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    values = [_leaf(x[a, b], y[a, b], ridge) for x, y in zip(gq, hq, strict=True)]
    out = np.empty_like(g)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = values
    return float(gain[a, b] - g.sum() ** 2 / (h.sum() + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 24, rounds: int = 120, pair_count: int = 6, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> Model:
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Model([np.zeros(0)] * x.shape[1], float(np.log(share / (1 - share))), [np.zeros(1)] * x.shape[1])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, max_bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = y.mean()
    m = Model(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    bins = m.bins(x)
    margin = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for k, entries in enumerate(m.single):
            if len(entries) < 2:
                continue
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree(np.bincount(bins[:, k], y - p, len(entries)), np.bincount(bins[:, k], p * (1 - p), len(entries)), 3, ridge)
            entries += step
            margin += step[bins[:, k]]

    def squares(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        na, nb = len(edges[a]) + 1, len(edges[b]) + 1
        at = bins[:, a] * nb + bins[:, b]
        return np.bincount(at, y - p, na * nb).reshape(na, nb), np.bincount(at, p * (1 - p), na * nb).reshape(na, nb)

    ranked = sorted(((_cross(*squares(a, b), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2) if len(edges[a]) and len(edges[b])), reverse=True)
    m.pairs = [(a, b, np.zeros((len(edges[a]) + 1, len(edges[b]) + 1))) for gain, a, b in ranked[:pair_count] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, entries in m.pairs:
            step = rate * _cross(*squares(a, b), ridge)[1]
            entries += step
            margin += step[bins[:, a], bins[:, b]]
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fold, at most max_rows of them (their vectors, not their texts, reach the driver)."""
    common.require(docs, "doc_id", "text")
    common.require(labels, "doc_id", "quality")
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("y"))
        .where(common.trainable(F.col("doc_id"), 5, 0) & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_rows)
    )
    # the limit bounds what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    schema = "y int, " + ", ".join(f"{f} double" for f in FEATURES)
    names = ["y", *FEATURES]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                x = features(t)
                y = b.column("y").slice(t.first, len(t)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([y, *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=names)

    found: pd.DataFrame = rows.mapInArrow(lambda b: textbytes.released(vectors(b)), schema).toPandas().sort_values(names)  # in one order, whatever the tasks' order
    return fit(found[list(FEATURES)].to_numpy(float), found["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, score (and all columns of docs, if keep): every whole text."""
    common.require(docs, "doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*docs.columns) if keep else docs.select("doc_id", "text")
    given = [c for c in rows.columns if keep or c != "text"]
    out_name = "score"
    while out_name in given:
        out_name = f"_{out_name}"
    schema = rows.select(*[F.col(f"`{c}`") for c in given]).withColumn(out_name, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textbytes.chunks(b.column("text")):
                own = b.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in given), pa.array(held.value.score(features(t)))], names=[*given, out_name])

    return rows.mapInArrow(lambda b: textbytes.released(scored(b)), schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels, max_rows))
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    scored = score(docs, train(docs, labels, max_rows), keep=True)
    return scored.where(F.col(f"`{scored.columns[-1]}`") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
