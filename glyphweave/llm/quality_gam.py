"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature, in cycles, on binned text
statistics; each feature's trees sum to one lookup table and each chosen pair's to
one two-way table. A score is the sum of the tables' entries, looked up for whole
batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweave.llm import texthash
from glyphweave.llm.labelled import SAMPLE_ROWS, labelled_sample

FEATURES = [
    "log_words",
    "mean_word_bytes",
    "letter_share",
    "capital_share",
    "digit_share",
    "symbol_share",
    "bare_symbol_words",
    "symbol_ended_words",
    "distinct_word_share",
    "top_word_share",
    "echo_share",
    "repeated_shingle_share",
    "lines_per_word",
    "stops_per_word",
    "capital_word_share",
]
_CLASS = np.zeros(256, np.int8)  # 0 other control, 1 lower or non-ASCII, 2 capital, 3 digit, 4 symbol, 5 space
_CLASS[33:127] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = 2
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_PLAIN_ENDS = np.zeros(256, bool)
_PLAIN_ENDS[[ord(c) for c in ".,;:?!)\"'"]] = True


def _raw_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(texts, "")
    for row, end, buf, offs in texthash.chunks(texts, fold=False):
        yield end - row, buf, offs


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty or null text has zeros."""
    made = [np.zeros((0, len(FEATURES)))]
    for rows, buf, offs in _raw_chunks(texts):
        starts, ends, before = texthash.spans(buf, offs, texthash.NOT_SPACE)
        kinds = _CLASS[buf]
        at = np.repeat(np.arange(rows), np.diff(offs))
        by_kind = np.bincount(at * 6 + kinds, minlength=rows * 6).reshape(rows, 6).astype(float)
        words = np.diff(before).astype(float)
        some = np.maximum(words, 1)
        solid = np.maximum(by_kind[:, 1:5].sum(1), 1)
        letters = np.maximum(by_kind[:, 1] + by_kind[:, 2], 1)
        out = np.zeros((rows, len(FEATURES)))
        out[:, 0] = np.log2(1 + words)
        out[:, 1] = by_kind[:, 1:5].sum(1) / some
        out[:, 2] = letters / solid
        out[:, 3] = by_kind[:, 2] / letters
        out[:, 4] = by_kind[:, 3] / solid
        out[:, 5] = by_kind[:, 4] / solid
        of = np.repeat(np.arange(rows), np.diff(before))
        if len(starts):
            wordy = np.concatenate([[0], np.cumsum(kinds < 4)])
            bare = wordy[ends] == wordy[starts]
            odd_end = (kinds[ends - 1] == 4) & ~_PLAIN_ENDS[buf[ends - 1]]
            out[:, 6] = np.bincount(of, bare, rows) / some
            out[:, 7] = np.bincount(of, odd_end & ~bare, rows) / some
            out[:, 14] = np.bincount(of, kinds[starts] == 2, rows) / some
            hashes = texthash.hash_words(buf, starts, ends)
            echo = np.zeros(len(hashes), bool)
            echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
            out[:, 10] = np.bincount(of, echo, rows) / some
            for k in np.flatnonzero(words).tolist():
                mine = np.sort(hashes[before[k] : before[k + 1]])
                edge = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]]))
                out[k, 8] = (len(edge) - 1) / len(mine)
                out[k, 9] = np.diff(edge).max() / len(mine)
                runs = texthash.shingle_hashes(hashes[before[k] : before[k + 1]], 3)
                out[k, 11] = 1 - len(np.unique(runs)) / len(runs)
        line, stop = np.bincount(at, buf == 10, rows), np.bincount(at, buf == 46, rows)
        out[:, 12], out[:, 13] = line / some, stop / some
        made.append(out)
    return np.concatenate(made)


@dataclass
class GamModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad / (hess + 1.0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values, bin by bin, of a greedy tree over one feature's gradient histogram."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(cuts) <= leaves:
        found = [
            (gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + 1, b)
        ]
        best = max(found, default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _step(g[b] - g[a], h[b] - h[a])
    return out


def _cross(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree that cuts each of two features once."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    gr, hr, gc, hc, ga, ha = g[:, -1:], h[:, -1:], g[-1:, :], h[-1:, :], g[-1, -1], h[-1, -1]
    q = lambda x, y: x**2 / (y + 1.0)
    total = q(g, h) + q(gr - g, hr - h) + q(gc - g, hc - h) + q(ga - gr - gc + g, ha - hr - hc + h)
    i, j = np.unravel_index(np.argmax(total), total.shape)
    out = np.empty(grad.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _step(grad[rows, cols].sum(), hess[rows, cols].sum())
    return out, float(total[i, j] - q(ga, ha))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, pairs: int = 6, bins: int = 32, rate: float = 0.3) -> GamModel:
    """Boost in cycles over the features, then over the pairs that still explain most.

    Without rows of both labels the model is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    quant = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, k], quant)) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    model = GamModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    cells = model.bins(x)
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(cells[:, k], g, len(table)), np.bincount(cells[:, k], h, len(table)), 3)
            table += step
            raw += step[cells[:, k]]

    def plane(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(model.tables[a]), len(model.tables[b]))
        flat = cells[:, a] * shape[1] + cells[:, b]
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    gains = {(a, b): _cross(*plane(a, b))[1] for a, b in combinations(range(len(FEATURES)), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _cross(*plane(a, b))[0]
            table += step
            raw += step[cells[:, a], cells[:, b]]
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> GamModel:
    """Fit on at most `rows` labelled documents for which `usable` (a condition on doc_id) holds.

    Features are computed where the texts are; only their numbers come to the driver.
    """
    sample = labelled_sample(docs, labels, "quality", usable, rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], names=["x", "y"])

    found = sample.mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = found["y"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, y]).T[::-1]) if len(y) else np.zeros(0, int)
    return fit(x[order], y[order])


def score(docs: DataFrame, model: GamModel, threshold: float = 0.3) -> DataFrame:
    """Add score (double) and predicted (1 if score >= threshold) to every row of `docs`.

    Only the text is looked at; a null text scores as the empty text. Columns named
    score or predicted are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(text_features(batch.column("text").cast(pa.large_string())))
            new = {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return rows.mapInArrow(add, rows.schema)

