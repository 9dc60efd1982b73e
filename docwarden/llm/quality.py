"""Quality of documents: word and line statistics, fixed rules, and gradient-boosted trees over the statistics.

Trees are grown on histograms of a bounded sample of labelled rows, with monotonic constraints on chosen
statistics (more symbols, repeated lines or repeated words never raise a document's score), and flattened into
node arrays, over which all rows of a batch walk down together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import sample_labelled
from .text_bytes import U64, mix64, row_chunks, runs, words_of, worker_cache

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and the sign of their influence: 0 free, -1 never raises the score.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": 0,
    "punctuation_share": 0,
    "other_share": 0,
    "line_words": 0,
    "longest_word": 0,
}
MAX_ROWS = 20_000
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Bit sets per byte: 1 starts a character, 2 symbol, 4 upper case, 8 digit, 16 punctuation, 32 beyond ASCII, 64 line end."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] |= (b & 0xC0 != 0x80) | 2 * (b in _SYMBOLS) | 4 * ("A" <= c <= "Z") | 8 * ("0" <= c <= "9") | 64 * (b == 10)
        out[b] |= 16 * (b < 128 and c.isprintable() and not c.isalnum() and c != " " and b not in _SYMBOLS) | 32 * (b >= 0xC0)
    return out


def _sums(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def batch_statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts, and the matrix of :data:`FEATURES`, of a column of texts."""
    w = words_of(column)
    rows = len(column)
    n_words = np.diff(w.first)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    kind = worker_cache("quality_classes", _classes)[w.data]
    starts = np.zeros(len(kind) + 1, dtype=np.int64)
    np.cumsum(kind & 1, out=starts[1:])
    chars = starts[w.end] - starts[w.start]  # of each word
    word_chars = _sums(chars, w.first)
    symbols, upper, digits, points, other = (_sums((kind & bit) > 0, bounds) for bit in (2, 4, 8, 16, 32))
    lines, dup_lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(rows):
        if n_words[i]:
            worded = [x for x in w.data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines[i], dup_lines[i] = len(worded), len(worded) - len(set(worded))
    row = np.repeat(np.arange(rows), n_words)
    repeat = np.zeros(len(row), dtype=bool)
    three = runs(w.name, 3)
    if len(three):
        inside = np.flatnonzero(row[: len(three)] == row[2:])
        with np.errstate(over="ignore"):
            key = mix64(three[inside] + mix64(row[inside].astype(U64)))
        _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        again = inside[n[where] > 1]
        for k in range(3):
            repeat[again + k] = True
    repeat_words = _sums(repeat, w.first)
    with np.errstate(over="ignore"):
        own = np.unique(mix64(w.name + mix64(row.astype(U64) + U64(1))), return_index=True)[1]
    distinct = np.bincount(row[own], minlength=rows)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, row, chars)
    words, length = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    x = np.stack(
        [
            np.log1p(n_words),
            word_chars / words,
            symbols / words,
            dup_lines / np.maximum(lines, 1),
            repeat_words / words,
            distinct / words,
            upper / length,
            digits / length,
            points / length,
            other / length,
            n_words / np.maximum(lines, 1),
            np.log1p(longest),
        ],
        axis=1,
    )
    return dict(zip(COUNTS, (n_words, word_chars, symbols, dup_lines, repeat_words))), x


class Trees(NamedTuple):
    """All trees in five arrays; a leaf is its own child.  Scores are log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float


def grow_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: float = 10.0) -> Trees:
    """Boosted trees for the logistic loss; rows go left if the feature is at most the threshold.

    With sign s of a feature, s times the value of a right child is never below that of the left one, at any depth.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    feature, threshold, left, right, value, root = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        top = node(float(np.clip(-g.sum() / (h.sum() + ridge), -4, 4)))
        root.append(top)
        level = [(top, np.arange(n), -np.inf, np.inf)]
        leaves = []
        for d in range(depth + 1):
            below = []
            for at, rows, low, high in level:
                best = None
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in range(m if d < depth and len(rows) >= 2 * least else 0):
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(code[rows, f], minlength=len(cuts[f]) + 1))[:-1]
                    if not len(gl):
                        continue
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
                    ok = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > (best[0] if best else gs**2 / (2 * (hs + ridge)) + 1e-9):
                        best = (gain[k], f, k, vl[k], vr[k])
                if best is None:
                    leaves.append((at, rows))
                    continue
                _, f, k, vl, vr = best
                feature[at], threshold[at] = f, float(cuts[f][k])
                left[at], right[at] = node(float(vl)), node(float(vr))
                middle = (vl + vr) / 2
                goes = code[rows, f] <= k
                lows = {-1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high)), 0: ((low, high), (low, high))}[signs[f]]
                below += [(left[at], rows[goes], *lows[0]), (right[at], rows[~goes], *lows[1])]
            level = below
        for at, rows in leaves:
            z[rows] += rate * value[at]
    arrays = (np.array(v) for v in (feature, threshold, left, right, value, root))
    f, t, a, b, v, r = arrays
    return Trees(f.astype(np.int64), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float) * rate, r.astype(np.int64), depth, base)


def score_rows(t: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of the label 1 for each row of statistics."""
    z = np.full(len(x), t.base)
    rows = np.arange(len(x))
    for top in t.root:
        at = np.full(len(x), top)
        for _ in range(t.depth):
            at = np.where(x[rows, t.feature[at]] <= t.threshold[at], t.left[at], t.right[at])
        z += t.value[at]
    return 1 / (1 + np.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees that predict ``label`` from the statistics of at most about ``max_rows`` labelled documents.

    Only the sample's statistics (a dozen numbers a row) reach the driver.  Null texts count as empty ones;
    of several labels of an id the lowest counts.  Without labels the score is one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            x = batch_statistics(batch.column("_text"))[1]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("_y")], names=["x", "y"])

    rows = sample_labelled(docs, labels, key, text, label, max_rows, highest=False)
    table = rows.mapInArrow(run, "x array<double>, y int").toArrow().combine_chunks()
    y = np.asarray(table.column("y")).astype(float)
    flat = table.column("x").combine_chunks()
    x = np.asarray(flat.flatten() if len(y) else np.zeros(0)).reshape(len(y), len(FEATURES))
    order = np.lexsort(np.column_stack([x, y]).T[::-1])  # the same trees whatever the order of rows
    return grow_trees(x[order], y[order], list(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: Trees, text: str = "text", cut: float = 0.5) -> DataFrame:
    """Add the five counts, ``base_failed``, ``quality_score`` and ``kept`` to each document.

    ``base_failed``: under 50 words, or over half of the words lie in three-word windows that occur twice or
    more.  ``kept``: not so, and a score of at least ``cut``.  Null texts have no words, as empty ones.  Rows,
    also repeated ones, are kept one to one with all other columns; columns that have the name of a new one are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(trees))
    new = [*COUNTS, "base_failed", "quality_score", "kept"]
    rest = docs.drop(*new)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{c} long" for c in COUNTS] + ["base_failed boolean, quality_score double, kept boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, text):
            counts, x = batch_statistics(batch.column(text))
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = score_rows(Trees(*shared.value), x)
            arrays = [*(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cut))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return rest.mapInArrow(run, ", ".join(fields))
