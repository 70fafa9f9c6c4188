"""Quality: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import chunks
from vahi.llm.labelled import is_held_out, training_rows

#: Training documents of each label at most; trees, their depth and rate, bins of a statistic, rows a leaf needs, and the ridge of a leaf.
MOST_EACH, TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE = 10_000, 80, 4, 0.15, 64, 8, 1.0

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "top_word", "top_three_words", "next_repeats", "distinct_pairs", "top_pair",
    "log_lines", "line_chars", "distinct_lines", "top_line", "short_lines", "lines_ended", "letters", "digits", "capitals", "spaces", "commas_stops",
    "bars", "brackets", "other_signs", "wide_chars", "sentence_words", "capital_words", "digit_words", "short_words", "long_words", "longest_word", "squeezed",
    "char_entropy", "repeated_chars", "words_ended",
)
_CLASS = np.full(256, 7, np.int64)  # of a byte: 0 letter, 1 digit, 2 capital, 3 space, 4 comma or stop, 5 bar, 6 bracket, 7 other sign, 8 part of a wide character
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\x0b\f\r", b",.;:!?", b"|", b"()[]{}<>")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; an empty one has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)
    data = text.encode("utf-8", "replace")
    code = np.frombuffer(data, np.uint8)
    share = np.bincount(_CLASS[code], minlength=9) / len(code)
    seen = np.bincount(code, minlength=256) / len(code)
    seen = seen[seen > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    count = Counter(words)
    top = [c for _, c in count.most_common(3)]
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    same = Counter(lines)
    ends = sum(w[-1] in ".!?" for w in words)
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), len(count) / n, top[0] / n, sum(top) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1),
        float(np.log1p(len(lines))), float(np.log1p(len(text) / len(lines))), len(same) / len(lines), max(same.values()) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), sum(x.rstrip()[-1] in ".!?:" for x in lines) / len(lines), *share.tolist(),
        n / (ends + 1), sum(w[0].isupper() for w in words) / n, sum(any(map(str.isdigit, w)) for w in count) / len(count), float((lengths <= 3).mean()),
        float((lengths > 12).mean()), float(np.log1p(lengths.max())), len(zlib.compress(data, 1)) / len(data), float(-(seen * np.log2(seen)).sum()),
        float(np.count_nonzero(code[1:] == code[:-1]) / len(code)), ends / n,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(STATISTICS))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: the statistic and threshold of each inner node, the value of each leaf; node i has children 2i + 1 and 2i + 2."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for statistic, threshold, leaf in zip(self.statistic, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, statistic[node]] > threshold[node])
            total += leaf[node - len(statistic)]
        return total

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(_matrix(texts))))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Second-order boosting on the log loss; a level's gradients are summed to one histogram of (node, statistic, bin)."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(m)], axis=1)
    base = float(np.log((w @ y + 1e-9) / (w @ (1 - y) + 1e-9)))
    margin, inner = np.full(n, base), 2**DEPTH - 1
    trees: tuple[list, list, list] = ([], [], [])
    place = binned + np.arange(m) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        statistic, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (m * BINS) + place).ravel()
            of = [np.bincount(cell, np.repeat(v, m), many * m * BINS).reshape(many, m, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = of, [v[:, :, -1:] for v in of]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAF_ROWS) | (nt - nl < LEAF_ROWS)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for i, (k, b) in enumerate(zip(best // BINS, best % BINS, strict=True)):
                if gain[i, k, b] > 1e-6 and b < len(edges[k]):
                    statistic[first + i], threshold[first + i] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(n), statistic[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        margin = margin + leaf[at]
        for held, made in zip(trees, (statistic, threshold, leaf), strict=True):
            held.append(made)
    return Trees(base, *(np.array(t) for t in trees))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_each: int = MOST_EACH) -> Trees:
    """Train on at most most_each labelled documents of each label that aren't held out; their statistics are made by tasks, only those numbers are gathered."""
    rows, weight = training_rows(docs, labels, label, most_each)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            flat = _matrix(part.column("text").to_pylist())
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(describe, "doc_id long, y int, x array<double>").orderBy("doc_id").toArrow().combine_chunks()  # the bounded sample
    y = np.asarray(got.column("y")).astype(float)
    if len(set(y)) < 2:  # nothing to tell apart
        none = np.zeros((0, 1))
        return Trees(30.0 if y.any() else -30.0 if len(y) else 0.0, none, none, none)
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    return boost(x, y, np.where(y == 1, weight[1], weight[0]))


def quality(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts have statistics of zero and are scored like others. Null and repeated doc_ids are rows of their own; a null id is not held out.
    An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES x 2**DEPTH numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(shared.value.scores(part.column("text").to_pylist()))], names=["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
