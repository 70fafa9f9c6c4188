"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import chunks, distinct
from vahi.llm.labelled import is_held_out, training_rows

#: n-gram lengths, hashed slots (a power of two), training documents of each label at most, and n-grams that get a weight at most.
LENGTHS, SLOT_BITS, MOST_EACH, MOST_FEATURES = (3, 4, 5, 6), 18, 6000, 2048
SLOTS = 1 << SLOT_BITS
#: Slots of one part of the count vectors, and the passes, rate and ridge of the descent.
PART, STEPS, RATE, RIDGE = 4096, 200, 0.02, 1e-3
#: Odd multipliers of the n-gram hash, one a position, and one to spread it.
_BY_PLACE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_SPREAD = np.uint32(0x2C1B3C6D)


def gram_slots(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each n-gram length the slot at every character of the joined texts, the bounds of the texts there, and the length.

    Texts are lower-cased, runs of white space are one space, and a space stands at both ends. A gram at the end of a text may reach into the next one:
    callers drop those with `inside`.
    """
    clean = [f" {' '.join(x.lower().split())} " if x else " " for x in texts]
    code = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in clean])))
    total = None
    for place in range(max(LENGTHS)):
        n = place + 1
        if n > len(code):
            return
        next_ = code[place:] * _BY_PLACE[place]
        total = next_ if total is None else total[: len(next_)] + next_
        if n in LENGTHS:
            h = (total ^ (total >> np.uint32(15))) * _SPREAD + np.uint32(n)
            h ^= h >> np.uint32(13)
            h *= _BY_PLACE[0]
            yield (h >> np.uint32(32 - SLOT_BITS)).astype(np.int32), bounds, n


def text_grams(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, slot) pairs; wanted: a mask of the slots that matter."""
    found = []
    for slots, bounds, n in gram_slots(texts):
        at = np.arange(len(slots)) if wanted is None else np.flatnonzero(wanted[slots])
        text = np.searchsorted(bounds, at, side="right") - 1
        inside = at + n <= bounds[text + 1]
        found.append(text[inside] * SLOTS + slots[at[inside]])
    both = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // SLOTS, both % SLOTS


@dataclass(frozen=True)
class Model:
    """Weight of each slot and the intercept; its size is fixed by SLOT_BITS."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, slot = text_grams(texts, self.weights != 0)
        total = np.bincount(text, self.weights[slot], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _counts(rows: DataFrame) -> np.ndarray:
    """In how many rows of each label each slot occurs: an array of 2 x SLOTS. Tasks send vectors in parts, which are summed by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        for part in chunks(batches, "text"):
            y = part.column("y").to_numpy(zero_copy_only=False)
            text, slot = text_grams(part.column("text").to_pylist())
            for k in (0, 1):
                total[k] += np.bincount(slot[y[text] == k], minlength=SLOTS)
        for k in range(0, SLOTS, PART):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([total[:, k : k + PART].astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in group.column("counts"))
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((2, SLOTS))
    for r in rows.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # 2 x SLOTS numbers
        out[:, r.part : r.part + PART] = np.frombuffer(r.counts, "<i8").reshape(2, -1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_each: int = MOST_EACH) -> Model:
    """Train on at most most_each labelled documents of each label that aren't held out.

    The log-count ratio r of a slot is log of its smoothed share among toxic documents over that among clean ones. The slots with the strongest evidence keep a feature,
    whose value is r where the slot occurs; logistic regression with rows weighted back to the labels' true shares gives its weight.
    """
    rows, weight = training_rows(docs, labels, label, most_each)
    have = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(have) < 2:  # nothing to tell apart
        return Model(np.zeros(SLOTS), 30.0 if have.get(1) else -30.0 if have else 0.0)
    counts = _counts(rows)
    share = (counts + 1) / (np.array([[have[0]], [have[1]]]) + 2)
    ratio = np.log(share[1] / share[0])
    evidence = _g_squared(counts, np.array([[have[0]], [have[1]]])) * (counts.sum(0) >= 3)
    chosen = np.argsort(-evidence, kind="stable")[:MOST_FEATURES]
    chosen = np.sort(chosen[evidence[chosen] > 0])
    wanted = np.zeros(SLOTS, bool)
    wanted[chosen] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            text, slot = text_grams(part.column("text").to_pylist(), wanted)
            edges = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.record_batch([part.column("y"), pa.ListArray.from_arrays(edges.astype(np.int32), slot.astype(np.int32))], names=["y", "slots"])

    got = rows.mapInArrow(features, "y int, slots array<int>").toArrow().combine_chunks()  # the bounded sample, chosen slots only
    slots = got.column("slots").combine_chunks()
    slot = np.asarray(slots.flatten())
    row = np.repeat(np.arange(len(slots)), np.diff(np.asarray(slots.offsets)))
    y = np.asarray(got.column("y")).astype(float)
    w = np.where(y == 1, weight[1], weight[0])
    return Model(*_logistic(np.searchsorted(chosen, slot), row, ratio[chosen], y, w / w.sum(), chosen))


def _g_squared(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of each slot's occurrence against the label."""
    total = 0.0
    for seen, whole in ((counts, counts.sum(0)), (rows - counts, rows.sum() - counts.sum(0))):
        expected = whole * rows / rows.sum()
        total = total + 2 * np.sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0), axis=0)
    return total


def _logistic(feature: np.ndarray, row: np.ndarray, ratio: np.ndarray, y: np.ndarray, w: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    """Whole-batch Adam on the weighted log loss with a ridge; the last coefficient is the intercept."""
    value, m = ratio[feature], len(ratio)
    beta, mean, square = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    beta[m] = np.log((w @ y + 1e-9) / (w @ (1 - y) + 1e-9))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, beta[feature] * value, len(y)) + beta[m]
        error = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.append(np.bincount(feature, error[row] * value, m) + RIDGE * beta[:m], error.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        beta = beta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(SLOTS)
    weights[chosen] = beta[:m] * ratio
    return weights, float(beta[m])


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts are scored as one space. Null and repeated doc_ids are rows of their own; a null id is not held out. An empty table gives no rows.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(shared.value.scores(part.column("text").to_pylist()))], names=["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield part.filter(pa.array(shared.value.scores(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)
