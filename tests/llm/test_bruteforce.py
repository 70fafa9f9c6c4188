"""The classifiers' scores, a classifier's training steps and every row's shard, made again in plain Python over a whole table."""

import collections
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from vahi.llm import quality, queries, toxicity
from vahi.llm.common import documents, table


def texts():
    return {d["doc_id"]: d["text"] or "" for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


def plain_slots(text):
    clean = f" {' '.join(text.lower().split())} "
    out = set()
    for n in toxicity.LENGTHS:
        for at in range(len(clean) - n + 1):
            total = sum(ord(c) * int(m) for c, m in zip(clean[at : at + n], toxicity._BY_PLACE, strict=False)) % 2**32
            h = ((total ^ (total >> 15)) * int(toxicity._SPREAD) + n) % 2**32
            out.add(((h ^ (h >> 13)) * int(toxicity._BY_PLACE[0])) % 2**32 >> (32 - toxicity.SLOT_BITS))
    return out


def test_toxicity_scores_one_by_one(spark):
    docs = documents(spark, SMALL)
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    short = {k: t for k, t in texts().items() if len(t) < 4000}
    assert len(got) == len(texts()) and len(short) > 100
    for k, text in short.items():
        total = model.intercept + sum(float(model.weights[s]) for s in plain_slots(text))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
        assert got[k].predicted == (got[k].score >= 0.5) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_evidence_and_descent_in_plain_loops():
    rng = np.random.default_rng(1)
    counts, rows = rng.integers(0, 9, (2, 40)).astype(float), np.array([[30.0], [12.0]])
    for k in range(40):
        want = 0.0
        for y in (0, 1):
            for seen, whole in ((counts[y, k], counts[:, k].sum()), (rows[y, 0] - counts[y, k], 42 - counts[:, k].sum())):
                want += 2 * seen * math.log(seen / (whole * rows[y, 0] / 42)) if seen else 0
        assert toxicity._g_squared(counts, rows)[k] == pytest.approx(want, abs=1e-9)
    have = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(30)]
    y, ratio = [float(0 in x) for x in have], rng.normal(size=6)
    feature, row = np.concatenate(have), np.repeat(np.arange(30), [len(x) for x in have])
    weights, intercept = toxicity._logistic(feature, row, ratio, np.array(y), np.full(30, 1 / 30), np.arange(6))
    beta, mean, square = [0.0] * 7, [0.0] * 7, [0.0] * 7
    beta[6] = math.log((sum(y) / 30 + 1e-9) / (1 - sum(y) / 30 + 1e-9))
    for step in range(1, toxicity.STEPS + 1):
        gradient = [toxicity.RIDGE * b for b in beta[:6]] + [0.0]
        for x, label in zip(have, y, strict=True):
            error = (1 / (1 + math.exp(-sum(beta[f] * ratio[f] for f in x) - beta[6])) - label) / 30
            gradient[6] += error
            for f in x:
                gradient[f] += error * ratio[f]
        for f, g in enumerate(gradient):
            mean[f], square[f] = 0.9 * mean[f] + 0.1 * g, 0.99 * square[f] + 0.01 * g * g
            beta[f] -= toxicity.RATE * (mean[f] / (1 - 0.9**step)) / (math.sqrt(square[f] / (1 - 0.99**step)) + 1e-7)
    assert intercept == pytest.approx(beta[6], abs=1e-6) and weights[:6] == pytest.approx([b * r for b, r in zip(beta, ratio, strict=False)], abs=1e-6)


def plain_statistics(text):
    """Some two dozen of the statistics, each by itself."""
    words, data = text.split(), text.encode()
    if not words:
        return {"log_chars": math.log(1 + len(text)), "log_words": 0.0, "letters": 0.0, "char_entropy": 0.0}
    lengths, lines = [len(w) for w in words], [x for x in text.split("\n") if x.strip()]
    pairs, mean = list(zip(words, words[1:], strict=False)), sum(map(len, words)) / len(words)
    often = lambda xs: max(collections.Counter(xs).values(), default=0)
    part = lambda test: sum(map(test, data)) / len(data)
    entropy = -sum(n / len(data) * math.log2(n / len(data)) for n in collections.Counter(data).values())
    return {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(words)), "word_length": mean, "word_length_sd": math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(words)), "distinct_words": len(set(words)) / len(words),
        "top_word": often(words) / len(words), "top_three_words": sum(sorted(collections.Counter(words).values())[-3:]) / len(words), "next_repeats": sum(a == b for a, b in pairs) / len(words),
        "distinct_pairs": len(set(pairs)) / max(1, len(pairs)), "top_pair": often(pairs) / max(1, len(pairs)), "log_lines": math.log(1 + len(lines)), "distinct_lines": len(set(lines)) / len(lines), "top_line": often(lines) / len(lines),
        "short_lines": sum(len(x) < 30 for x in lines) / len(lines), "letters": part(lambda b: 97 <= b <= 122), "digits": part(lambda b: 48 <= b <= 57), "capitals": part(lambda b: 65 <= b <= 90),
        "spaces": part(lambda b: b in b" \t\n\x0b\f\r"), "bars": part(lambda b: b == 124), "wide_chars": part(lambda b: b > 127), "short_words": sum(n <= 3 for n in lengths) / len(words), "long_words": sum(n > 12 for n in lengths) / len(words),
        "longest_word": math.log(1 + max(lengths)), "squeezed": len(zlib.compress(data, 1)) / len(data), "char_entropy": entropy, "repeated_chars": sum(a == b for a, b in zip(data, data[1:], strict=False)) / len(data),
        "words_ended": sum(w.endswith((".", "!", "?")) for w in words) / len(words), "line_chars": math.log(1 + len(text) / len(lines)),
    }


def test_quality_statistics_and_scores_one_by_one(spark):
    docs = documents(spark, SMALL)
    model = quality.fit(docs, table(spark, SMALL, "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    assert len(got) == len(texts())
    for k, text in texts().items():
        values = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
        for name, want in plain_statistics(text).items():
            assert values[name] == pytest.approx(want, abs=1e-9), (k, name)
        x, total = list(values.values()), model.base
        for statistic, threshold, leaf in zip(model.statistic.tolist(), model.threshold.tolist(), model.leaf.tolist(), strict=True):
            node = 0
            while node < len(statistic):
                node = 2 * node + (2 if x[statistic[node]] > threshold[node] else 1)
            total += leaf[node - len(statistic)]
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and got[k].predicted == (got[k].score >= 0.3)


def test_the_shard_of_every_row(spark):
    size = {k: len(t.encode()) + 8 for k, t in texts().items()}
    total, before, slot, want = sum(size.values()), 0, collections.Counter(), {}
    for k in sorted(size):
        shard = (2 * before + size[k]) * 24 // (2 * total)
        want[k], before = (shard, slot[shard]), before + size[k]
        slot[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in queries.QUERIES["op3_sharding"](spark, SMALL).collect()} == want
