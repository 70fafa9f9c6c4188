"""The packing index against plain BM25, and shards of documents that share nothing."""

import time

import numpy as np
import pytest

from vahi.llm import packing as P


def random_terms(n, vocabulary, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        term, times = np.unique(np.minimum(rng.zipf(1.4, rng.integers(0, 60)), vocabulary), return_counts=True)
        out.append((term.astype(np.int32), times.astype(np.int32)))
    return out


def plain_scores(terms, weight, mean_words, seed):
    """BM25 of every document for all terms of the seed, one at a time."""
    asked = set(terms[seed][0].tolist())
    out = []
    for term, times in terms:
        words = int(times.sum())
        out.append(sum(weight[t] * f * (P.K1 + 1) / (f + P.K1 * (1 - P.B + P.B * words / mean_words)) for t, f in zip(term.tolist(), times.tolist(), strict=True) if t in asked))
    return out


@pytest.mark.parametrize(("n", "vocabulary"), [(400, 300), (1500, 100_000)])
def test_neighbours_are_those_of_plain_bm25(n, vocabulary):
    terms = random_terms(n, vocabulary, n)
    held = np.bincount(np.concatenate([t for t, _ in terms]), minlength=P.TERMS)
    weight, mean = P.rarity(held, n), float(np.mean([t.sum() for _, t in terms]))
    index = P.Index(terms, weight, mean)
    assert (index.row >= 0).any()  # some lists are rows of the matrix
    rng = np.random.default_rng(1)
    for step in range(40):
        seed = int(rng.integers(n))
        if not index.unused[seed]:
            continue
        index.use(seed)
        scores = plain_scores(terms, weight, mean, seed)
        want = {k for k in range(n) if index.unused[k] and scores[k] > 0}
        got = list(index.neighbours(seed))
        assert set(got) == want and len(got) == len(want)
        along = [scores[k] for k in got]
        assert all(a >= b - 1e-3 * max(1, a) for a, b in zip(along, along[1:], strict=False))
        for k in got[: 40 if step % 2 else 3]:
            index.use(k)


def test_documents_that_share_nothing():
    """A million empty documents, and many with one term of their own each, cost their own terms only."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32))
    weight = np.ones(P.TERMS, np.float32)
    began = time.monotonic()
    assert sorted(P.packing_order(P.Index([none] * 1_000_000, weight, 1.0), [1] * 1_000_000, 1024)) == list(range(1_000_000))
    assert time.monotonic() - began < 60
    own = [(np.array([k], np.int32), np.ones(1, np.int32)) for k in range(20_000)]
    assert list(P.packing_order(P.Index(own, weight, 1.0), [3] * 20_000, 1024)) == list(range(20_000))
    assert time.monotonic() - began < 90
