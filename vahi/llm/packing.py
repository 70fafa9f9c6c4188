"""Packing of whole corpora into fixed windows by lexical retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import chunks, mix, stored
from vahi.llm.token_counts import id_encoder, tokenizer

WINDOW = 1024
#: Hashed terms of the index: document frequencies are counted over all documents in a vector of this fixed size.
TERM_BITS = 18
TERMS = 1 << TERM_BITS
#: Bytes of ids of a shard of the index; of a task while there are fewer than MOST_TASKS, and beyond that. Tasks and shards depend on the data alone.
SHARD_BYTES, TASK_BYTES, MOST_TASKS, LARGE_TASK_BYTES = 6 << 20, 24 << 20, 4096, 1 << 30
#: Bytes of text that are encoded at once: the more, the more pieces are met again.
ENCODED_BYTES = 1 << 20
#: A shard has no more documents than this, however short they are.
SHARD_DOCS = 100_000
#: Terms that more than one in DENSE documents of a shard hold are rows of a dense matrix; and so many neighbours are ranked first, the rest if they are asked for.
DENSE, FIRST = 16, 64
K1, B = 1.2, 0.75
#: Odd multipliers, one a place in a word; later ids of a word share the last.
_BY_PLACE = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, np.uint64))


def word_starts(path: str) -> np.ndarray:
    """For each id of a byte-level vocabulary whether a word starts there: it begins with anything but a letter or digit, a space among them."""
    vocabulary = tokenizer(path).get_vocab()
    starts = np.ones(max(vocabulary.values()) + 1, bool)
    for token, k in vocabulary.items():
        starts[k] = not token[0].isalnum() or token[0] == "\u0120"  # how the vocabulary writes a space
    return starts


def words_of(texts: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of some texts' ids, how many ids it has, and its text's number; all texts in one pass."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    ids = np.concatenate(texts) if texts else np.zeros(0, np.uint16)
    first = starts[ids]
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(ids)))
    if not len(at):
        return np.zeros(0, np.uint64), length, at
    place = np.arange(len(ids), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    word = mix(np.add.reduceat((ids.astype(np.uint64) + np.uint64(1)) * _BY_PLACE[np.minimum(place, len(_BY_PLACE) - 1)], at))
    return word, length, np.searchsorted(bounds, at, side="right") - 1


def terms_of(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashed terms of each of n texts, how often they occur, and the bounds of the texts."""
    both = np.sort((text.astype(np.int64) << TERM_BITS) | (word >> np.uint64(64 - TERM_BITS)).astype(np.int64))
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))[: len(both)])
    both, times = both[at], np.diff(np.append(at, len(both)))
    return (both & (TERMS - 1)).astype(np.int32), times.astype(np.int32), np.searchsorted(both, np.arange(n + 1, dtype=np.int64) << TERM_BITS)


def places_of(word: np.ndarray, length: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the smallest hash among its words of most ids, which are its rare ones: texts that share rare words are often dealt to one shard."""
    places = np.zeros(n, np.int64)
    if len(word):
        edges = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        longest = np.repeat(np.minimum(np.maximum.reduceat(length, edges), 3), np.diff(np.append(edges, len(text))))
        places[text[edges]] = np.minimum.reduceat(np.where(length >= longest, word >> np.uint64(1), np.uint64((1 << 63) - 1)), edges).astype(np.int64)
    return places


_ENCODED = "doc_id long, place long, crc long, ids binary, terms array<int>, times array<long>"
#: Numbers of the corpus that travel among the terms: documents, words, bytes of ids.
_ROWS, _WORDS, _BYTES = -1, -2, -3


def encoded(docs: DataFrame, make: Callable, starts: np.ndarray, end_id: int) -> DataFrame:
    """A row for each document (place, ids with end_id, their crc), and after a task's documents how many of them hold each term that occurs."""
    width = "<u2" if len(starts) <= 1 << 16 else "<u4"
    names = ["doc_id", "place", "crc", "ids", "terms", "times"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end = make(), np.array([end_id], np.uint32)
        frequency, rows, words, size = np.zeros(TERMS, np.int64), 0, 0, 0
        for batch in chunks(batches, "text", ENCODED_BYTES):
            texts = to_ids([x or "" for x in batch.column("text").to_pylist()])
            n = len(texts)
            word, length, text = words_of(texts, starts)
            frequency += np.bincount(terms_of(word, text, n)[0], minlength=TERMS)
            bodies = [np.concatenate((x, end)).astype(width).tobytes() for x in texts]
            rows, words, size = rows + n, words + len(word), size + sum(map(len, bodies))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(places_of(word, length, text, n)), pa.array([zlib.crc32(x) for x in bodies], pa.int64()), pa.array(bodies, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=names
            )
        held = np.flatnonzero(frequency)
        terms, times = np.concatenate(([_ROWS, _WORDS, _BYTES], held)).astype(np.int32), np.concatenate(([rows, words, size], frequency[held]))
        offsets = np.append(np.arange(0, len(terms), 4096), len(terms)).astype(np.int32)
        n = len(offsets) - 1
        yield pa.record_batch([*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, times)], names=names)

    return docs.mapInArrow(encode, _ENCODED)


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, int, float, int]:
    """Over all documents of encoded(): how many hold each hashed term, their number, mean words, and bytes of ids; summed by Spark, a row a term."""
    each = rows.where("terms is not null").select(F.inline(F.arrays_zip("terms", "times"))).groupBy("terms").agg(F.sum("times").alias("n"))
    got = each.toArrow()  # at most TERMS + 3 rows
    term, n = got.column("terms").to_numpy(), got.column("n").to_numpy()
    frequency = np.zeros(TERMS, np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    documents, words, size = (int(n[term == k].sum()) for k in (_ROWS, _WORDS, _BYTES))
    return frequency, documents, words / max(1, documents), size


def rarity(frequency: np.ndarray, rows: int) -> np.ndarray:
    """The BM25 weight of each term."""
    return np.log1p((rows - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)


class Index:
    """An inverted index of some documents with BM25 scores, from which answered documents are taken out.

    The lists of frequent terms are rows of a dense matrix, whose sums are cheaper than adding up long lists; the other terms have lists.
    """

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, mean_words: float):
        lengths = np.array([t.sum() for _, t in terms], np.float32)
        doc = np.repeat(np.arange(len(terms), dtype=np.int64), [len(t) for t, _ in terms])
        term = np.concatenate([t for t, _ in terms]) if terms else np.zeros(0, np.int32)
        times = np.concatenate([t for _, t in terms]).astype(np.float32) if terms else np.zeros(0, np.float32)
        score = (weight[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[doc] / max(mean_words, 1e-9)))).astype(np.float32)
        held = np.bincount(term, minlength=TERMS)
        frequent = np.flatnonzero(held > max(FIRST, len(terms) // DENSE))
        self.row = np.full(TERMS, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        of = self.row[term]
        self.dense = np.zeros((len(frequent), len(terms)), np.float32)
        self.dense[of[of >= 0], doc[of >= 0]] = score[of >= 0]
        rest = of < 0
        doc, term, score = doc[rest], term[rest], score[rest]
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], score[order].astype(np.float64)  # as bincount takes them
        self.lists = np.searchsorted(term[order], np.arange(TERMS + 1))
        self.terms, self.unused, self.names, self.gone = terms, np.ones(len(terms), bool), np.arange(len(terms)), 0

    def use(self, k: int) -> None:
        """Takes a document out of what is answered."""
        self.unused[k] = False
        self.gone += 1

    def _forget(self) -> None:
        """Takes the used documents out of lists and matrix once they are half of those held."""
        if 2 * self.gone >= len(self.names):
            keep = self.unused[self.names]
            place, stays = np.cumsum(keep) - 1, keep[self.doc]
            self.lists = np.concatenate(([0], np.cumsum(stays)))[self.lists]
            self.doc, self.score = place[self.doc[stays]], self.score[stays]
            self.dense, self.names, self.gone = np.ascontiguousarray(self.dense[:, keep]), self.names[keep], 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """All unused documents that share a term with the seed, best score first, ties by place; every term of the seed counts.

        A seed without frequent terms costs the length of its terms' lists, not that of the shard: one without terms or partners costs next to nothing.
        """
        term, _ = self.terms[seed]
        if not len(term):
            return
        self._forget()
        row = self.row[term]
        some = term[row < 0]
        first = self.lists[some]
        n = self.lists[some + 1] - first
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)  # all lists of these terms in one piece
        if len(some) == len(term) and 8 * len(at) < len(self.names):
            at = at[self.unused[self.names[self.doc[at]]]]
            found, of = np.unique(self.doc[at], return_inverse=True)
            total = np.bincount(of, self.score[at], len(found))
            for k in found[np.argsort(-total, kind="stable")].tolist():
                yield int(self.names[k])
            return
        total = self.dense[row[row >= 0]].sum(0, dtype=np.float32).astype(np.float64)
        if len(at):
            total += np.bincount(self.doc[at], self.score[at], len(self.names))
        total *= self.unused[self.names]
        best = np.flatnonzero(total > 0)
        if len(best) > 2 * FIRST:
            bound = np.partition(total[best], len(best) - FIRST)[len(best) - FIRST]
            first = best[total[best] >= bound]
            for k in first[np.argsort(-total[first], kind="stable")].tolist():
                yield int(self.names[k])
            best = best[total[best] < bound]
        for k in best[np.argsort(-total[best], kind="stable")].tolist():
            yield int(self.names[k])


def packing_order(index: Index, lengths: list[int], window: int) -> Iterator[int]:
    """Every document once: a seed, then the unused neighbours of the seed until its windows are full, then the next seed.

    The next seed is the best neighbour that is left over, or the first unused document.
    """
    unused, first, seed = index.unused, 0, None
    fill = 0
    while True:
        if seed is None:
            while first < len(unused) and not unused[first]:
                first += 1
            if first == len(unused):
                return
            seed = first
        index.use(seed)
        yield seed
        fill = (fill + lengths[seed]) % window
        room, following = (window - fill) % window, None
        for near in index.neighbours(seed) if room else ():
            if room <= 0:
                following = near
                break
            index.use(near)
            yield near
            room -= lengths[near]
            fill = (fill + lengths[near]) % window
        seed = following


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(window: int, starts: np.ndarray, weight: np.ndarray, mean_words: float):
    width = "<u2" if len(starts) <= 1 << 16 else "<u4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        terms: list[tuple[np.ndarray, np.ndarray]] = []
        bodies: list[np.ndarray] = []
        shard, shards, size = TaskContext.get().partitionId(), 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            index = Index(terms, weight, mean_words)
            out: list[list[int | None]] = [[] for _ in range(7)]
            # a sequence's number: the partition, the shard of it, and the count in the shard
            sequence, offset = ((shard << 12) + shards) << 28, 0
            for k in packing_order(index, list(map(len, bodies)), window):
                body, start = bodies[k].astype("<u4").tobytes(), 0
                whole = len(body) // 4
                while start < whole:
                    length = min(whole - start, window - offset)
                    row = (names[k], start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), whole, sequence, offset)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    start, offset = start + length, offset + length
                    if offset == window:
                        sequence, offset = sequence + 1, 0
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=PIECE)

        for batch in chunks(batches, "ids"):
            new = [np.frombuffer(body, width) for body in batch.column("ids").to_pylist()]
            word, _, text = words_of([x[:-1] for x in new], starts)
            term, times, edges = terms_of(word, text, len(new))
            terms += [(term[a:b], times[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            bodies += new
            size += sum(x.nbytes for x in new)
            names += batch.column("doc_id").to_pylist()
            if size > SHARD_BYTES or len(bodies) >= SHARD_DOCS:
                yield from flush()
                names, terms, bodies, shards, size = [], [], [], shards + 1, 0
        if bodies:
            yield from flush()

    return pack


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pack all documents, each followed by end_id, into sequences of `window` ids.

    Texts are tokenized once and the ids stored. The index is sharded by ranges of a locality key and doc_id, so shards are equal in size however many documents
    share a key. In a shard a seed document asks the inverted index, whose terms are the words that the ids spell, for unused neighbours by all its terms and goes
    down the ranked list until its windows are full; a document is cut at a window's edge and goes on in the next window, so only the last sequence of a shard has padding. Term frequencies and lengths
    are those of the whole corpus, in vectors of fixed size. path, ranks_path and pattern: see id_encoder; the files must be readable on every executor.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are one end_id.
    Null and repeated doc_ids are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    starts = word_starts(path)
    rows = stored(encoded(docs, lambda: id_encoder(path, ranks_path, pattern), starts, end_id), "encoded")
    frequency, n, mean_words, size = corpus_statistics(rows)
    parts = max(min(size // TASK_BYTES, MOST_TASKS), size // LARGE_TASK_BYTES) + 1
    dealt = rows.where("terms is null").select("doc_id", "place", "crc", "ids")
    shards = dealt.repartitionByRange(int(parts), "place", "doc_id", "crc").sortWithinPartitions("place", "doc_id", "crc")
    return shards.select("doc_id", "ids").mapInArrow(_pack(window, starts, rarity(frequency, n), mean_words), ", ".join(f"{x} long" for x in PIECE))
