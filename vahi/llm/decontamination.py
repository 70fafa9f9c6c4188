"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import LOWER, chunks, distinct, raw, run_hashes, span_hashes, stored, word_spans

WINDOW = 10
#: Bytes that the benchmark's windows may take in a task at a time, a window's words and WINDOW_BYTES for its arrays and items; a larger benchmark is worked through in blocks.
BLOCK_BYTES, WINDOW_BYTES = 64 << 20, 300
#: Candidate places that are checked at once.
PAIRS = 1 << 18

#: A-Z lower-cased; of ASCII, only 0-9 and a-z are parts of words.
_FOLD = bytes(int(LOWER[i]) if i >= 128 or chr(LOWER[i]).isalnum() else 32 for i in range(256))

_FOLDED = np.frombuffer(_FOLD, np.uint8)
_NO_WORD = np.arange(256) == 32
_NO_WORD[[9, 10, 11, 12, 13]] = True


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): every run of `window` words of each item as one string; a shorter item is one window, one without words none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            ids, found = [], []
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = words_of(text)
                runs = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                ids += [item] * len(runs)
                found += runs
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, words binary").distinct()


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, bounds, _NO_WORD)


class Windows:
    """Windows by their rarest word, in arrays: some 100 bytes each beside their words.

    The prefix of a window is its rarest word, for all of its words must occur. A document word meets the windows whose rarest word has its hash; the word's place less
    the rarest word's offset is where such a window must start, there its length must fit, the hash of the whole run must agree, and last its bytes.
    """

    def __init__(self, runs: list[bytes], items: list[list[int]], frequency: dict[int, int]):
        data, bounds = np.frombuffer(b"".join(runs), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int64)
        starts, ends, run = _word_spans(data, bounds)
        word = span_hashes(data, starts, ends)
        first = np.searchsorted(run, np.arange(len(runs) + 1))
        self.length = np.diff(first)
        seen = np.array([frequency.get(x, 0) for x in word.tolist()], np.int64)
        order = np.lexsort((np.arange(len(run)), word, seen, run))  # the rarest word of each run first, ties by hash and place
        self.offset = order[first[:-1]] - first[:-1]
        self.rare = word[order[first[:-1]]]
        self.whole = _run_of(word, first[:-1], self.length)
        by = np.argsort(self.rare, kind="stable")
        self.offset, self.rare, self.whole, self.length = (x[by] for x in (self.offset, self.rare, self.whole, self.length))
        self.bytes = [runs[k] for k in by.tolist()]
        self.items = [items[k] for k in by.tolist()]

    def occurrences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first word in the text, length and number of each occurring window; and the words of each text."""
        raw_data, bounds = raw(column)
        data = _FOLDED[raw_data]
        starts, ends, text = _word_spans(data, bounds)
        first = np.searchsorted(text, np.arange(len(bounds)))
        words = np.diff(first)
        none = np.zeros(0, np.int64)
        if not len(self.rare) or not len(starts):
            return none, none, none, none, words
        word = span_hashes(data, starts, ends)
        low, high = np.searchsorted(self.rare, word, side="left"), np.searchsorted(self.rare, word, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        while len(hit):  # as many words at a time as give at most PAIRS candidates; a word alone may give more, in slices of the windows
            upto = max(1, int(np.searchsorted(np.cumsum(count), PAIRS, side="right")))
            some, n = hit[:upto], count[:upto]
            hit, count = hit[upto:], count[upto:]
            for k in range(0, int(n.max()), PAIRS):
                m = np.minimum(np.maximum(n - k, 0), PAIRS)
                at = np.repeat(some, m)
                window = np.repeat(low[some] + k, m) + (np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m))
                begin = at - self.offset[window]
                fits = (begin >= first[text[at]]) & (begin + self.length[window] <= first[text[at] + 1])
                begin, window = begin[fits], window[fits]
                same = _run_of(word, begin, self.length[window]) == self.whole[window]
                found.append((begin[same], window[same]))
        begin, window = np.concatenate([x for x, _ in found] or [none]), np.concatenate([x for _, x in found] or [none])
        sure = [b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)) == self.bytes[w] for i, n, w in zip(begin.tolist(), self.length[window].tolist(), window.tolist(), strict=True)]
        sure = np.array(sure, bool)
        begin, window = begin[sure], window[sure]
        return text[begin], begin - first[text[begin]], self.length[window], window, words


def _run_of(word: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin), np.uint64)
    for n in distinct(length).tolist():
        these = length == n
        out[these] = run_hashes(word, begin[these], n)
    return out


def word_frequencies(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each wanted word hash occurs; tasks sum before the shuffle, and only wanted words leave them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for part in chunks(batches, "text"):
            data, bounds = raw(part.column("text"))
            data = _FOLDED[data]
            starts, ends, text = _word_spans(data, bounds)
            word = span_hashes(data, starts, ends)
            place = np.minimum(np.searchsorted(wanted, word), len(wanted) - 1)
            mine = wanted[place] == word
            pairs = distinct(text[mine] * len(wanted) + place[mine])
            total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    if not len(wanted):
        return {}
    sums = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word & (1 << 64) - 1: r.n for r in sums.collect()}  # words of one block only


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Windows]:
    """The distinct windows in blocks whose arrays and words take about block_bytes in a task."""
    windows = stored(item_windows(benchmark.where("item_id is not null"), window), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("words") + WINDOW_BYTES), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    windows = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for k in range(blocks):
        rows = windows.where(F.col("block") == k).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).toArrow()  # one block
        runs = rows.column("words").to_pylist()
        data, bounds = np.frombuffer(b"".join(runs), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int64)
        starts, ends, _ = _word_spans(data, bounds)
        wanted = distinct(span_hashes(data, starts, ends))
        if runs or not k:
            yield Windows(runs, rows.column("ids").to_pylist(), word_frequencies(docs, wanted))


def _hits(docs: DataFrame, needed: Windows) -> DataFrame:
    """(doc_id, row_key, n_words, starts, ends, items) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)  # about block_bytes

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())
        for part in chunks(batches, "text"):
            text, begin, length, window, words = shared.value.occurrences(part.column("text"))
            out: list[list] = [[[] for _ in range(part.num_rows)] for _ in range(3)]
            found: list[set[int]] = [set() for _ in range(part.num_rows)]
            for t, b, n, w in zip(text.tolist(), begin.tolist(), length.tolist(), window.tolist(), strict=True):
                out[0][t].append(b)
                out[1][t].append(b + n)
                found[t].add(w)
            for t, held in enumerate(found):  # a window's items once a row, however often it occurs there
                out[2][t] = list(set().union(*(shared.value.items[w] for w in held)))
            yield pa.record_batch([part.column("doc_id"), part.column("row_key"), pa.array(words, pa.int64()), *(pa.array(x, ints) for x in out)], names=["doc_id", "row_key", "n_words", "starts", "ends", "items"])

    return docs.mapInArrow(match, "doc_id long, row_key long, n_words long, starts array<long>, ends array<long>, items array<long>")


def _finish(rows: DataFrame) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, digest = [], []
            for n, starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends", "items")), strict=True):
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, ends, -1)
                hit.append(int(np.count_nonzero(np.cumsum(edges))) if starts else 0)
                digest.append(hashlib.sha256(",".join(sorted(map(str, set(items)))).encode()).hexdigest())
            n_items = [len(set(x)) for x in batch.column("items").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array([x > 0 for x in hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return rows.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    A window is contained if all its words are, so one word of it is a necessary prefix in the order of rarity: the one that the fewest documents hold.
    A document word joins the windows whose rarest word it is; its position less the word's offset is the only place where the window can stand,
    which must lie inside the document (length and position bounds), and there all words are compared, by hash and then by bytes.

    The distinct windows go to the executors in blocks of about block_bytes, and each block reads the documents twice; no text is shuffled.
    Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null and empty texts have no words.
    Items with null ids or no words have no windows; repeated item rows count once. Repeated and null doc_ids are rows of their own.
    An empty benchmark or table is fine. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.lit(0).cast("long"))
    found, blocks = None, 0
    for needed in _blocks(docs, benchmark, window, block_bytes):
        blocks += 1
        if blocks == 2:  # rows are numbered once, for the parts of one row to meet again
            docs = stored(docs.withColumn("row_key", F.monotonically_increasing_id()), "decontaminate")
            found = _hits(docs, before)
        part, before = _hits(docs, needed), needed
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row_key").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")),
        )
    return _finish(found)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark; rows are judged each by itself, whatever their ids, and nothing is shuffled."""
    spark = docs.sparkSession
    for needed in _blocks(docs, benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(needed)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "text"):
                held = shared.value.occurrences(part.column("text"))[0]
                yield part.filter(pa.array(np.bincount(held, minlength=part.num_rows) == 0))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
