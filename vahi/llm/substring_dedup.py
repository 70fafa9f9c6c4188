"""Substring dedup: windows of words that start in an earlier document, found by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import chunks, compact, join_by, mix, raw, run_hashes, span_hashes, stored, tasks, text_key, word_spans

WINDOW = 50
#: Words of the runs of which a window's smallest hash is its minimiser: long enough that no run is common by chance.
MINIMISER = 4
#: Bytes of super-k-mers that a task gathers before it ships them, and that a bucket's reader sorts at a time.
PACK_BYTES, SORT_BYTES = 8 << 20, 1 << 20
#: Bytes of runs and ids of one minimiser that a task holds; the windows of those with more are dealt on one by one. One of SAMPLED documents is counted to know them before.
HOT_BYTES, SAMPLED = 8 << 20, 64
#: Hot minimisers that go to the executors by name; the list is a hint, and its size is fixed whatever the corpus.
MOST_HOT = 100_000
#: About what a run and an id of it take.
_RUN_BYTES, _ID_BYTES = 300, 64
#: Ids in a batch of windows.
_BATCH_IDS = 1 << 17

_PACKS = "bucket int, packed binary"
_ROWS = "minimiser long, run binary, docs array<long>, keys array<long>, starts array<int>"
_ROW_TYPES = pa.schema([("minimiser", pa.int64()), ("run", pa.binary()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])


def super_kmers(data: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(minimiser, run of words with one space between, text number, first word) of texts whose white space is compact.

    A run holds consecutive windows of one text that share a minimiser, so equal windows always meet under one minimiser.
    """
    starts, ends, text = word_spans(data, bounds)
    n = len(starts)
    if n < window:
        return
    m = min(MINIMISER, window)
    grams = run_hashes(span_hashes(data, starts, ends), np.arange(n - m + 1), m)
    least, width, span = grams, 1, window - m + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(at):
        return
    value = least[at]
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (text[at[1:]] != text[at[:-1]])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
    begin = starts[at[first]]
    finish = ends[at[last] + window - 1]
    nth = np.searchsorted(text, np.arange(len(bounds)))  # the first word of each text
    whole, who = data.tobytes(), text[at[first]]
    yield from zip(value[first].view(np.int64).tolist(), (whole[a:b] for a, b in zip(begin.tolist(), finish.tolist(), strict=True)), who.tolist(), (at[first] - nth[who]).tolist(), strict=True)


def hot_minimisers(docs: DataFrame, window: int) -> frozenset[int]:
    """The minimisers whose runs would take more than HOT_BYTES, by a sample, the hottest MOST_HOT of them. It only decides how runs are dealt; _judge finds those that it missed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            n = Counter(x[0] for x in super_kmers(*compact(*raw(part.column("text"))), window))
            yield pa.record_batch([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], names=["minimiser", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    sums = some.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    return frozenset(r.minimiser for r in sums.where(F.col("n") * SAMPLED * (_RUN_BYTES + _ID_BYTES) > HOT_BYTES).where("n > 1").orderBy(F.desc("n"), "minimiser").limit(MOST_HOT).collect())


def _pack(window: int, buckets: int, hot: frozenset[int]):
    """Super-k-mers of a task's texts, summed to one row a distinct run, in compressed packs by bucket; those of hot minimisers are dealt by run."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        runs = list(held)
        dealt = [zlib.crc32(x) if held[x][0] in hot else held[x][0] for x in runs]
        bucket = (mix(np.array(dealt, np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in np.split(order, edges):
            some = sorted((runs[i] for i in part), key=lambda x: held[x][0])
            rows = pa.record_batch([pa.array(x, t) for x, t in zip(([held[r][0] for r in some], some, *([held[r][k] for r in some] for k in (1, 2, 3))), _ROW_TYPES.types, strict=True)], schema=_ROW_TYPES)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROW_TYPES) as to:
                to.write_batch(rows)
            yield pa.record_batch([pa.array([int(bucket[part[0]])], pa.int32()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], names=["bucket", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for part in chunks(batches, "text"):
            docs, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
            for minimiser, run, text, start in super_kmers(*compact(*raw(part.column("text"))), window):
                if (known := held.get(run)) is None:
                    held[run] = known = (minimiser, [], [], [])
                    size += len(run) + 300
                known[1].append(docs[text])
                known[2].append(keys[text])
                known[3].append(start)
                size += 24
            if size > PACK_BYTES:
                yield from flush(held)
                held, size = {}, 0
        if held:
            yield from flush(held)

    return pack


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("packed"):
            with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed.as_py())) as rows:
                yield from rows


def _by_minimiser(batches: Iterator[pa.RecordBatch], most: int, hot: frozenset[int]) -> Iterator[tuple[bool, dict[bytes, list]]]:
    """Runs with their docs, keys and starts: (False, those of whole minimisers, about `most` bytes at a time, equal runs as one).

    (True, some runs) of a minimiser that is hot or has more than HOT_BYTES; all its runs come so, and equal ones may come again.
    """
    held: dict[bytes, list] = {}
    mine: dict[bytes, list] = {}
    size, own, last, wide = 0, 0, None, False
    for batch in batches:
        for minimiser, run, docs, keys, starts in zip(*(batch.column(c).to_pylist() for c in _ROW_TYPES.names), strict=True):
            if minimiser != last:
                if wide and mine:
                    yield True, mine
                elif not wide:
                    held |= mine
                    size += own
                    if size > most:
                        yield False, held
                        held, size = {}, 0
                mine, own, last, wide = {}, 0, minimiser, minimiser in hot
            if (known := mine.get(run)) is None:
                mine[run] = [docs, keys, starts]
                own += len(run)
            else:
                for a, b in zip(known, (docs, keys, starts), strict=True):
                    a.extend(b)
            own += _ID_BYTES * len(docs)
            if own > (SORT_BYTES if wide else HOT_BYTES):
                yield True, mine
                mine, own, wide = {}, 0, True
    if wide and mine:
        yield True, mine
    elif not wide:
        held |= mine
    if held:
        yield False, held


_FOUND = "doc_id long, text_key long, first int, past int, digest binary, docs array<long>, keys array<long>, starts array<int>"
_FOUND_TYPES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("past", pa.int32()), ("digest", pa.binary()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])


def _found(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND_TYPES], schema=_FOUND_TYPES)


def _windows(runs: dict[bytes, list], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of these runs: a digest of its words, its first word counted from the run's start, and where the run stands."""
    names = ("first", "digest", "docs", "keys", "starts")
    out, size = {x: [] for x in names}, 0
    for run, places in runs.items():
        words = run.split(b" ")
        for k in range(len(words) - window + 1):
            for name, x in zip(names, (k, hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest(), *places), strict=True):
                out[name].append(x)
            size += len(places[0])
            if size > _BATCH_IDS:
                yield _found(out)
                out, size = {x: [] for x in names}, 0
    if size:
        yield _found(out)


def earliest_starts(runs: list[bytes], earliest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of these runs the smallest document in which it starts, and where each run's windows begin.

    earliest: the smallest document of each run. The windows are sorted by hash; those with one hash count as equal only if their bytes are.
    """
    data, bounds = np.frombuffer(b"".join(runs), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in runs])))
    starts, ends, run = word_spans(data, bounds)
    at = np.flatnonzero(run[: len(run) - window + 1] == run[window - 1 :])
    value = run_hashes(span_hashes(data, starts, ends), at, window)
    of = run[at]
    result = earliest[of]
    order = np.lexsort((result, value))
    sorted_value = value[order]
    new = np.concatenate(([True], sorted_value[1:] != sorted_value[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(order)])))
    begin, finish, whole = starts[at], ends[at + window - 1], data.tobytes()
    for k in np.flatnonzero(count > 1):
        same: dict[bytes, int] = {}
        for i in order[first[k] : first[k] + count[k]].tolist():  # smallest document first
            result[i] = same.setdefault(whole[begin[i] : finish[i]], result[i])
    return result, np.searchsorted(of, np.arange(len(runs) + 1))


def _judge(window: int, hot: frozenset[int]):
    """(doc_id, text_key, first, past): words of windows that start in a document with a smaller doc_id; of hot minimisers the windows themselves."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide, held in _by_minimiser(batches, SORT_BYTES, hot):
            if wide:
                yield from _windows(held, window)
                continue
            runs, places = list(held), list(held.values())
            earliest = np.array([min(x[0]) for x in places], np.int64)
            latest = np.array([max(x[0]) for x in places], np.int64)
            result, edges = earliest_starts(runs, earliest, window)
            out: list[list[int]] = [[], [], [], []]
            for k in np.flatnonzero(np.minimum.reduceat(result, edges[:-1]) < latest).tolist():
                mine = result[edges[k] : edges[k + 1]]
                high = mine.max()
                for doc, key, start in zip(*places[k], strict=True):
                    if doc > high:
                        spans = ((0, len(mine)),)
                    else:
                        sides = np.flatnonzero(np.diff(np.concatenate(([False], mine < doc, [False]))))
                        spans = zip(sides[::2].tolist(), sides[1::2].tolist(), strict=True)
                    for a, b in spans:
                        for column, x in zip(out, (doc, key, start + a, start + b + window - 1), strict=True):
                            column.append(x)
            if out[0]:
                yield _found(dict(zip(("doc_id", "text_key", "first", "past"), out, strict=True)))

    return judge


def _spans_of_windows(windows: DataFrame, window: int) -> DataFrame:
    """The spans of the windows that _judge passed on: the smallest document by window is found in Spark, and rows of hot windows stay where they are, so no task holds a window's documents."""
    ends = windows.groupBy("digest").agg(F.min(F.array_min("docs")).alias("earliest"), F.max(F.array_max("docs")).alias("latest"), F.count("*").alias("rows")).where("earliest < latest")
    each = join_by(windows, ends.select("digest", "earliest", "rows"), "digest", "rows", windows.count()).select("first", "earliest", F.inline(F.arrays_zip("docs", "keys", "starts")))
    at = F.col("starts") + F.col("first")
    return each.where("docs > earliest").select(F.col("docs").alias("doc_id"), F.col("keys").alias("text_key"), at.alias("first"), (at + F.lit(window)).alias("past"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans."""
    for part in chunks(batches, "text"):
        data, bounds = compact(*raw(part.column("text")))
        starts, ends, text = word_spans(data, bounds)
        first, whole = np.searchsorted(text, np.arange(len(bounds))), data.tobytes()
        words, lost, kept = np.diff(first), [], []
        for k, spans in enumerate(part.column("spans").to_pylist()):
            if not spans:
                lost.append(0)
                kept.append(whole[bounds[k] : bounds[k + 1]].rstrip(b" ").decode())
                continue
            edges = np.zeros(words[k] + 1, np.int64)
            np.add.at(edges, [x["first"] for x in spans], 1)
            np.add.at(edges, [x["past"] for x in spans], -1)
            stays = np.cumsum(edges)[:-1] == 0
            lost.append(int(words[k] - stays.sum()))
            sides = np.flatnonzero(np.diff(np.concatenate(([False], stays, [False]))))
            kept.append(b" ".join(whole[starts[first[k] + a] : ends[first[k] + b - 1]] for a, b in zip(sides[::2], sides[1::2], strict=True)).decode())
        yield pa.record_batch([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word that lies in a window of `window` words which also starts in a document with a smaller doc_id.

    Consecutive windows that share a minimiser travel as one packed run of words to the minimiser's bucket. A task sums equal runs before it ships them and
    compresses what goes to one bucket, so a passage that a third of all documents hold is one row a task. In the bucket the runs are sorted by minimiser
    and read a few at a time; sorting their windows finds equals, whose bytes are compared. A minimiser with more than HOT_BYTES of runs and ids, such as
    that at the edges of a common passage, is not held: its windows go on by digest, and Spark finds the smallest document of each. Windows are judged on the input.

    Returns one row per input row: doc_id, n_words, n_removed, text (kept words, one space between). Null and empty texts have no words.
    Rows with a null doc_id neither lose words nor count for others; repeated rows of one doc_id are treated alike. An empty table gives no rows.
    Other columns are not read.
    """
    buckets = tasks(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    named = docs.where("doc_id is not null")
    hot = hot_minimisers(named, window)
    packs = named.mapInArrow(_pack(window, buckets, hot), _PACKS)
    runs = packs.repartitionById(buckets, F.col("bucket")).mapInArrow(_unpack, _ROWS).sortWithinPartitions("minimiser")
    found = stored(runs.mapInArrow(_judge(window, hot), _FOUND), "found")
    spans = found.where("digest is null").select("doc_id", "text_key", "first", "past")
    windows = found.where("digest is not null").select("digest", "first", "docs", "keys", "starts")
    if not windows.isEmpty():
        spans = spans.unionByName(_spans_of_windows(windows, window))
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    both = docs.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")
