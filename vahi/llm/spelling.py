"""Spelling variants: words one edit apart, met through a positional inverted index of 3-grams."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.llm.common import chunks, forget, stored, tasks

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: Characters of a text whose runs are listed at once; distinct words that a task sums before it passes them on.
PIECE_CHARS, MOST_WORDS = 1 << 20, 400_000


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that end between runs; a run longer than a piece stays whole."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = _NO_LETTER.search(text, at + PIECE_CHARS)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


def _counts(edit_one_in: int, least_chars: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in chunks(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                runs: Counter[str] = Counter()
                for piece in _pieces(text):
                    runs.update(_RUN.findall(piece))
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    low = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(low.encode(), begun)
                    if not h % edit_one_in:
                        k = h % len(low)
                        low = low[:k] + low[k + 1 :]
                    if len(low) >= least_chars:
                        total[low] += n
            if len(total) > MOST_WORDS:
                yield flush()
        yield flush()

    return counts


def vocabulary(docs: DataFrame, least_chars: int = 5, least_n: int = 3, edit_one_in: int = 97) -> DataFrame:
    """(word, n): the distinct words of all texts and how often they occur, summed in tasks and then by Spark."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = docs.mapInArrow(_counts(edit_one_in, least_chars), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


#: A gram has three characters of the padded word. One edit touches at most Q of a word's grams.
Q = 3
#: The alphabet, after padding (0): A-Z cannot occur in a word, so 26 small letters and 64 others, which gives at most 91 ** 3 grams whatever the corpus.
_CODE = np.zeros(256, np.int64)
_CODE[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(1, 91)
BASE = 91
_PLACES = 1 << 21


def grams(word: str) -> list[int]:
    """The codes of the word's grams by position; two places of padding at each end, so there are two more than characters."""
    code = np.concatenate(([0, 0], _CODE[np.frombuffer(word.encode("latin-1"), np.uint8)], [0, 0]))
    return ((code[:-2] * BASE + code[1:-1]) * BASE + code[2:]).tolist()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BASE**3, np.int64)
    for batch in batches:
        for word in batch.column("word").to_pylist():
            np.add.at(total, grams(word), 1)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["gram", "n"])


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each gram in the order of rarity over all words; at most 91 ** 3 rows come to the driver."""
    got = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BASE**3, np.int64)
    total[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    rank = np.empty(BASE**3, np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(BASE**3, dtype=np.int32)
    return rank


def _key(gram: int, length: int, place: int) -> int:
    return (gram << 42) | (length % _PLACES << 21) | (place % _PLACES)


def _postings(ranks):
    """Where a word is posted: the Q + 1 rarest of its gram occurrences, of which one edit must leave one in place in both words.

    Under a gram, the longer word's length and the position in the longer word: itself as one that may be longer or as long, and for the words one longer than it,
    in which its gram is at the same position or at the next.
    """

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            keys, roles, at = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                size, own = len(word), grams(word)
                rarest = heapq.nsmallest(Q + 1, range(len(own)), key=lambda p: (rank[own[p]], own[p], p))
                mine = {(_key(own[p], size, p), True) for p in rarest} | {(_key(own[p], size + 1, p + d), False) for p in rarest for d in (0, 1)}
                for key, role in mine:
                    keys.append(key)
                    roles.append(role)
                    at.append(k)
            at = pa.array(at, pa.int32())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(roles, pa.bool_()), batch.column("word").take(at), batch.column("n").take(at)], names=["bucket", "whole", "word", "n"])

    return postings


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes the words equal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def near_in_bucket(words: list[str], whole: list[bool]) -> Iterator[tuple[int, int]]:
    """The pairs of a bucket's words that are one edit apart, by a positional inverted index of the bucket, whose lists are sorted.

    A longer word of L characters has L + 2 grams, and a word within one edit shares at least L - 1 of them, at the same position or, if it is shorter, at the
    same or the one before. So at least L - 1 lists have members, and the word is in one of the shortest of those, all but L - 2: they are heap-merged, and what comes up
    is counted in the others by binary search, kept at L - 1 and then compared. Words are asked one after the other and then join the index, so a pair comes once.
    """
    shorter: dict[tuple[str, int], list[int]] = {}
    for k, word in enumerate(words):
        if not whole[k]:
            for key in _places(word):
                shorter.setdefault(key, []).append(k)
    earlier: dict[tuple[str, int], list[int]] = {}
    for k, word in enumerate(words):
        if not whole[k]:
            continue
        least, own = len(word) - 1, _places(word)
        same = [x for key in own if (x := earlier.get(key))]
        found = _common(same, least) if len(same) >= least else []
        if shorter:
            both = [(shorter.get(key), shorter.get((key[0], key[1] - 1))) for key in own]
            lists = [sorted({*x, *y}) if x and y else x or y for x, y in both if x or y]
            if len(lists) >= least:
                found += _common(lists, least)
        for other in found:
            if one_edit(word, words[other]):
                yield k, other
        for key in own:
            earlier.setdefault(key, []).append(k)


def _places(word: str) -> list[tuple[str, int]]:
    """The word's grams with their positions."""
    padded = f"\0\0{word}\0\0"
    return [(padded[p : p + Q], p) for p in range(len(word) + 2)]


def _common(lists: list[list[int]], least: int) -> list[int]:
    """The members of at least `least` of the sorted lists."""
    lists = sorted(lists, key=len)
    first, rest = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    out: list[int] = []
    merged = list(heapq.merge(*first)) if len(first) > 1 else first[0] if first else []
    at, n = 0, len(merged)
    while at < n:
        x, times = merged[at], 0
        while at < n and merged[at] == x:
            at, times = at + 1, times + 1
        left = len(rest)
        for members in reversed(rest):  # the longest first: most hits
            if times + left < least or times >= least:
                break
            p = bisect_left(members, x)
            times, left = times + (p < len(members) and members[p] == x), left - 1
        if times >= least:
            out.append(x)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words; rows come in order of bucket, and one bucket at a time is held."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, whole = rows.column("bucket").to_numpy(), rows.column("whole").to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
        several = (np.diff(edges) > 1) & (np.add.reduceat(whole, edges[:-1], dtype=np.int64) > 0 if len(bucket) else False)
        a, b = [], []
        for k in np.flatnonzero(several):
            low, high = int(edges[k]), int(edges[k + 1])
            for x, y in near_in_bucket(rows.column("word")[low:high].to_pylist(), whole[low:high].tolist()):
                a.append(low + x)
                b.append(low + y)
        if a:
            a, b = pa.array(a), pa.array(b)
            word, n = rows.column("word"), rows.column("n")
            out = pa.table([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "near", "near_n"])
            yield from out.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))
        if last or (held and held[-1].column("bucket")[0].as_py() != int(bucket[-1])):
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
            held = []
        held.append(batch.slice(last))
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks())


def near_words(spark: SparkSession, words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(word, n, near, near_n) of every pair of near words, in both directions, each once."""
    shared = spark.sparkContext.broadcast(ranks)  # 91 ** 3 numbers
    posted = words.mapInArrow(_postings(shared), "bucket long, whole boolean, word string, n long")
    sharded = posted.repartition(max(tasks(spark), 1), "bucket").sortWithinPartitions("bucket", "word")
    once = sharded.mapInArrow(_near, "word string, n long, near string, near_n long").dropDuplicates(["word", "near"])
    end = lambda *names: F.struct(*[F.col(c).alias(as_) for c, as_ in zip(names, ("word", "n", "near", "near_n"), strict=True)])
    return once.select(F.inline(F.array(end("word", "n", "near", "near_n"), end("near", "near_n", "word", "n"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the chain of forms, found by doubling the steps. Each form occurs at least twice as often as its word, so chains end and are short."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(ahead, "root", "left"), "spelling-roots")
        forget(at)
        if step.where("next is not null").isEmpty():
            return step.select("word", "root")
        at = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, ratio: int = 2, edit_one_in: int = 97) -> DataFrame:
    """Group words with the more frequent words that are one edit away.

    Words are maximal runs of letters, A-Z lower-cased; in one of edit_one_in (document, run) pairs, dealt by CRC-32, a character is deleted, which plants variants.
    Words of at least least_chars characters and least_n occurrences are posted in a positional inverted index of 3-grams, sharded by gram, length and position, under
    their four rarest gram occurrences; each shard's own index is merged under the length and position limits, counted and verified.

    Returns one row per word: word, form, root, n, n_near, form_n. A null text has no words; a null doc_id is written as nothing in the CRC; doc_id must be a
    number or null. Repeated rows and documents count as often as they occur. A very long text is read in pieces, a very long run is one word. No words, no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    words = stored(vocabulary(docs, least_chars, least_n, edit_one_in), "spelling-words")
    near = near_words(spark, words, gram_ranks(words))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    often = F.col("form_n") >= ratio * F.col("n")
    formed = stored(joined.select("word", "n", "n_near", F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")), "spelling-forms")
    forget(words)
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
