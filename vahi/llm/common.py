"""What the text operators share: places for intermediate tables, byte-bounded batches and vectorised word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.storage import forget, new_path, stored, tasks  # noqa: F401  what the operators share

#: Fixed values of the contracts: white space is these ASCII characters and no others.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"

#: Text bytes that one numpy pass handles; hash arrays take some 40 times as much, and should stay in the processor's cache.
CHUNK_BYTES = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 400_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows with these ids, or for left_anti without them; the ids, counted first, are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


#: Keys that are broadcast at most because they are hot: each of them holds more than this share of all rows.
HOT_KEYS = 4096


def join_by(rows: DataFrame, few: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row a key and in `weight` how many rows the key has, where one key may hold most of the rows.

    Keys of more than total / HOT_KEYS rows are fewer than HOT_KEYS, so they are broadcast and their rows stay where they are; the other keys are shuffled.
    how: inner or left.
    """
    least = total // HOT_KEYS + 1
    few = few.where(F.col(key).isNotNull())
    hot = few.where(F.col(weight) > least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(few.where(F.col(weight) <= least), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def clean_text(name: str = "text"):
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text"):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(clean_text(name))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about `most` bytes, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 bounds of its values; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def compact(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space inside a text becomes one space; leading white space goes."""
    white = _IS_WHITE[data]
    after = np.empty_like(white)
    after[1:] = ~white[:-1]
    after[:1] = False
    first = bounds[:-1][bounds[:-1] < len(data)]
    after[first] = False
    keep = ~white | after
    out = np.where(white, np.uint8(32), data)[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[bounds]


def word_spans(data: np.ndarray, bounds: np.ndarray, white: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; white: the bytes that part words."""
    inside = ~white[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[:1] = after[-1:] = False
    filled = bounds[1:] > bounds[:-1]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept as far as they have been asked for, up to KEPT of them."""

    KEPT = 1 << 21

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), self.KEPT))
            both = []
            for base in (self.base, self.inverse):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                both.append(np.cumprod(values))
            if size > self.KEPT:  # one very long text: its powers are not kept
                return both[0], both[1]
            self.up, self.down = both
        return self.up, self.down


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values. np.unique without counts hashes in numpy 2.3, which takes ten times as long and much memory."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


_OF_BYTES, _OF_WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same for the same bytes anywhere."""
    return _spans_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, _OF_BYTES)


#: Bytes of a text whose words are hashed at once; longer words than LONG_WORD have a digest, for sums of powers modulo 2**64 can be made to collide in long ones.
PIECE_BYTES, LONG_WORD = 4 << 20, 512


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the text number of each; a very long text is worked through in pieces that end at white space."""
    if len(data) <= PIECE_BYTES:
        starts, ends, text = word_spans(data, bounds)
        words = span_hashes(data, starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            words[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return words, text
    words, texts = [], []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        while a < b:
            to = min(a + PIECE_BYTES, b)
            if to < b:
                white = np.flatnonzero(_IS_WHITE[data[a:to]])
                to = a + int(white[-1]) + 1 if len(white) else b  # a word longer than a piece stays whole
            piece = data[a:to]
            if len(piece) > PIECE_BYTES:
                starts, ends, _ = word_spans(piece, np.array([0, len(piece)]))
                hashed = np.array([int.from_bytes(hashlib.blake2b(piece[x:y].tobytes(), digest_size=8).digest(), "little") if y - x > LONG_WORD else span_hashes(piece[x:y], np.zeros(1, np.int64), np.full(1, y - x))[0] for x, y in zip(starts, ends, strict=True)], np.uint64)
            else:
                hashed, _ = word_hashes(piece, np.array([0, len(piece)]))
            words.append(hashed)
            texts.append(np.full(len(hashed), k, np.int64))
            a = to
    return np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *texts])


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` word hashes that begins at starts."""
    return _spans_hash(words, starts, starts + length, _OF_WORDS)
