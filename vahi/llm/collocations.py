"""Collocations: phrases of two to four words, counted by word-id suffix arrays of shards; what is frequent gets an id for all shards, of which longer phrases are made."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vahi.llm.common import BROADCAST_IDS, LOWER, chunks, forget, join_by, mix, raw, span_hashes, stored, tasks, word_spans

#: Kinds of bytes: of words 0, blanks 1, ends of pieces 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(x) for x in ".,;:!?\n\x0b\x0c\r"]] = 2
_APART = _KIND > 0
#: Bytes of text that are split at once, words of a shard, and rows of a batch that is passed on.
SPAN_BYTES, SHARD_WORDS, BATCH_ROWS = 1 << 20, 2 << 20, 1 << 15


def _spans(text: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in spans that end between words; a word longer than a span stays whole."""
    at = 0
    while at < len(text):
        to = min(at + SPAN_BYTES, len(text))
        if to < len(text):
            apart = np.flatnonzero(_APART[text[at:to]])
            if len(apart):
                to = at + int(apart[-1]) + 1
            else:
                while to < len(text) and not _APART[text[to]]:
                    more = np.flatnonzero(_APART[text[to : to + SPAN_BYTES]])
                    to = to + int(more[0]) if len(more) else min(to + SPAN_BYTES, len(text))
        yield text[at:to]
        at = to


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, bool]:
    """The words of some lower-cased texts, whether each begins a piece, its text's number, and whether a piece ends after the last."""
    starts, ends, text = word_spans(data, bounds, _APART)
    closed = np.cumsum(_KIND[data] == 2, dtype=np.int32)
    fresh = np.ones(len(starts), bool)
    if len(starts):
        fresh[1:] = (closed[starts[1:]] > closed[ends[:-1] - 1]) | (text[1:] != text[:-1])
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~_APART[data]]))])
    after = bool(len(data)) and bool(closed[-1] > (closed[ends[-1] - 1] if len(ends) else 0))
    return words, fresh, text, after


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words, whether each begins a piece, and the row of each."""
    for part in chunks([batch], "text", SPAN_BYTES):
        data, bounds = raw(part.column("text"))
        data = LOWER[data]
        if len(data) <= 2 * SPAN_BYTES:
            words, fresh, text, _ = split(data, bounds)
            yield words, fresh, text
            continue
        begins = True
        for span in _spans(data):
            words, fresh, text, after = split(span, np.array([0, len(span)]))
            if len(fresh):
                first = _KIND[span[: int(np.argmin(_APART[span]))]] == 2
                fresh[0] = begins or bool(first.any())
                begins = after
            else:
                begins |= after
            yield words, fresh, text


#: A shard as a row: its languages with their words, and compressed the dictionary (bytes of the words, their lengths, languages and counts) and the texts as ids.
SHARD = "shard long, langs array<string>, lang_words array<long>, words binary, lengths binary, lang_of binary, counts binary, ids binary"
_SHARD_NAMES = ["shard", "langs", "lang_words", "words", "lengths", "lang_of", "counts", "ids"]


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _shard_row(shard: int, langs: pa.Array, lang_words: np.ndarray, words: pa.Array, lang_of: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    data, bounds = raw(words)
    packed = [_squeeze(x) for x in (data, np.diff(bounds).astype(np.int32), lang_of.astype(np.int32), counts.astype(np.int64), ids)]
    return pa.record_batch([pa.array([shard], pa.int64()), _one(langs), _one(pa.array(lang_words, pa.int64())), *(pa.array([x], pa.binary()) for x in packed)], names=_SHARD_NAMES)


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sequence(ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The ids with 0 before each piece."""
    out = np.zeros(len(ids) + int(fresh.sum()), np.int32)
    out[np.arange(len(ids)) + np.cumsum(fresh)] = ids
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards: dictionaries of (lang, word) with counts, and the texts as ids from 1, with 0 before each piece."""
    codes: dict[str, int] = {}
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size, made, task = 0, 0, TaskContext.get().partitionId()

    def shard() -> pa.RecordBatch:
        nonlocal made
        words = pa.chunked_array([x for x, _, _ in held]).dictionary_encode().combine_chunks()  # the words' bytes are not copied
        fresh, lang = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
        held.clear()
        n_words = len(words.dictionary)
        code = words.indices.to_numpy() + lang.astype(np.int32 if n_words * len(codes) < 1 << 31 else np.int64) * n_words
        if n_words * len(codes) <= 8 * len(code) + (1 << 20):
            counts = np.bincount(code, minlength=n_words * len(codes))
            kept = np.flatnonzero(counts)
            place = np.cumsum(counts > 0, dtype=np.int32)
            ids, counts = place[code], counts[kept]
        else:
            kept, ids, counts = np.unique(code, return_inverse=True, return_counts=True)
            ids = ids.astype(np.int32) + 1
        del code
        made += 1
        return _shard_row((task << 32) | made, pa.array(list(codes), pa.string()), np.bincount(lang, minlength=len(codes)), words.dictionary.take(pa.array(kept % n_words)), kept // n_words, counts, _sequence(ids, fresh))

    for batch in batches:
        langs = [codes.setdefault(x, len(codes)) for x in ("und" if x is None else x for x in batch.column("lang").to_pylist())]
        for words, fresh, text in _words_of_rows(batch):
            lang = np.array(langs, np.int64)[text]
            if size > SHARD_WORDS and len(fresh) and (cut := int(np.argmax(fresh))) + int(fresh.any()):
                held.append((words.slice(0, cut), fresh[:cut], lang[:cut]))
                yield shard()
                size = 0
                words, fresh, lang = words.slice(cut), fresh[cut:], lang[cut:]
            held.append((words, fresh, lang))
            size += len(fresh)
    if size:
        yield shard()
    pa.default_memory_pool().release_unused()


def _words_of_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """As _words_of, with row numbers of the batch."""
    numbered = pa.record_batch([batch.column("text"), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
    at = 0
    for part in chunks([numbered], "text", SPAN_BYTES):
        for words, fresh, text in _words_of(part):
            yield words, fresh, text + at
        at += part.num_rows


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the words in order of the first `depth` (a power of two) words of what follows in their piece, the words left in the piece there, and the LCPs.

    ids: word ids with 0 between pieces. Prefix doubling: ranks by one word, then by two, then by four. An LCP is that of a suffix and the one before, up to depth.
    """
    at = np.flatnonzero(ids)
    ends = np.flatnonzero(np.append(ids, 0) == 0)
    room = (ends[np.searchsorted(ends, at)] - at).astype(np.int32)
    rank = np.append(ids, np.zeros(depth, ids.dtype)).astype(np.int64)
    k, order = 1, np.argsort(rank[at], kind="stable") if depth == 1 else None
    while k < depth:
        key = rank[at] * (int(rank.max(initial=0)) + 1) + np.where(room > k, rank[at + k], 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        rank[at[order]] = new
        k *= 2
    place, left = at[order], room[order]
    lcp = np.zeros(len(place), np.int8)
    same = np.ones(max(0, len(place) - 1), bool)
    for k in range(depth):
        wide = np.append(ids, np.zeros(depth, ids.dtype))
        same &= (left[1:] > k) & (left[:-1] > k) & (wide[place[1:] + k] == wide[place[:-1] + k])
        lcp[1:] += same
    return place, left, lcp


def intervals(place: np.ndarray, left: np.ndarray, lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The LCP intervals of phrases of `length` words: the first position of each, its count, and the interval of every suffix (-1: too short)."""
    long_enough = left >= length
    opens = long_enough & (lcp < length)
    number = np.cumsum(opens) - 1
    counts = np.bincount(number[long_enough], minlength=int(opens.sum()))
    return place[opens], counts, np.where(long_enough, number, -1)


def _keys(words: pa.Array, langs: pa.Array, lang_of: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The keys of the phrases at some positions: words joined by spaces, a tab, the language. No word has a tab or a space."""
    parts = [words.take(pa.array(ids[at + k] - 1)) for k in range(length)]
    phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
    return pc.binary_join_element_wise(phrase, langs.take(pa.array(lang_of[ids[at] - 1])), "\t")


class _Rows:
    """A shard as a task reads it."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        row = {name: batch.column(name)[k] for name in batch.schema.names}
        self.shard, self.langs = row["shard"].as_py(), row["langs"].values
        data, lengths, self.lang_of, self.counts, self.ids = (_unsqueeze(row[name].as_buffer(), t) for name, t in zip(_SHARD_NAMES[3:], (np.uint8, np.int32, np.int32, np.int64, np.int32), strict=True))
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        self.words = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        self.bits, self.names = (row[c].as_py() if c in row else None for c in ("bits", "names"))

    def hashes(self) -> np.ndarray:
        """A 48-bit hash of each (lang, word) of the dictionary; words whose hashes are equal are only judged alike by the filter."""
        data, bounds = raw(self.words)
        of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        return mix(span_hashes(data, bounds[:-1], bounds[1:]) ^ of_lang[self.lang_of]) >> np.uint64(16)

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases of so many words, by the suffix array: first position, count and hash of each, and at each position the phrase's number or -1."""
        place, left, lcp = suffix_array(self.ids, 2 if length == 2 else 4)
        at, counts, number = intervals(place, left, lcp, length)
        word, total = np.concatenate((np.zeros(1, np.uint64), self.hashes())), np.zeros(len(at), np.uint64)
        for k in range(length):
            total = total * np.uint64(0x9E3779B97F4A7C15) + word[self.ids[at + k]]
        of = np.full(len(self.ids), -1, np.int64)
        of[place] = number
        return at, counts, mix(total) >> np.uint64(16), of


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Rows(batch, k)


# ---- the filter: hashes and counts of all shards meet by ranges of hashes, and one bit comes back for each ----


def _ranges(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the 48-bit hashes, and the bounds in it of each of `parts` equal ranges of hashes."""
    order = np.argsort(hashes)
    part = ((hashes[order] >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
    return order, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _of_words(x: _Rows) -> tuple[np.ndarray, np.ndarray]:
    return x.hashes(), x.counts


def _sent(counted: Callable[[_Rows], tuple[np.ndarray, np.ndarray]], parts: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            hashes, counts = counted(x)
            order, bounds = _ranges(hashes, parts)
            hashes, counts = hashes[order], counts[order].astype(np.uint64)
            some = np.flatnonzero(bounds[1:] > bounds[:-1])
            packed = []
            for k in some.tolist():
                mine = hashes[bounds[k] : bounds[k + 1]]
                packed.append((_squeeze(np.diff(mine, prepend=np.uint64(0))), _squeeze(counts[bounds[k] : bounds[k + 1]])))
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), x.shard, np.int64)), *(pa.array([p[c] for p in packed], pa.binary()) for c in (0, 1))], names=["part", "shard", "hashes", "counts"])

    return sent


def _held_by_part(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Each part with its rows, which come in order of part; one part is held at a time."""
    part, held = None, []
    for batch in batches:
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *columns)), strict=True):
            if p != part:
                if held:
                    yield part, held
                part, held = p, []
            held.append(tuple(row))
    if held:
        yield part, held


def _judged(least: int):
    """For each range of hashes, which of the sent ones occur at least so often over all shards; rows come in order of part, and one part is held at a time."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _held_by_part(batches, ("shard", "hashes", "counts")):
            hashes = [np.cumsum(_unsqueeze(h, np.uint64)) for _, h, _ in held]
            every, of = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(of, np.concatenate([_unsqueeze(c, np.uint64) for _, _, c in held]).astype(np.float64), len(every))  # exact below 2 ** 53
            stays = (total >= least)[of]
            edges = np.cumsum([0, *map(len, hashes)])
            bits = [np.packbits(stays[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([pa.array([s for s, _, _ in held], pa.int64()), pa.array([part] * len(held), pa.int32()), pa.array(bits, pa.binary())], names=["shard", "part", "bits"])

    return judged


def _with_bits(shards: DataFrame, counted: Callable, least: int, parts: int) -> DataFrame:
    """shards with a bit for each of what is counted in them, in order of hash and by ranges: whether it may be frequent. A list is no longer than its shard."""
    sent = shards.mapInArrow(_sent(counted, parts), "part int, shard long, hashes binary, counts binary")
    judged = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_judged(least), "shard long, part int, bits binary")
    bits = judged.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "bits"))), lambda x: x.bits).alias("bits"))
    return shards.join(bits.hint("shuffle_hash"), "shard", "left")


def _staying(hashes: np.ndarray, bits: list[bytes] | None, parts: int) -> np.ndarray:
    """The flags of what a shard had sent, in its own order."""
    order, bounds = _ranges(hashes, parts)
    sizes = np.diff(bounds)
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(bits or [], sizes[sizes > 0].tolist(), strict=True)]
    out = np.zeros(len(hashes), bool)
    out[order] = np.concatenate(flags).astype(bool) if flags else False
    return out


def _trim(parts: int):
    """Shards cut at the words that cannot be frequent."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            stays = np.flatnonzero(_staying(x.hashes(), x.bits, parts))
            new = np.zeros(len(x.words) + 1, np.int32)
            new[stays + 1] = np.arange(1, len(stays) + 1)
            ids = new[x.ids]
            ids = ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))[: len(ids)]]  # one 0 is enough
            yield _shard_row(x.shard, x.langs, np.zeros(0, np.int64), x.words.take(pa.array(stays)), x.lang_of[stays], x.counts[stays], ids)

    return trim


class _Merged:
    """Phrases of several shards of a task, each once: words are numbered over these shards, and a phrase is the numbers of its words. A test holds it; phrase_counts uses names instead."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.langs: list[pa.Array] = []
        self.phrases: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {k: [] for k in (1, 2, 3, 4)}
        self.rows = 0

    def add(self, x: _Rows, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """A shard, and by length the positions and counts of its phrases."""
        self.words.append(x.words)
        self.langs.append(x.langs.take(pa.array(x.lang_of)))
        self.phrases[1].append((len(self.words) - 1, np.arange(len(x.words), dtype=np.int32)[None], x.counts))
        for length, (at, counts) in found.items():
            self.phrases[length].append((len(self.words) - 1, np.stack([x.ids[at + k] - 1 for k in range(length)]), counts.astype(np.int32)))
        self.rows += len(x.words) + sum(len(at) for at, _ in found.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        words, langs = pa.concat_arrays(self.words), pa.concat_arrays(self.langs)
        number = pc.binary_join_element_wise(words, langs, "\t").dictionary_encode().indices.to_numpy()
        _, of = np.unique(number, return_index=True)
        words, langs, every = words.take(pa.array(of)), langs.take(pa.array(of)), np.arange(len(of))
        of_shard = np.split(number.astype(np.int64), np.cumsum(list(map(len, self.words)))[:-1])
        for length, held in self.phrases.items():
            if not held:
                continue
            ids = np.concatenate([of_shard[k][local] for k, local, _ in held], axis=1)
            code = ids[0]
            for k in range(1, length):
                code = np.unique(code, return_inverse=True)[1] * len(words) + ids[k]
            _, first, place = np.unique(code, return_index=True, return_inverse=True)
            counts = np.zeros(len(first), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, _, n in held]))
            ids, at = ids[:, first].T.ravel() + 1, np.arange(len(first)) * length
            for k in range(0, len(at), BATCH_ROWS):
                part = slice(k, k + BATCH_ROWS)
                yield pa.record_batch([_keys(words, langs, every, ids, at[part], length), pa.array(counts[part]), pa.array(np.full(len(at[part]), length, np.int32))], names=["key", "n", "length"])


#: Phrases of a task that are merged at once; shards are held until they have more.
MERGED_ROWS = 1 << 21


def _phrases_of(parts: int):
    """Phrases that may be frequent, key, count and length: the words and pairs of shards, the triples that stay, and phrases of four words whose triples both stay. A task's shards are merged first.

    A test holds it; phrase_counts does not use it, for a phrase is a row in each task here, which grows faster than the input."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for x in _rows_of(batches):
            triple, counts, hashes, of = x.grams(3)
            stays = np.append(_staying(hashes, x.bits, parts), False)
            pair, pair_counts, *_ = intervals(*suffix_array(x.ids, 2), 2)
            four, four_counts, *_ = intervals(*suffix_array(x.ids, 4), 4)
            both = stays[of[four]] & stays[of[four + 1]] if len(four) else np.zeros(0, bool)
            merged.add(x, {2: (pair, pair_counts), 3: (triple[stays[:-1]], counts[stays[:-1]]), 4: (four[both], four_counts[both])})
            del triple, counts, hashes, of, stays, pair, pair_counts, four, four_counts, both
            if merged.rows > MERGED_ROWS:
                yield from merged.batches()
                merged = _Merged()
        if merged.rows:
            yield from merged.batches()

    return phrases


# ---- names: keys and counts of all shards meet by ranges, and each key that is frequent gets an id that all shards share ----

#: What a range gives back: to each shard, in the order in which it sent its keys, a bit for each and the ranks of those that stay; and without a shard each key that stays, once: its id, its word and language or the ids of its two parts, and its count.
NAMED = "shard long, part int, bits binary, ranks binary, id long, word string, first long, second long, n long"


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by parts, equal in hashes, and the bounds of each part in it; the keys of a part stay in their order."""
    part = ((mix(hashes) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two ids that stand side by side, by the suffix array: the keys, ascending, their counts, and at each position the key's number or -1."""
    place, left, lcp = suffix_array(ids, 2)
    at, counts, number = intervals(place, left, lcp, 2)
    of = np.full(len(ids), -1, np.int64)
    of[place] = number
    return (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64), counts, of


def _sent_keys(shard: int, bounds: np.ndarray, columns: list[np.ndarray | pa.Array], packs: list[Callable]) -> pa.RecordBatch:
    """A row for each part that has keys."""
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    packed = [pa.array([pack(x[int(bounds[k]) : int(bounds[k + 1])]) for k in some.tolist()], pa.binary()) for x, pack in zip(columns, packs, strict=True)]
    return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), shard, np.int64)), *packed], names=["part", "shard", "first", "second", "counts"])


def _gaps(values: np.ndarray) -> bytes:
    return _squeeze(np.diff(values, prepend=values.dtype.type(0)))


def _sent_words(parts: int):
    """The words of shards with their languages, and their counts."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            order, bounds = _dealt(x.hashes(), parts)
            keys = _keys(x.words, x.langs, x.lang_of, np.arange(1, len(order) + 1), order, 1)
            packs = [lambda k: _squeeze(raw(k)[0]), lambda k: _squeeze(np.diff(raw(k)[1]).astype(np.int32)), _squeeze]
            yield _sent_keys(x.shard, bounds, [keys, keys, x.counts[order]], packs)

    return sent


def _sent_neighbours(parts: int):
    """The neighbours in the ids of shards, and their counts."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, _ in _sequences(batches):
            keys, counts, _ = _neighbours(ids)
            order, bounds = _dealt(keys, parts)
            keys = keys[order]
            yield _sent_keys(shard, bounds, [(keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32).view(np.int32), counts[order].astype(np.int64)], [_gaps, _squeeze, _squeeze])

    return sent


def _distinct_words(held: list[tuple]) -> tuple[list[int], np.ndarray, pa.Array]:
    """How many words each shard has, the number of each word in order, and the distinct words."""
    lengths, words = [_unsqueeze(x, np.int32) for x in (h[2] for h in held)], []
    for n, h in zip(lengths, held, strict=True):
        ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        words.append(pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(_unsqueeze(h[1], np.uint8))]))
    coded = pa.concat_arrays(words).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return list(map(len, lengths)), place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _distinct_neighbours(held: list[tuple]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The same of neighbours, as keys."""
    keys = [(np.cumsum(_unsqueeze(a, np.int32), dtype=np.int64).astype(np.uint64) << np.uint64(32)) | _unsqueeze(b, np.int32).astype(np.uint64) for _, a, b, _ in held]
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    return list(map(len, keys)), of, every


def _named(least: int, parts: int, distinct: Callable):
    """For each part, its keys that occur at least so often over all shards, counted exactly and with ids that depend on the keys alone."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _held_by_part(batches, ("shard", "first", "second", "counts")):
            sizes, of, every = distinct(held)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, of, np.concatenate([_unsqueeze(h[3], np.int64) for h in held]))
            frequent = total >= least
            rank = np.cumsum(frequent) - 1
            edges, stays = np.cumsum([0, *sizes]), frequent[of]
            bits, ranks = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                bits.append(np.packbits(stays[a:b]).tobytes())
                ranks.append(_gaps(rank[of[a:b][stays[a:b]]].astype(np.int32)))
            found = np.flatnonzero(frequent)
            ids = rank[found] * parts + part + 1
            if len(ids) and ids[-1] >= 1 << 31:
                raise ValueError("more frequent phrases than 31 bits can number")
            given = {"shard": pa.array([h[0] for h in held], pa.int64()), "part": pa.array([part] * len(held), pa.int32()), "bits": pa.array(bits, pa.binary()), "ranks": pa.array(ranks, pa.binary())}
            yield _named_batch(given)
            columns = {"word": every.take(pa.array(found))} if isinstance(every, pa.Array) else {"first": pa.array((every[found] >> np.uint64(32)).astype(np.int64)), "second": pa.array((every[found] & np.uint64(0xFFFFFFFF)).astype(np.int64))}
            yield _named_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(total[found])} | columns)

    return named


_NAMED_TYPES = {"shard": pa.int64(), "part": pa.int32(), "bits": pa.binary(), "ranks": pa.binary(), "id": pa.int64(), "word": pa.string(), "first": pa.int64(), "second": pa.int64(), "n": pa.int64()}


def _named_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns, and nulls for the others."""
    rows = len(next(iter(columns.values())))
    return pa.record_batch([columns[c] if c in columns else pa.nulls(rows, t) for c, t in _NAMED_TYPES.items()], names=list(_NAMED_TYPES))


def _ids_of(hashes: np.ndarray, names: list[dict] | None, parts: int) -> np.ndarray:
    """The ids of the keys that a shard had sent, in its own order; 0 for those that are not frequent."""
    order, bounds = _dealt(hashes, parts)
    out = np.zeros(len(hashes), np.int32)
    for x in names or []:
        mine = order[bounds[x["part"]] : bounds[x["part"] + 1]]
        stays = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(mine)).astype(bool)
        out[mine[stays]] = np.cumsum(_unsqueeze(x["ranks"], np.int32), dtype=np.int64) * parts + x["part"] + 1
    return out


#: A shard's texts as ids that all shards share, compressed; 0 is where no frequent phrase begins.
IDS = "shard long, ids binary"


def _ids_row(shard: int, ids: np.ndarray) -> pa.RecordBatch:
    ids = ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))[: len(ids)]]  # one 0 is enough
    return pa.record_batch([pa.array([shard], pa.int64()), pa.array([_squeeze(ids)], pa.binary())], names=["shard", "ids"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[dict] | None]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("shard")[k].as_py(), _unsqueeze(batch.column("ids")[k].as_buffer(), np.int32), batch.column("names")[k].as_py() if "names" in batch.schema.names else None


def _word_ids(parts: int):
    """The texts of shards by the words' ids."""

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            yield _ids_row(x.shard, np.concatenate((np.zeros(1, np.int32), _ids_of(x.hashes(), x.names, parts)))[x.ids])

    return of_words


def _neighbour_ids(parts: int):
    """The texts of shards by the ids of neighbours, each at the place of its first: neighbours among these are phrases longer by a word."""

    def of_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, names in _sequences(batches):
            keys, _, of = _neighbours(ids)
            yield _ids_row(shard, np.append(_ids_of(keys, names, parts), np.int32(0))[of])  # -1 is the last, which has no id

    return of_neighbours


def _names(shards: DataFrame, sent: Callable, distinct: Callable, least: int, parts: int) -> DataFrame:
    """NAMED of the keys that shards send."""
    rows = shards.mapInArrow(sent(parts), "part int, shard long, first binary, second binary, counts binary")
    return stored(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_named(least, parts, distinct), NAMED), "phrase-names")


def _with_names(shards: DataFrame, named: DataFrame) -> DataFrame:
    """shards with what was given back to each; a list is no longer than its shard."""
    names = named.where("shard is not null").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("part", "bits", "ranks"))).alias("names"))
    return shards.join(names.hint("shuffle_hash"), "shard", "left")


def _longer(named: DataFrame, shorter: DataFrame) -> DataFrame:
    """Named neighbours as id, phrase, last word, lang and n: the first's phrase and the second's last word."""
    rows = named.where("shard is null").select("id", "first", "second", "n")
    total = rows.count()
    for part, columns in (("first", ["phrase", "lang"]), ("second", ["last"])):
        asked = rows.groupBy(F.col(part).alias("id")).agg(F.count("*").alias("asked"))
        few = asked.join(shorter.select("id", *columns), "id").withColumnRenamed("id", part)
        rows = join_by(rows, few, part, "asked", total).drop("asked")
    return stored(rows.select("id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "lang", "n"), "phrase-level")


#: Words of the corpus for each range of hashes.
PART_WORDS = 4_000_000


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, length) of all phrases of one to four words that occur at least so often, and (lang, total) of words.

    A phrase is frequent only if both phrases that are shorter by a word are. So 48-bit hashes of a shard's words, with counts, first meet those of all other shards, one bit for each comes
    back, and the shard is cut at rare words; equal hashes let a rare word through this filter, never into the result. The words that are left meet by themselves: their counts are summed
    exactly, and each frequent one gets an id for all shards. Two word ids side by side are a pair's exact key, two ids of pairs a triple's, two ids of triples that of four words; each
    time the frequent keys get ids, and the shard's texts are written in these. A frequent phrase is one row, made where its counts meet, however many shards have it.
    """
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    shards = stored(docs.mapInArrow(_encode, SHARD), "phrase-shards")
    totals = stored(shards.select(F.inline(F.arrays_zip("langs", "lang_words"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("lang_words").alias("total")).where("total > 0"), "phrase-totals")
    words = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    parts = max(tasks(docs.sparkSession), int(words) // PART_WORDS + 1)
    trimmed = stored(_with_bits(shards, _of_words, least, parts).mapInArrow(_trim(parts), SHARD), "phrase-shards")
    forget(shards)
    named = _names(trimmed, _sent_words, _distinct_words, least, parts)
    texts = stored(_with_names(trimmed, named).mapInArrow(_word_ids(parts), IDS), "phrase-ids")
    word = F.substring_index("word", "\t", 1)
    level = stored(named.where("shard is null").select("id", word.alias("phrase"), word.alias("last"), F.expr("substr(word, locate('\t', word) + 1)").alias("lang"), "n"), "phrase-level")
    forget(trimmed, named)
    levels = [level]
    for length in (2, 3, 4):
        named = _names(texts, _sent_neighbours, _distinct_neighbours, least, parts)
        if length < 4:
            before, texts = texts, stored(_with_names(texts, named).mapInArrow(_neighbour_ids(parts), IDS), "phrase-ids")
            forget(before)
        levels.append(_longer(named, levels[-1]))
        forget(named)
    forget(texts)
    every = [x.select(F.concat_ws("\t", "phrase", "lang").alias("key"), "n", F.lit(k).alias("length")) for k, x in enumerate(levels, 1)]
    phrases = stored(functools.reduce(DataFrame.unionAll, every), "phrases")
    forget(*levels)
    return phrases, totals


def _exact(column) -> F.Column:
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


#: Rows of one group that one task ranks.
RANKED_ROWS = 200_000


def top_of_groups(rows: DataFrame, group: str, order: list, spread: str, k: int, total: int) -> DataFrame:
    """The first k rows of each group with `rank`; groups are dealt to parts of RANKED_ROWS rows at most on average, whose first k meet, so that no group is one task."""
    parts = total // RANKED_ROWS + 1
    while parts > 1:
        dealt = Window.partitionBy(group, F.pmod(F.xxhash64(spread), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= k).drop("rank")
        parts = parts * k // RANKED_ROWS + 1 if parts > RANKED_ROWS // k else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


#: Fixed value of the contract: what scores are multiplied by before they are floored.
SCALE = 2_000_000


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80) -> DataFrame:
    """The phrases of two to four words that stick together most, for each language.

    Phrases are counted by suffix arrays of shards, see phrase_counts. A candidate is cut into two parts in every way; the weakest cut (ties: the smaller k) gives l, r
    and score = floor(2000000 a / (l + r)). A candidate is dropped if a longer candidate holds it and has at least inside_percent of its count. Counts of parts are joined
    by key, with hot parts broadcast, at most 4,096 of them.

    Returns lang, rank, phrase, a, l, r, n, score: per language the first `top` by score, then a, both descending, then phrase. A null lang is "und" and so one with that
    name; null and empty texts have no words; repeated rows count each. A piece of any length is counted whole; very long texts are split in spans. Empty tables give no rows.
    Other columns are not read, doc_id among them.
    """
    phrases, totals = phrase_counts(docs, least)
    phrase, lang = F.substring_index("key", "\t", 1), F.expr("substr(key, locate('\t', key) + 1)")
    candidates = phrases.where("length > 1").select("key", F.col("n").alias("a"), "length", F.split(phrase, " ").alias("w"), lang.alias("lang"))
    candidates = stored(candidates, "phrase-candidates")
    count = candidates.count()

    def key_of(start, length) -> F.Column:
        return F.concat(F.array_join(F.slice("w", start, length), " "), F.lit("\t"), F.col("lang"))

    cuts = candidates.select("key", "a", "length", "w", "lang", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", key_of(F.lit(1), F.col("k")).alias("left"), key_of(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        asked = cuts.groupBy(F.col(part).alias("key")).agg(F.count("*").alias("asked"))
        counts = asked.join(phrases.select("key", "n"), "key").select(F.col("key").alias(part), F.col("n").alias(name), "asked")
        cuts = join_by(cuts, counts, part, "asked", 3 * count).drop("asked")
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("length > 2").select("a", "length", "w", "lang", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m"))
    inner = inner.select("a", "m", "w", "lang", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("s"))
    around = inner.select(key_of(F.col("s"), F.col("m")).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    stays = F.coalesce(100 * _exact("longer") < inside_percent * _exact("a"), F.lit(True))
    rows = candidates.join(around, "key", "left").where(stays).join(scored, "key").select("lang", F.array_join("w", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = top_of_groups(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top, count)
    best = best.join(F.broadcast(totals.withColumnRenamed("total", "n")), "lang") if totals.count() <= BROADCAST_IDS else best.join(totals.withColumnRenamed("total", "n"), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
