"""Token counts with a public tokenizer, whole texts, no per-token data leaving the task."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import chunks, mix

#: Words that the cache of one task holds before it starts anew, about 50 MB.
CACHE_WORDS = 400_000
#: Bytes of text that one numbered pass over the tokenizer takes.
BATCH_BYTES = 1 << 18


def tokenizer(path: str):
    """The tokenizer of a file of the `tokenizers` library; special strings inside texts are its special tokens."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: The white space of Unicode, where a tokenizer that drops white space parts words.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(rf"[^{_SPACE}]+")
#: Runs that hold more than ASCII stay whole; others part at contractions, letters, digits and signs, as the vocabulary's own rule does.
_PIECES = re.compile(rf"[^{_SPACE}]*[^\x00-\x7f{_SPACE}][^{_SPACE}]*|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[A-Za-z]+|[0-9]|[^{_SPACE}A-Za-z0-9]+")


def split_words(text: str) -> list[str]:
    """Parts of a text that tokenize apart, for a tokenizer that drops white space; texts that may hold a special string part at white space only."""
    return (_RUNS if "<|" in text else _PIECES).findall(text)


class Cached:
    """What a function makes of strings, asked for in batches and remembered up to CACHE_WORDS strings."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make, self.known = make, {}

    def learn(self, texts: list[list[str]]) -> dict:
        """Make sure that every part of these texts is known."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = set().union(*texts)
        new = list(new)
        self.known.update(zip(new, self.make(new), strict=True))
        return self.known


def token_counts(docs: DataFrame, path: str, limit: int = 2048, split: Callable[[str], list[str]] = split_words) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    split: parts a text where the tokenizer never joins across, so that a long text is many short strings, each distinct string of a task is
    encoded once, and batches are equal in bytes, not in rows. path must be readable on every executor.
    Null and empty texts have 0 bytes and tokens. doc_id may be null or repeated; every row is counted by itself. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        cache = Cached(lambda words: [len(x) for x in encoder.encode_batch_fast(words, add_special_tokens=False)])
        for part in chunks(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in part.column("text").to_pylist()]
            words = [split(x) for x in texts]
            length = cache.learn(words).__getitem__
            tokens = [sum(map(length, x)) for x in words]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


#: Texts with runs this long go to the slower library, whose merging does not grow with the square of a run.
LONG = 10_000
_LONG_RUN = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")


#: Fixed value: the splitting pattern that byte-level vocabularies share, which latin_pieces follows.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters 1, numbers 2, white space 3, others 0, of the first 256 code points.
_LATIN = np.array([3 if re.match(f"[{_SPACE}]", c) else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 0) for c in map(chr, range(256))], np.uint8)


def latin_pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of BYTE_LEVEL start in some texts, a byte a code point below 256; the bounds of texts part pieces too."""
    kind = _LATIN[data]
    white = kind == 3
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    start = first[:-1].copy()
    before, after = white[:-1], white[1:]
    start[1:] |= np.where(after, ~before, np.where(before, data[:-1] != 32, kind[1:] != kind[:-1]))  # one space belongs to what follows it
    start[:-1] |= before & ~after & ~first[1:-1]  # the last blank of several before a word
    wide = np.concatenate((data, np.zeros(2, np.uint8)))
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[~first[quote + 1]]
    x, y, more = wide[quote + 1], wide[quote + 2], ~first[np.minimum(quote + 2, len(data))]
    long = more & (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))  # 're, 've, 'll
    short = (x == 115) | (x == 116) | (x == 109) | (x == 100)  # 's, 't, 'm, 'd
    start[quote[short | long] + 1] = False
    ends = np.concatenate((quote[short] + 2, quote[long] + 3))
    start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


#: Pieces whose ids one task keeps before it starts anew, about 50 MB; longer pieces than PIECE_BYTES are asked for each time.
KEPT_PIECES, PIECE_BYTES = 1 << 20, 15


class Pieces:
    """The ids of texts of code points below 256, whose pieces are made once and then known by their bytes, up to KEPT_PIECES of them.

    A piece is two numbers, its bytes and its length; they are found by a hash of both and then compared.
    """

    def __init__(self, make: Callable[[str], np.ndarray]):
        self.make = make
        self._clear()

    def _clear(self) -> None:
        self.hashes = self.low = self.high = np.zeros(0, np.uint64)
        self.place = self.first = self.many = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _made(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some pieces in one array, where those of each begin there, and how many each has. All but the blank ones are asked for at once, a line each: a line's end is a piece of its own."""
        body, blank = data.tobytes().decode("latin-1"), _LATIN[data[ends - 1]] == 3
        part = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lines, alone = [x for x, y in zip(part, blank.tolist(), strict=True) if not y], [self.make(part[k]) for k in np.flatnonzero(blank)]
        ids = self.make("\n".join(lines))
        between = ids == self.make("\n")[0]
        sizes = np.zeros(len(part), np.int64)
        sizes[blank] = [len(x) for x in alone]
        sizes[~blank] = (np.diff(np.flatnonzero(np.concatenate(([True], between, [True])))) - 1)[: len(lines)]
        order = np.argsort(blank, kind="stable")
        first = np.empty_like(sizes)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids[~between], *alone]).astype(np.uint32), first, sizes

    def __call__(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """The ids of each of some texts; None if two pieces have one hash."""
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        padded = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        data = padded[:-16]
        starts = latin_pieces(data, bounds)
        ends = np.append(starts[1:], len(data))
        length = ends - starts
        short = length <= PIECE_BYTES
        at, n = starts[short], length[short]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        low, high = eight[at] & _MASK[np.minimum(n, 8)], eight[at + 8] & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        hashes = mix(low) + high * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(hashes)
        in_order = hashes[order]
        new = np.concatenate(([True], in_order[1:] != in_order[:-1]))[: len(order)]
        each, of = order[new], np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        if (low != low[each][of]).any() or (high != high[each][of]).any():
            return None
        if len(self.hashes) + len(each) > KEPT_PIECES:
            self._clear()
        found = np.searchsorted(self.hashes, hashes[each])
        known = np.append(self.hashes, np.uint64(0))[found] == hashes[each]
        known &= found < len(self.hashes)
        if (self.low[found[known]] != low[each[known]]).any() or (self.high[found[known]] != high[each[known]]).any():
            return None
        fresh, where = each[~known], found[~known]
        if len(fresh):
            ids, first, many = self._made(data, at[fresh], at[fresh] + n[fresh])
            self.place = np.insert(self.place, where, np.arange(len(fresh)) + len(self.place))
            self.hashes, self.low, self.high = (np.insert(kept, where, x[fresh]) for kept, x in ((self.hashes, hashes), (self.low, low), (self.high, high)))
            self.first, self.many = np.concatenate((self.first, first + len(self.ids))), np.concatenate((self.many, many))
            self.ids = np.concatenate((self.ids, ids))
            found = np.searchsorted(self.hashes, hashes[each])
        ids, first, many = self._made(data, starts[~short], ends[~short])
        place = np.empty(len(starts), np.int64)
        place[short], place[~short] = self.place[found][of], len(self.place) + np.arange(len(many))
        first, many = np.concatenate((self.first, first + len(self.ids)))[place], np.concatenate((self.many, many))[place]
        ids = np.concatenate((self.ids, ids))
        past = np.concatenate(([0], np.cumsum(many)))
        every = ids[np.arange(past[-1]) + np.repeat(first - past[:-1], many)]
        return np.split(every, past[np.searchsorted(starts, bounds[1:-1])]) if texts else []


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def id_encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """A function that gives the ids of each of some texts, by the tokenizer of path.

    ranks_path, pattern: the same byte-level vocabulary as a tiktoken file and its splitting pattern. That library gives the same ids several times faster; with the pattern BYTE_LEVEL each distinct
    piece of texts of code points below 256 is asked for once. Texts with a special string or a very long run still go to the tokenizer itself.
    """
    slow = tokenizer(path)
    if ranks_path is None:
        return lambda texts: [np.array(x.ids, np.uint32) for x in slow.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = Pieces(lambda x: fast.encode_to_numpy(x, disallowed_special=()))

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        latin: dict[int, bytes] = {}
        for k, x in enumerate(texts):
            if "<|" in x or len(x) >= LONG and _LONG_RUN.search(x):
                out[k] = np.array(slow.encode(x, add_special_tokens=False).ids, np.uint32)
            elif pattern == BYTE_LEVEL:
                with suppress(UnicodeEncodeError):
                    latin[k] = x.encode("latin-1")
        for k, ids in zip(latin, pieces(list(latin.values())) or [], strict=False):
            out[k] = ids
        return [fast.encode_to_numpy(x, disallowed_special=()) if ids is None else ids for x, ids in zip(texts, out, strict=True)]

    return encode
