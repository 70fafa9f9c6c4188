"""Ids of texts by way of their distinct pieces."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from vahi.llm import token_counts as T

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'x", "'r", "'l", "re", "s", "word", "Straße", "élan", "12", "²¼", "_", "...", "\xad", "ªº", "µ", " ", "  ", "\n", "\n\n", "\t", "\x85", "\xa0", "\x1c", "\x00", "\r\n", "averyveryverylongwordofmany", "!" * 20]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(n)] + ["", " ", "\n", "'", "'s", "a'", "a'r", "x 'l", "Ł’un 日本 'll"]


def encoders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=T.BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    asked = []
    return fast, asked, T.Pieces(lambda x: (asked.append(x), fast.encode_to_numpy(x))[1])


def test_the_pattern_is_the_vocabularys():
    assert T.BYTE_LEVEL == public_tokenizers.PATTERN


def test_ids_are_those_of_the_library():
    slow, to_ids = T.tokenizer(JSON), T.id_encoder(JSON, RANKS, public_tokenizers.PATTERN)
    for seed in range(3):
        texts = odd_texts(500, seed)
        for text, ids in zip(texts, to_ids(texts), strict=True):
            assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_piece_is_asked_for_once():
    _, asked, pieces = encoders()
    first = pieces([b"one two one two", b" two\n three"])
    assert sorted(x for part in asked for x in part.split("\n") if x) == [" one", " three", " two", "one"]
    asked.clear()
    again = pieces([b"one two three one", b"one two one two"])
    assert not any(x.strip() for x in asked) and again[1].tolist() == first[0].tolist()


def test_equal_hashes_and_a_full_table_change_nothing(monkeypatch):
    fast, _, pieces = encoders()
    texts = [x for x in odd_texts(300, 9) if all(ord(c) < 256 for c in x)]
    want = [fast.encode(x) for x in texts]
    monkeypatch.setattr(T, "KEPT_PIECES", 20)
    for k in range(0, len(texts), 7):
        assert [x.tolist() for x in pieces([t.encode("latin-1") for t in texts[k : k + 7]])] == want[k : k + 7]
    monkeypatch.setattr(T, "mix", lambda x: x * np.uint64(0))
    assert pieces([b" alpha bravo"]) is None  # two pieces of one length: told apart by their bytes
    to_ids = T.id_encoder(JSON, RANKS, public_tokenizers.PATTERN)
    assert [x.tolist() for x in to_ids(texts)] == want
