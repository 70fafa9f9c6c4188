"""Static binary-fuse filters of 64-bit keys, built and probed with numpy: 3 probes, about 1.13 fingerprints a key."""

from __future__ import annotations

import numpy as np

from vahi.llm.common import distinct, mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _shape(n: int) -> tuple[int, int]:
    """Slots of a segment (a power of two) and number of segments for n keys; more room for few keys."""
    segment = 1 << int(min(18, max(2, np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    slots = int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))))) + 4
    return segment, max(3, -(-slots // segment) + 2)


def _probes(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots (in consecutive segments) and the 16-bit fingerprint of each key."""
    h = mix(keys + np.uint64(seed) * _GOLD)
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    in_segment = np.uint64(segment - 1)
    g = mix(h ^ _GOLD)
    slots = np.stack([(first + np.uint64(k)) * np.uint64(segment) + ((g >> np.uint64(18 * k)) & in_segment) for k in range(3)], axis=1).astype(np.int64)
    return slots, ((h ^ (g >> np.uint64(48))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> tuple[int, bytes]:
    """Seed and fingerprints of a filter that holds these distinct uint64 keys."""
    keys = distinct(np.asarray(keys, np.uint64))
    segment, segments = _shape(len(keys))
    for seed in range(1, 1000):
        slots, prints = _probes(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=segment * segments)
        held = np.zeros(len(count), np.int64)  # the sum of the key numbers in a slot; with one key left it is that key
        np.add.at(held, slots.ravel(), np.repeat(np.arange(len(keys)), 3))
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, at = np.unique(held[alone], return_index=True)
            rounds.append((who, alone[at]))
            np.subtract.at(count, slots[who].ravel(), 1)
            np.subtract.at(held, slots[who].ravel(), np.repeat(who, 3))
            left -= len(who)
        if not left:
            break
    else:
        raise RuntimeError("no seed gives a peelable filter")
    table = np.zeros(segment * segments, np.uint16)
    for who, slot in reversed(rounds):
        around = table[slots[who]]
        table[slot] = prints[who] ^ around[:, 0] ^ around[:, 1] ^ around[:, 2]  # the slot itself is still 0
    return seed, np.array([segment, segments], "<u4").tobytes() + table.astype("<u2").tobytes()


def might_hold(keys: np.ndarray, seed: int, packed: bytes) -> np.ndarray:
    """For each key whether the filter may hold it: always for its own keys, for others once in 65,536 times."""
    segment, segments = (int(x) for x in np.frombuffer(packed, "<u4", 2))
    slots, prints = _probes(np.asarray(keys, np.uint64), seed, segment, segments)
    table = np.frombuffer(packed, "<u2", offset=8)
    return (table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]]) == prints
