"""Minimal perfect hashes over byte strings, in shards, with stored keys.

A shard's keys are hashed to 64 bits (xxHash64, seed 42, the value of
Spark's ``xxhash64``).  Level by level every remaining key marks a place in
a bitmap of twice as many bits; keys that are alone in their place stay
there, the others go on to the next level.  A key's slot is the number of
marks before its own, so n keys have the slots 0 to n-1.  Keys that no
level separates (equal 64-bit hashes) take the last slots and are listed.
Any string leads to some slot or none, so a lookup compares the key that is
stored for the slot.
"""

from __future__ import annotations

import pickle

import numpy as np
import xxhash

from lifetrail.llm.textbytes import mix

LEVELS = 40
SEED = 42
GOLDEN = 0x9E3779B97F4A7C15


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], np.uint64)


def places(h: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * GOLDEN % (1 << 64))) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(keys: list[bytes]) -> bytes:
    """The packed hash of distinct keys: bitmaps by level, keys by slot, and how many of them are listed."""
    h, rest, order, levels = hashes(keys), np.arange(len(keys)), [], []
    while len(rest) and len(levels) < LEVELS:
        size = 2 * len(rest)
        at = places(h[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        levels.append((size, np.packbits(alone).tobytes()))
        order.append(rest[placed][np.argsort(at[placed], kind="stable")])
        rest = rest[~placed]
    by_slot = [keys[i] for i in np.concatenate([*order, rest]).astype(np.int64)] if keys else []
    ends = np.cumsum([len(k) for k in by_slot], dtype=np.int64)
    return pickle.dumps((levels, len(rest), b"".join(by_slot), ends.astype("<u4").tobytes()))


def keys_of(packed: bytes) -> list[bytes]:
    """A shard's keys by slot."""
    _, _, blob, ends = pickle.loads(packed)
    ends = np.frombuffer(ends, "<u4").tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class Shards:
    """Some of a vocabulary's shards, looked up together.  Slots are
    numbered through all of them: a shard's slots start at ``base[shard]``."""

    def __init__(self, total: int, packed: dict[int, bytes]):
        self.total = total
        loaded = {s: pickle.loads(p) for s, p in sorted(packed.items())}
        self.n = np.zeros(total, np.int64)
        for s, (_, _, _, ends) in loaded.items():
            self.n[s] = len(ends) // 4
        self.base = np.concatenate([[0], np.cumsum(self.n)])
        self.levels, done = [], self.base[:-1].copy()
        for level in range(max((len(l) for l, *_ in loaded.values()), default=0)):
            size, start, marks, number, at = np.ones(total, np.int64), np.zeros(total, np.int64), [np.zeros(1, bool)], [np.zeros(1, np.int32)], 1
            for s, (levels, *_) in loaded.items():
                if level < len(levels):
                    size[s], start[s] = levels[level][0], at
                    bits = np.unpackbits(np.frombuffer(levels[level][1], np.uint8), count=size[s]).astype(bool)
                    marks.append(bits)
                    number.append((np.cumsum(bits) - 1).astype(np.int32))
                    at += len(bits)
            marks = np.concatenate(marks)
            self.levels.append((size, start, marks, np.concatenate(number), done.copy()))
            for s in loaded:
                done[s] += int(marks[start[s]:start[s] + size[s]].sum()) if start[s] else 0
        self.blob = b"".join(x[2] for x in loaded.values())
        ends, shift = [np.zeros(1, np.int64)], 0
        for _, _, blob, e in loaded.values():
            ends.append(np.frombuffer(e, "<u4").astype(np.int64) + shift)
            shift += len(blob)
        self.ends = np.concatenate(ends)
        self.listed = {}
        for s, (_, listed, _, _) in loaded.items():
            for slot in range(int(self.base[s + 1]) - listed, int(self.base[s + 1])):
                self.listed[self.key(slot)] = slot

    @property
    def slots(self) -> int:
        return int(self.base[-1])

    def key(self, slot: int) -> bytes:
        return self.blob[self.ends[slot]:self.ends[slot + 1]]

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 for strings that are not keys of these shards."""
        h = hashes(keys)
        shard = np.mod(h.view(np.int64), self.total)
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, start, marks, number, done) in enumerate(self.levels):
            s = shard[open_]
            at = places(h[open_], level, size[s])
            at = np.where(start[s] > 0, at + start[s], 0)
            hit = marks[at]
            slot[open_[hit]] = done[s[hit]] + number[at[hit]]
            open_ = open_[~hit]
        for i in open_.tolist() if self.listed else ():
            slot[i] = self.listed.get(keys[i], -1)
        a, b = self.ends[slot].tolist(), self.ends[slot + 1].tolist()  # slot -1 is replaced below
        blob = self.blob
        same = np.fromiter((blob[x:y] == k for x, y, k in zip(a, b, keys)), bool, len(keys))
        return np.where((slot >= 0) & same, slot, -1)
