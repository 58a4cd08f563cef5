"""A table of values (token ids, word slots) of the distinct chunks of many texts.

Texts are cut into chunks by vector operations on their bytes; a chunk is known by a
64-bit hash, and its values are made once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np

#: Odd multiplier of the hash, a polynomial over the chunk's bytes modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15


def bounds(raw: np.ndarray, space: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start and end: at white space (``space``, also first and last), and before the bytes in ``cut``."""
    first, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    first[1:] = ~space[1:] & (space[:-1] | cut[1:])
    last[:-1] = ~space[:-1] & (space[1:] | cut[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class _Places(dict):
    """Hash of a chunk -> its place in the table; a new chunk gets the next place."""

    def __missing__(self, chunk: int) -> int:
        place = self[chunk] = len(self)
        return place


class ChunkTable:
    def __init__(self) -> None:
        self.places = _Places()
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __len__(self) -> int:
        return len(self.places)

    def keep(self, n: int) -> None:
        """Forget all chunks but the first ``n``; the frequent ones came early."""
        self.places = _Places(islice(self.places.items(), n))
        self.ends = self.ends[:n + 1]
        self.flat = self.flat[:self.ends[-1]]

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of distinct hashes, in ascending order, and which of them are new, in the order of their places."""
        known = len(self.places)
        place = np.fromiter(map(self.places.__getitem__, distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(place >= known)
        return place, new[np.argsort(place[new])]

    def _hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.power) < len(raw):
            for name, base in (("power", FACTOR), ("inverse", pow(FACTOR, -1, 1 << 64))):
                steps = np.full(len(raw), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.power[:len(raw)], out=total[1:])
        size = (end - start).astype(np.uint64) << np.uint64(48)
        return (total[end] - total[start]) * self.inverse[start] ^ size

    def values(self, data: bytes, start: np.ndarray, end: np.ndarray,
               make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all chunks one after the other, and how many there are up to each chunk.

        ``make`` returns the values of new chunks and how many each has.
        """
        if not len(start):
            return self.flat[:0], np.zeros(0, np.int64)
        hashed = self._hashes(np.frombuffer(data, np.uint8), start, end)
        distinct, example, which = np.unique(hashed, return_index=True, return_inverse=True)
        place, new = self._find(distinct)
        if len(new):
            new = example[new]
            chunks = [data[a:b].decode("utf-8") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            flat, sizes = make(chunks)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat.astype("<u4")])
        place = place[which]
        at, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        upto = np.cumsum(size)
        return self.flat[np.repeat(at - upto + size, size) + np.arange(upto[-1])], upto


class SortedChunkTable(ChunkTable):
    """The same with hashes in a sorted array: a fifth of the memory for each chunk, and sorted look-ups."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def keep(self, n: int) -> None:
        early = self.place < n
        self.hashes, self.place = self.hashes[early], self.place[early]
        self.ends = self.ends[:n + 1]
        self.flat = self.flat[:self.ends[-1]]

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, distinct)
        inside = np.minimum(at, max(len(self.hashes) - 1, 0))
        known = self.hashes[inside] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        place = np.empty(len(distinct), np.int64)
        place[known] = self.place[inside[known]]
        place[new] = len(self.hashes) + np.arange(len(new))
        self.hashes = np.insert(self.hashes, at[new], distinct[new])
        self.place = np.insert(self.place, at[new], place[new])
        return place, new
