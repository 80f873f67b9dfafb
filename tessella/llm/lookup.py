"""Lookups of whole arrays of 64-bit keys."""

from __future__ import annotations

import numpy as np


class KeyTable:
    """An open-addressed hash table from distinct keys to their positions."""

    EMPTY = -1

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        slots = (1 << bits) + len(keys)  # room for the longest possible chain at the end
        self._keys = np.zeros(slots, np.int64)
        self._places = np.full(slots, self.EMPTY, np.int64)
        self._probes = 1
        for place, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            n = 1
            while self._places[at] != self.EMPTY:
                at, n = at + 1, n + 1
            self._keys[at], self._places[at] = key, place
            self._probes = max(self._probes, n)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for those that aren't in the table."""
        at = self._slots(np.ascontiguousarray(keys, np.int64))
        out = np.full(len(keys), self.EMPTY, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self._probes):
            here = at[todo]
            places = self._places[here]
            hit = (self._keys[here] == keys[todo]) & (places != self.EMPTY)
            out[todo[hit]] = places[hit]
            todo = todo[~hit & (places != self.EMPTY)]
            if not len(todo):
                break
            at[todo] += 1
        return out
