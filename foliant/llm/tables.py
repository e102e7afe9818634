"""Lookup tables in numpy that several operators share."""

from __future__ import annotations

import numpy as np

ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_NO_KEY = np.uint64((1 << 64) - 1)


class Table:
    """Whole numbers (of 31 bits) by 64-bit key, looked up for arrays of keys: arrays of slots, each for the keys whose slots before were taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18):
        keys, values, self.shift = keys.astype(np.uint64), values.astype(np.int32), np.uint64(64 - bits)
        self.tables = []
        for odd in ODD:
            slot = (keys * odd) >> self.shift
            _, first = np.unique(slot, return_index=True)
            held, value = np.full(1 << bits, _NO_KEY), np.full(1 << bits, -1, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((odd, held, value))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]
            if not len(keys):
                break
        else:
            raise ValueError("keys don't fit the table")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        odd, held, value = self.tables[0]
        slot = (keys * odd) >> self.shift
        there = held[slot]
        out = np.where(there == keys, value[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there != _NO_KEY))
        for odd, held, value in self.tables[1:]:
            slot = (keys[open_] * odd) >> self.shift
            there = held[slot]
            met = there == keys[open_]
            out[open_[met]] = value[slot[met]]
            open_ = open_[~met & (there != _NO_KEY)]
        return out
