"""Hashed n-gram features and linear models in numpy, shared by the text classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foliant.llm.memory import give_back
from foliant.llm.text import WORD

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(WORD)


def _slots(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(units: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(units) - n + 1), np.uint64)
    for j in range(n):
        h = h * np.uint64(1_000_003) + units[j : len(units) - n + 1 + j]
    return h


def features(text: str, bits: int, chars: tuple[int, ...], words: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values (log(1 + count), of unit length) of the whole text's n-grams."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = [_slots(_grams(points, n), n, bits) for n in chars]
    if words:
        units = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORDS.findall(text)], np.uint64)
        found += [_slots(_grams(units, n), 100 + n, bits) for n in words]
    slots, counts = np.unique(np.concatenate(found), return_counts=True)
    values = np.log1p(counts)
    return slots, values / max(1e-12, float(np.sqrt(values @ values)))


#: Entries that a product takes at a time.
_PART = 1 << 20


class _Sums:
    """Sums of value * x[index] over each group, a run of ``lengths`` entries, taken in parts to bound memory."""

    def __init__(self, lengths: np.ndarray, index: np.ndarray, values: np.ndarray):
        self.index, self.values, self.size = index, values, len(lengths)
        self.groups = np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.groups]
        cuts = np.searchsorted(self.starts, np.arange(0, len(index), _PART))
        self.cuts = np.unique(np.r_[cuts, len(self.groups)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, x = np.zeros(self.size), x.astype(np.float32)
        for g, h in zip(self.cuts[:-1], self.cuts[1:]):
            lo, hi = self.starts[g], self.starts[h] if h < len(self.starts) else len(self.index)
            out[self.groups[g:h]] = np.add.reduceat(np.take(x, self.index[lo:hi]) * self.values[lo:hi], self.starts[g:h] - lo)
        return out


class Rows:
    """Sparse rows, held by row and by column so that both products read memory in order; indices are as small as they fit."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], bits: int):
        self.n, self.dims = len(pairs), 1 << bits
        lengths = np.array([len(s) for s, _ in pairs], np.int64)
        small = np.min_scalar_type(self.dims - 1)
        slots = np.concatenate([np.asarray(s).astype(small) for s, _ in pairs] or [np.zeros(0, small)])
        values = np.concatenate([np.asarray(v, np.float32) for _, v in pairs] or [np.zeros(0, np.float32)])
        pairs.clear()
        order = np.argsort(slots, kind="stable")
        owner = np.repeat(np.arange(self.n, dtype=np.min_scalar_type(max(1, self.n))), lengths)
        self.dot = _Sums(lengths, slots, values)
        owner = owner[order]
        self.back = _Sums(np.bincount(slots, minlength=self.dims), owner, values[order])


def fit(rows: Rows, y: np.ndarray, hinge: bool, use: np.ndarray | None = None, steps: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 and 1: logistic loss or squared hinge, by accelerated full-batch descent."""
    use = np.ones(rows.n) if use is None else use.astype(float)
    total, w, b = max(1.0, use.sum()), np.zeros(rows.dims), 0.0
    ahead, ahead_b, rate = w.copy(), b, 4.0 if not hinge else 0.5
    for step in range(1, steps + 1):
        margin = y * (rows.dot(ahead) + ahead_b)
        slope = -2 * np.maximum(0, 1 - margin) if hinge else -1 / (1 + np.exp(np.clip(margin, -50, 50)))
        err = use * y * slope / total
        new, new_b = ahead - rate * (rows.back(err) + decay * ahead), ahead_b - rate * err.sum() / 4
        push = (step - 1) / (step + 2)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def on_executor(sample: DataFrame, label: str, bits: int, chars: tuple[int, ...], words: tuple[int, ...], lower: bool, learn) -> list[bytes]:
    """What ``learn(rows, labels, folds)`` yields for a bounded sample (columns t, fold, ``label``).

    Features are computed on all executors; one task then holds the rows, in an
    order of their own, and fits, so that the driver only sees the models.
    """

    small = np.min_scalar_type((1 << bits) - 1)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [features(t.lower() if lower else t, bits, chars, words) for t in batch["t"]]
            yield pd.DataFrame({"label": batch[label].astype(str), "fold": batch["fold"], "s": [p[0].astype(small).tobytes() for p in pairs], "v": [p[1].astype("<f4").tobytes() for p in pairs]})
        give_back()

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(f, y, np.frombuffer(s, small), np.frombuffer(v, "<f4")) for b in batches for f, y, s, v in zip(b["fold"], b["label"], b["s"], b["v"])]
        got.sort(key=lambda r: (r[0], r[1], len(r[2]), zlib.crc32(r[2]), zlib.crc32(r[3])))
        folds, labels = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], dtype=object)
        pairs = [r[2:] for r in got]
        got.clear()
        yield pd.DataFrame({"model": list(learn(Rows(pairs, bits), labels, folds))}, dtype=object)
        give_back()

    rows = sample.select("t", "fold", label).repartition(sample.sparkSession.sparkContext.defaultParallelism)
    made = rows.mapInPandas(featured, "label string, fold long, s binary, v binary")
    return [bytes(r["model"]) for r in made.repartition(1).mapInPandas(fitted, "model binary").collect()]
