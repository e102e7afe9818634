"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliant.llm.tables import ODD

_P1, _P2, _P3 = ODD[:3]
_MIXED = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The hash of the empty word, the end of a text.
END = np.uint64(0x9FB21C651E98DF25)
_CHUNK = 1 << 22


def hash_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of bytes: a polynomial in the place of a byte within the word, mod 2 ** 64."""
    inside = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(length.max()) - 1, _P1))])
    h = np.add.reduceat(_MIXED[data[inside]] * powers[place], first)
    h = (h ^ (h >> np.uint64(32))) * _P2
    return start, end, h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of several texts one after another, each text's end as an empty word: hash, text, place in it, and where they stand in ``data``."""

    data: bytes
    hash: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = (b" ".join(parts) + b" ").lower()
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        raw, found, lo = np.frombuffer(data, np.uint8), [], 0
        while lo < len(raw):  # long inputs in chunks that end at a blank
            hi = min(len(raw), lo + _CHUNK)
            while hi < len(raw) and not _WHITE[raw[hi - 1]]:
                hi += 1
            start, end, h = hash_runs(raw[lo:hi])
            found.append((start + lo, end + lo, h))
            lo = hi
        start, end, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        text = np.searchsorted(ends, start, "right")
        n, words = len(texts), np.bincount(text, minlength=len(texts))
        first = np.cumsum(words + 1) - words - 1
        place = np.arange(len(start)) + text
        size = len(start) + n
        out = cls(data, np.full(size, END), np.repeat(np.arange(n), words + 1), np.arange(size) - np.repeat(first, words + 1), np.zeros(size, np.int64), np.zeros(size, np.int64))
        out.hash[place], out.start[place], out.end[place] = h, start, end
        return out

    def word(self, places: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[places].tolist(), self.end[places].tolist())]


def hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words that hold no white space; the empty word's is ``END``."""
    out = np.full(len(words), END)
    some = [i for i, w in enumerate(words) if w]
    if some:
        out[some] = hash_runs(np.frombuffer(b" ".join(words[i] for i in some), np.uint8))[2]
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the distinct hashes, ascending, of its runs of ``size`` words; a text of fewer words is one run, one without words has none."""
    words = Words.of(texts)
    kept = words.end > words.start
    h, owner = words.hash[kept], words.owner[kept]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    run = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        run = (run + h[j : j + len(run)]) * _P3
        run ^= run >> np.uint64(31)
    run = (run * _P1).view(np.int64)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(run[lo : hi - size + 1]))
        else:
            short = np.zeros(1, np.uint64)
            for x in h[lo:hi]:
                short = (short + x) * _P2
                short ^= short >> np.uint64(31)
            out.append(short.view(np.int64) if hi > lo else np.zeros(0, np.int64))
    return out
