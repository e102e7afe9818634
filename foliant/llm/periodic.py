"""Periodic runs of words, found through Lyndon words.

A run is a stretch of words with smallest period q whose length is at least
``least`` and at least ``times`` q, and that no word beside it extends. Every
run holds, under one of the two orders of the words, a longest Lyndon word of
length q. So each text is scanned right to left under both orders with a stack
of Lyndon words: suffixes are compared by their first words and, where those
agree, by their longest common extension (LCE). Each Lyndon word is then
extended to both sides by LCE, and what is long enough is a run.

An LCE is a binary search over hashes of prefixes (two moduli of 31 bits, so
62 bits in all). What hashes call equal is verified: the extensions of one
shift are joined to stretches, whose words are compared directly. A text for
which that fails is done again with other bases. No suffix array is built.

Only parts of a text where a run can be are scanned: a run of four periods
holds each of its windows of five words twice at least, so the parts are the
stretches of windows that the text repeats (by hash, which can only add).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.memory import give_back
from foliant.llm.tables import ODD
from foliant.llm.text import slices, whole
from foliant.llm.words import hash_runs
from foliant.runtime import spread

LEAST, TIMES = 6, 4
#: A run of ``LEAST`` words and ``TIMES`` periods holds each window of so many words twice.
WINDOW = 5
_PRIME = np.uint64((1 << 31) - 1)
#: Words that a comparison looks at before it searches by hash.
_DIRECT = 4
_CHUNK = 1 << 20


class Prefixes:
    """Hashes of all prefixes of a sequence of word numbers, for two bases."""

    def __init__(self, words: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        self.n, self.powers, self.sums = len(words), [], []
        for _ in range(2):
            base = int(draw.integers(1 << 20, int(_PRIME) - 1))
            letters = draw.integers(1, int(_PRIME) - 1, int(words.max(initial=-1)) + 1, dtype=np.uint64)
            power = np.ones(len(words) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):  # powers by doubling
                take = min(done, len(power) - done)
                power[done : done + take] = power[:take] * np.uint64(step) % _PRIME
                done, step = done + take, step * step % int(_PRIME)
            # sums of less than 2 ** 31 each stay in 64 bits for as many words as a text can hold
            terms = letters[words] * power[:-1] % _PRIME if len(words) else np.zeros(0, np.uint64)
            self.powers.append(power)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % _PRIME]))
        self._lists = [x.tolist() for x in (*self.powers, *self.sums)]

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """If the stretches of ``length`` words from i and from j > i agree by their hashes."""
        out = np.ones(len(i), bool)
        for power, total in zip(self.powers, self.sums):
            a, b = (total[i + length] + _PRIME - total[i]) % _PRIME, (total[j + length] + _PRIME - total[j]) % _PRIME
            out &= a * power[j - i] % _PRIME == b
        return out

    def lce(self, i: int, j: int) -> int:
        """How many words agree from i and from j > i on: steps that double, then halve."""
        power, other, sums, more = self._lists
        shift, shift2, p = power[j - i], other[j - i], int(_PRIME)

        def same(at: int, length: int) -> bool:
            a, b, c, d = i + at, i + at + length, j + at, j + at + length
            return (sums[b] - sums[a]) * shift % p == (sums[d] - sums[c]) % p and (more[b] - more[a]) * shift2 % p == (more[d] - more[c]) % p

        most, length, step = self.n - j, 0, 8
        while length + step <= most and same(length, step):
            length, step = length + step, step * 2
        while step:
            if length + step <= most and same(length, step):
                length += step
            step //= 2
        return length

    def extensions(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For arrays of starts i < j, how many words agree before them and from them on."""
        found = []
        for most, sign in ((i, -1), (self.n - j, 1)):
            low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_] + 1) // 2
                a, b = (i[open_] - mid, j[open_] - mid) if sign < 0 else (i[open_], j[open_])
                fits = self.equal(a, b, mid)
                low[open_[fits]], high[open_[~fits]] = mid[fits], mid[~fits] - 1
            found.append(low)
        return found[0], found[1]


def lyndon_ends(words: list[int], prefixes: Prefixes, down: bool, claims: list[tuple[int, int, int]]) -> list[int]:
    """Where the longest Lyndon word from each place ends, words ordered by their numbers, or ``down`` from the largest.

    The stack of a scan right to left: a word takes those after it as long as
    its suffix is smaller. A text's end is smaller than any word. Extensions
    taken from hashes are added to ``claims`` (i, j, length).
    """
    n, known = len(words), {}
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        j, a = i + 1, words[i]
        while j < n:
            b = words[j]
            if a == b:
                k, x = 1, i + 1
                while k < _DIRECT and j + k < n and words[x] == words[j + k]:
                    k, x = k + 1, x + 1
                if k == _DIRECT and j + k < n and words[x] == words[j + k]:
                    at, k = known.get(j - i, (-1, 0))  # a place's extension is one more than that of the next place, by the same shift
                    k = k + 1 if at == i + 1 else prefixes.lce(i, j)
                    known[j - i] = i, k
                    claims.append((i, j, k))
                if j + k == n:
                    break  # the suffix from j is a prefix of that from i, and smaller
                if (words[i + k] > words[j + k]) != down:
                    break
            elif (a > b) != down:
                break
            j = ends[j]
        ends[i] = j
    return ends


def verified(words: np.ndarray, claims: np.ndarray) -> bool:
    """If words agree as claimed: rows (i, j, length), joined for each shift j - i to stretches that are compared once."""
    shift, start, end = claims[:, 1] - claims[:, 0], claims[:, 0], claims[:, 0] + claims[:, 2]
    order = np.lexsort((start, shift))
    shift, start, end = shift[order], start[order], end[order]
    if not len(order):
        return True
    apart = np.flatnonzero(np.diff(shift)) + 1
    for lo, hi in zip([0, *apart.tolist()], [*apart.tolist(), len(order)]):
        reach = np.maximum.accumulate(end[lo:hi])
        first = np.concatenate([[0], np.flatnonzero(start[lo + 1 : hi] > reach[:-1]) + 1])
        last = np.concatenate([first[1:], [hi - lo]]) - 1
        d = int(shift[lo])
        for a, b in zip(start[lo:hi][first].tolist(), reach[last].tolist()):
            if not np.array_equal(words[a:b], words[a + d : b + d]):
                return False
    return True


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES, seed: int = 0) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of the runs of a sequence of word numbers (0 and up)."""
    n, listed = len(words), words.tolist()
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    prefixes, claims, repeated, found = Prefixes(words, seed), [], [], []
    for down in (False, True):
        ends = np.array(lyndon_ends(listed, prefixes, down, claims), np.int64)
        i = np.arange(n)
        period = ends - i
        # of a run's Lyndon words the first has less than a period before it, so all but two of its periods follow
        ahead = (times - 2) * period
        i, period, ahead = (x[ends + ahead <= n] for x in (i, period, ahead))
        i, period = (x[prefixes.equal(i, i + period, ahead)] for x in (i, period))
        back = np.flatnonzero(i >= period)
        later = back[prefixes.equal(i[back] - period[back], i[back], period[back])]
        repeated.append(np.stack([i[later] - period[later], i[later], period[later]], 1))
        i, period = np.delete(i, later), np.delete(period, later)
        ends = i + period
        left, right = prefixes.extensions(i, ends)
        length = left + period + right
        keep = (length >= least) & (length >= times * period)
        found.append(np.stack([i - left, length, period], 1)[keep])
    runs = np.unique(np.concatenate(found), axis=0)
    made = np.stack([runs[:, 0], runs[:, 0] + runs[:, 2], runs[:, 1] - runs[:, 2]], 1)
    if not verified(words, np.concatenate([np.array(claims, np.int64).reshape(-1, 3), *repeated, made])):
        return runs_of(words, least, times, seed + 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the parts of texts, as places in arrays of word hashes and of their texts, whose windows of ``WINDOW`` words their text holds twice."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = owner[:n].astype(np.uint64) * ODD[3]
    for j in range(WINDOW):
        key = (key + h[j : j + n]) * ODD[j % 3]
        key ^= key >> np.uint64(29)
    within = owner[:n] == owner[WINDOW - 1 :]
    places = np.flatnonzero(within)
    order = places[np.argsort(key[places], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n + 2, bool)
    twice[order[1:][same] + 1] = twice[order[:-1][same] + 1] = True
    # windows of two texts are never in one stretch: those that span both aren't counted
    edge = np.flatnonzero(np.diff(twice.view(np.int8)))
    first, last = edge[::2], edge[1::2]
    long = last - first + WINDOW - 1 >= LEAST
    return first[long], last[long] + WINDOW - 1


def find_in(texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of each text and its runs as rows (start, length, period)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [p.split() for p in parts]
    data, h = b" ".join(parts), []
    raw, lo = np.frombuffer(data, np.uint8), 0
    while lo < len(raw):  # in chunks that end at white space
        hi = min(len(raw), lo + _CHUNK)
        while hi < len(raw) and data[hi - 1 : hi].strip():
            hi += 1
        h.append(hash_runs(raw[lo:hi])[2])
        lo = hi
    counts = np.fromiter(map(len, split), np.int64, len(split))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(split)), counts)
    start, end = stretches(np.concatenate(h) if h else np.zeros(0, np.uint64), owner)
    text = owner[start] if len(start) else start
    for k, words in enumerate(split):
        found = []
        for a, b in zip((start[text == k] - first[k]).tolist(), (end[text == k] - first[k]).tolist()) if len(start) else ():
            number: dict[bytes, int] = {}
            runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words[a:b]], np.int64))
            runs[:, 0] += a
            found.append(runs)
        yield words, np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that stand in a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, runs (start, length, period by start, then period) and ``collapsed`` or its sha256.

    Null and empty texts and those without words have no runs and collapse to
    the empty text; any other text without runs is its words joined by blanks. Repeated rows give
    a row each; an empty table gives an empty result; other columns aren't
    read. A text is looked at whole, in one task; texts share nothing.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                runs, texts = [], []
                for words, found in find_in(part["t"].tolist()):
                    runs.append([{"start": a, "length": n, "period": q} for a, n, q in found.tolist()])
                    kept = collapsed(words, found)
                    texts.append(kept.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(kept).hexdigest())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "runs": runs, column: texts})
        give_back()

    column = "collapsed" if with_text else "collapsed_sha256"
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t")))
    return rows.mapInPandas(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, {column} string")
