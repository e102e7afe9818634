"""Byte-pair encoding by speculation: propose, verify, and merge exactly only what fails.

Greedy longest match proposes the tokens of each new word. A sequence of
tokens, each of which encodes to itself, is the encoding of its string exactly
if each adjacent pair is, so one vectorised check tests all pairs of a batch:
it walks back in time from both tokens to their last and first symbols and
looks for a merge across the border that would have come before the merges
which built the tokens. Words with a failing pair are merged exactly.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.memory import give_back
from foliant.llm.tables import ODD, Table
from foliant.llm.text import WORD, slices, whole
from foliant.runtime import spread

#: Words remembered by a Python worker, in each of two generations.
REMEMBERED = 130_000
_NEVER = np.int64(1 << 40)
#: Symbols up to which words are proposed and merged together with others.
_SHORT = 48
_BASE, _BASE_INVERSE = np.uint64(0x2545F4914F6CDD1D), np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_WORDS = re.compile(WORD)
#: Words that composition leaves alone, and how the tokenizer cuts them once they are in lower case.
_LATIN = re.compile("[!-~\xa1-\xff]+")
_PARTS = re.compile(" |'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: The byte alphabet: bytes that aren't printable stand at U+0100 and after, in their order. Here each byte is a character of its own value.
_ALPHABET = {b: b for b in range(256)} | {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_BYTES = {c: b for b, c in _ALPHABET.items()}
#: Texts encoded at a time, and their characters together unless one alone has more.
TEXTS, CHARS = 512, 1 << 20


class SpeculativeBpe:
    """Encoder and decoder for a tokenizers file with a BPE model whose merges make the ids in ascending order."""

    def __init__(self, path: str, with_ids: bool = True):
        from tokenizers import Tokenizer

        self.with_ids = with_ids

        own = Tokenizer.from_file(path)
        self.normalizer, self.pre = own.normalizer, own.pre_tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        left, right, birth = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.merges, keys = {}, []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = (rank, z)
            keys.append(x * size + y)
            if birth[z] < 0:
                left[z], right[z], birth[z] = x, y, rank
        self.size, self.left, self.right, self.birth = size, left, right, birth
        _, once = np.unique(keys := np.array(keys, np.int64), return_index=True)
        self.rank_of = Table(keys[once], once)
        self.made_by = np.array([self.merges[k // size, k % size][1] for k in keys.tolist()], np.int64)
        made = np.flatnonzero(birth >= 0)
        sound = np.ones(size, bool)
        sound[made] = self.compatible(left[made], right[made], skip_top=True)
        for i in made[np.argsort(birth[made])]:
            sound[i] = sound[i] and sound[left[i]] and sound[right[i]]
        self.usable = {t: i for t, i in self.vocab.items() if sound[i] and (birth[i] >= 0 or len(t.removesuffix(self.suffix)) <= 1)}
        self._hash_tokens()
        self.digits = list(map(str, range(size)))
        #: Entries of parts and of raw words, and those of the generation before.
        self.known: dict[str, tuple] = {}
        self.raw: dict[str, tuple] = {}
        self.known_before, self.before = self.known, self.raw

    def _hash_tokens(self) -> None:
        """For proposals: symbols by character, hashes of usable tokens as symbol sequences, and the longest token after two symbols."""
        chars = [chr(_ALPHABET[b]) for b in range(256)]
        self.symbol = np.array([self.vocab.get(c, -1) for c in chars])
        self.last_symbol = np.array([self.vocab.get(c + self.suffix, -1) for c in chars])
        self.weight = (np.arange(1, self.size + 1, dtype=np.uint64) * ODD[0]) ^ (np.arange(self.size, dtype=np.uint64) * ODD[1] >> np.uint64(17))
        start, n = self.weight.copy(), np.ones(self.size, np.int64)
        powers = np.cumprod(np.full(4096, _BASE))
        first, second = np.arange(self.size), np.full(self.size, -1)
        with np.errstate(over="ignore"):
            for z in np.flatnonzero(self.birth >= 0)[np.argsort(self.birth[self.birth >= 0])]:
                x, y = self.left[z], self.right[z]
                start[z], n[z] = start[x] + powers[n[x] - 1] * start[y], n[x] + n[y]
                first[z], second[z] = first[x], second[x] if n[x] > 1 else first[y]
        ids = np.array(sorted(self.usable.values()))
        self.single, ids = ids[n[ids] == 1], ids[n[ids] > 1]
        self.token_of, self.most = Table(start[ids], ids), int(n[ids].max(initial=1))
        ordinal = np.full(self.size, -1)
        symbols = np.unique(np.concatenate([self.symbol, self.last_symbol]))
        ordinal[symbols[symbols >= 0]] = np.arange((symbols >= 0).sum())
        self.ordinal, self.reach = ordinal, np.ones((512, 512), np.int64)
        np.maximum.at(self.reach, (ordinal[first[ids]], ordinal[second[ids]]), n[ids])
        self.is_single = np.zeros(self.size, bool)
        self.is_single[self.single] = True

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rank = self.rank_of((x.astype(np.int64) * self.size + y).astype(np.uint64))
        return np.where(rank < 0, _NEVER, rank)

    def compatible(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """For each pair of tokens, if the encoding of its string is the pair; at equal ranks the left merge comes first."""
        x, y = np.array(a), np.array(b)
        until_x, until_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            cx, cy = x[open_], y[open_]
            if not skip_top:
                m = self._rank(cx, cy)
                good[open_[(m < until_x[open_]) & (m <= until_y[open_])]] = False
            skip_top = False
            bx, by = self.birth[cx], self.birth[cy]
            go_x = bx > by
            ix, iy = open_[go_x], open_[~go_x & (by >= 0)]
            until_x[ix], until_y[iy] = self.birth[x[ix]], self.birth[y[iy]]
            x[ix], y[iy] = self.right[x[ix]], self.left[y[iy]]
            open_ = open_[good[open_] & ((bx >= 0) | (by >= 0))]
        return good

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words one after another, and their lengths."""
        points = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, last = self.symbol[points], np.cumsum(lengths) - 1
        out[last] = self.last_symbol[points[last]]
        return out, lengths

    def propose(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over tokens that encode to themselves: tokens, and the word that each is of.

        Windows of symbols are looked up by a polynomial hash, for all places
        and one length at a time; a symbol that is no such token stands as -1.
        """
        n, ends = len(symbols), np.repeat(np.cumsum(lengths), lengths)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.weight[symbols] * powers[:n])])
        back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), _BASE_INVERSE))])[:n]
        token, length = np.where(self.is_single[symbols], symbols, -1), np.ones(n, np.int64)
        kind = self.ordinal[symbols]
        room = np.minimum(self.reach[kind, np.append(kind[1:], 0)], ends - np.arange(n))
        for size in range(2, self.most + 1):
            at = np.flatnonzero(room >= size)
            if not len(at):
                break
            found = self.token_of((sums[at + size] - sums[at]) * back[at])
            some = found >= 0
            token[at[some]], length[at[some]] = found[some], size
        at, step = np.cumsum(lengths) - lengths, np.arange(n) + length
        starts = np.zeros(n + 1, bool)
        while len(at):
            starts[at] = True
            at = step[at[step[at] < ends[at]]]
        at = np.flatnonzero(starts)
        return token[at], np.repeat(np.arange(len(lengths)), lengths)[at]

    def merge_together(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each round every word merges its pair of lowest rank, the leftmost first."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            counts = np.diff(begins, append=len(ids))
            least = np.minimum.reduceat(rank, begins)
            over = np.repeat(least == _NEVER, counts)
            if over.any():
                done.append((ids[over], owner[over]))
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                counts, least = counts[least != _NEVER], least[least != _NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, counts))
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            ids[at] = self.made_by[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            place = (np.cumsum(stay) - 1)[at]
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            for i in (place, place[place > 0] - 1):
                pair = (i + 1 < len(ids)) & (owner[np.minimum(i + 1, len(ids) - 1)] == owner[i])
                i, last = i[pair], i[~pair]
                rank[i], rank[last] = self._rank(ids[i], ids[i + 1]), _NEVER
        if not done:
            return ids, owner
        ids, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge(self, word: str) -> list[int]:
        """Exact merging of one long word with a heap, lowest rank first, leftmost first; symbols without an id are dropped."""
        points = list(word.encode("latin-1"))
        ids = [s for s in [*self.symbol[points[:-1]].tolist(), *self.last_symbol[points[-1:]].tolist()] if s >= 0]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, i, z) for rank, z, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.merges.get((ids[i], ids[j])) != (rank, z):
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (ids[k], ids[after[k]]) in self.merges:
                    r, made = self.merges[ids[k], ids[after[k]]]
                    heapq.heappush(heap, (r, k, made))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word: propose all, verify all adjacent pairs at once, merge those that fail."""
        short = [w for w in words if 0 < len(w) <= _SHORT]
        symbols, lengths = self.symbols(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if (symbols < 0).any():  # an alphabet that lacks letters
            short = []
        made = self.learn_together(symbols, lengths) if short else iter(())
        for w in words:
            yield next(made) if short and 0 < len(w) <= _SHORT else self.merge(w)

    def learn_together(self, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[list[int]]:
        flat, owner = self.propose(symbols, lengths)
        failed = np.zeros(len(lengths), bool)
        failed[owner[flat < 0]] = True
        beside = np.flatnonzero((owner[1:] == owner[:-1]) & (flat[1:] >= 0) & (flat[:-1] >= 0))
        failed[owner[beside[~self.compatible(flat[beside], flat[beside + 1])]]] = True
        owners = np.repeat(np.arange(len(lengths)), lengths)
        again = failed[owners]
        merged, of = self.merge_together(symbols[again], owners[again])
        good = ~failed[owner]
        flat, owner = np.concatenate([flat[good], merged]), np.concatenate([owner[good], of])
        order = np.argsort(owner, kind="stable")
        flat, cuts = flat[order].tolist(), np.searchsorted(owner[order], np.arange(len(lengths) + 1)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield flat[lo:hi]

    def forget(self) -> None:
        """Forget all words."""
        self.known, self.raw = {}, {}
        self.known_before, self.before = self.known, self.raw

    def entry(self, ids: list[int]) -> tuple:
        """(ids as text, the tokens' strings, and the ids as bytes if they are wanted)."""
        told = " ".join([self.digits[i] for i in ids]), " ".join([self.tokens[i] for i in ids])
        return (*told, np.array(ids, np.int32).tobytes()) if self.with_ids else told

    def join(self, entries: list[tuple]) -> tuple:
        """The entry of several one after another, each of which may be empty."""
        ids, strings, *more = zip(*entries) if entries else ((), (), ())
        told = " ".join(filter(None, ids)), " ".join(filter(None, strings))
        return (*told, b"".join(more[0]) if more else b"") if self.with_ids else told

    def parts(self, word: str) -> list[str | int]:
        """The pre-tokenised parts of a raw word, a character a byte; added tokens as their ids."""
        out: list[str | int] = []
        for part in self.split_added.split(word) if self.split_added else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [w.translate(_BYTES) for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def split(self, words: list[str]) -> list[list[str | int]]:
        """``parts`` of each word; those of plain characters are cut together by one pattern."""
        plain = [w for w in words if _LATIN.fullmatch(w) and "<|" not in w]
        joined = "\t".join(_PARTS.findall(" ".join(plain).lower()))
        if not joined.isascii():
            joined = joined.encode().decode("latin-1")
        known = dict(zip(plain, [x.split("\t") for x in joined.split("\t \t")]))
        return [known[w] if w in known else self.parts(w) for w in words]

    @staticmethod
    def _bring(keys: set, now: dict, before: dict) -> list:
        """Have what the generation before knows of the keys in this one; the keys that neither knows."""
        new = [k for k in keys if k not in now]
        now.update([(k, before[k]) for k in new if k in before])
        return [k for k in new if k not in now]

    def remember(self, words: set[str]) -> None:
        """Have entries of raw words at hand: all parts that are new are encoded together."""
        if len(self.raw) + len(words) > REMEMBERED:
            self.raw, self.before, self.known, self.known_before = {}, self.raw, {}, self.known
        new = self._bring(words, self.raw, self.before)
        split = self.split(new)
        parts = self._bring(set(chain.from_iterable(split)), self.known, self.known_before)
        self.known.update((p, self.entry([p])) for p in parts if type(p) is int)
        parts = [p for p in parts if type(p) is str]
        self.known.update(zip(parts, map(self.entry, self.learn(parts))))
        raw, known = self.raw, self.known
        for w, parts in zip(new, split):
            if len(parts) == 1:
                raw[w] = known[parts[0]]
            elif len(parts) == 2 and not self.with_ids and known[parts[0]][0] and known[parts[1]][0]:
                (i, t), (j, u) = known[parts[0]], known[parts[1]]
                raw[w] = f"{i} {j}", f"{t} {u}"
            else:
                raw[w] = self.join([known[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray | None]]:
        """For each text its number of tokens, their ids joined, their strings joined, and the ids if they are wanted.

        A text is looked up by raw words. Neither composition nor lower-casing
        looks over white space, no token spans it and no added token holds it,
        so words can be encoded one by one, and each only once. ``str.split``
        knows the tokenizer's white space, and four separators more.
        """
        split = [_WORDS.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        self.remember(set().union(*split))
        for words in split:
            if not words:
                yield 0, "", "", np.zeros(0, np.int32) if self.with_ids else None
                continue
            ids, strings, *listed = zip(*map(self.raw.__getitem__, words))
            if "" in ids:
                ids, strings = list(filter(None, ids)), filter(None, strings)
            joined = " ".join(ids)
            yield joined.count(" ") + (joined != ""), joined, " ".join(strings), np.frombuffer(b"".join(listed[0]), np.int32) if self.with_ids else None


@lru_cache(2)
def load(path: str, with_ids: bool = True) -> SpeculativeBpe:
    """One encoder for a Python worker."""
    coder = SpeculativeBpe(path, with_ids)
    give_back()
    return coder


def _resolve(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``vocabulary`` is a path or the name of a public tokenizer, read by each
    Python worker. Null and empty texts have no tokens; an empty table gives an
    empty result; of other columns nothing is read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(_resolve(vocabulary), with_ids)
        gc.disable()  # nothing here makes cycles, and the words remembered are costly to look through
        for batch in batches:
            for part in slices(batch, "t", TEXTS, CHARS):
                rows = []
                for n, ids, decoded, listed in coder.encode_batch(part["t"].tolist()):
                    row = (None, n, _sha(ids), _sha(decoded))
                    rows.append((*row, listed) if with_ids else row)
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = part["doc_id"].to_numpy()
                yield out
        coder.forget()  # what few texts share of it is soon learned again, and the worker may stay idle for long
        give_back()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return spread(docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))).mapInPandas(run, schema)
