"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (lower-cased by A-Z, hashed to slots, log of
the count, of unit length), statistics of its structure and numbers that come with the
row, each as the slot of the bin that it falls into. The score is the logistic
function of a bias, a weight for each feature and, for each pair of features,
the product of two vectors of ``RANK`` numbers. With the sum-of-squares identity

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over k ((sum v_ik x_i)^2 - sum v_ik^2 x_i^2)

that takes time linear in the features. One task fits it on at most
``FIT_ROWS`` labelled rows, those with the smallest hashes of their doc_id; all
texts are scored whole in Arrow batches.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.memory import give_back
from foliant.llm.tables import ODD
from foliant.llm.text import slices, whole
from foliant.llm.words import Words
from foliant.runtime import spread

FIT_ROWS, RANK, BITS = 4000, 6, 16
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-4
#: A statistic is a share in bins that double in width from 1 in 1000, or a number in bins that double.
BINS = 12
#: Weight of a statistic's slot beside that of the words, which have length 1 together.
STATISTIC = 0.5
_CLASS = np.zeros(256, np.int64)
for _name, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 192)), bytes(range(192, 256))), 1):
    _CLASS[list(_bytes)] = _name
_CLASSES = int(_CLASS.max()) + 1


@dataclass
class FactorModel:
    """``weights`` and ``factors`` by slot; without them every text has the share of good rows as its score."""

    weights: np.ndarray | None
    factors: np.ndarray | None = None
    bias: float = 0.0
    metadata: Sequence[str] = field(default_factory=tuple)

    def score(self, starts: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of rows of features, ``starts`` their borders; no row is without one."""
        if self.weights is None:
            margin = np.full(len(starts) - 1, self.bias)
        else:
            margin = margins(self.weights, self.factors, self.bias, starts, slots, values)[0]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def margins(weights, factors, bias: float, starts: np.ndarray, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each row and its sums of v x."""
    v = factors[slots] * values[:, None]
    sums = np.add.reduceat(v, starts[:-1], 0)
    squares = np.add.reduceat(v * v, starts[:-1], 0)
    return bias + np.add.reduceat(weights[slots] * values, starts[:-1]) + 0.5 * (sums * sums - squares).sum(1), sums


def _bins(shares: np.ndarray) -> np.ndarray:
    """Bins of shares of 0 to 1: none, then by doublings from 1 in 1000."""
    return np.where(shares <= 0, 0, np.clip(np.floor(np.log2(np.maximum(shares, 1e-9) * 1000)) + 1, 1, BINS - 1)).astype(np.int64)


def _sizes(numbers: np.ndarray) -> np.ndarray:
    """Bins of numbers from 0 on, by doublings."""
    return np.clip(np.ceil(np.log2(np.maximum(numbers, 0) + 1)), 0, BINS + 12).astype(np.int64)


def statistics(texts: list[str], words: Words) -> np.ndarray:
    """A row of bins for each text: shares of classes of characters, sizes, repeated words and lines."""
    n = len(texts)
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, parts), np.int64, n)
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(n) * _CLASSES, size)
    kinds = np.bincount(owner + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    inside = words.end > words.start
    h, text = words.hash[inside], words.owner[inside]
    count = np.bincount(text, minlength=n)
    chars = np.bincount(text, (words.end - words.start)[inside], n)
    by_text = text.astype(np.uint64) * ODD[1]
    per = np.maximum(count, 1)

    def again(key: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many keys of each text stand in it more than once."""
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        return np.bincount(text[times[at] > 1], minlength=n)

    same = np.bincount(text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])], minlength=n)
    triple = (h[:-2] * ODD[0] + h[1:-1]) * ODD[2] + h[2:] + by_text[:-2] if len(h) > 2 else np.zeros(0, np.uint64)
    within = text[:-2] == text[2:]
    repeats = again(triple[within], text[:-2][within])
    distinct = np.bincount(text[np.unique(h + by_text, return_index=True)[1]], minlength=n)
    lines = kinds[:, 6] + 1
    held = [t.split(b"\n") for t in parts]
    twice = np.array([len(x) - len(set(x)) for x in held], np.int64)
    letters = np.maximum(size - kinds[:, 8], 1)
    shares = [kinds[:, k] / letters for k in range(1, _CLASSES)]
    shares += [same / per, repeats / per, (count - distinct) / per, twice / lines]
    numbers = [count, np.round(chars / per * 4), np.round(count / lines), lines]
    return np.stack([*map(_bins, shares), *map(_sizes, numbers)], 1)


def features(texts: list[str], metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(borders, slots, values) of the features of each text; ``metadata`` has a row of numbers for each, not a number if unknown."""
    words = Words.of(texts)
    n, inside = len(texts), words.end > words.start
    slot = (words.hash[inside] * ODD[3] >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique((words.owner[inside] << BITS) + slot, return_counts=True)
    owner, slot, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value = value / norm[owner]
    told = statistics(texts, words)
    if metadata.shape[1]:
        told = np.concatenate([told, np.where(np.isnan(metadata), BINS + 13, _sizes(np.nan_to_num(metadata)))], 1).astype(np.int64)
    more = (1 << BITS) + np.arange(told.shape[1]) * (BINS + 14) + told
    owner = np.concatenate([owner, np.repeat(np.arange(n), told.shape[1])])
    slot, value = np.concatenate([slot, more.ravel()]), np.concatenate([value, np.full(more.size, STATISTIC)])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), slot[order], value[order].astype(np.float32)


def _slots(metadata: int) -> int:
    return (1 << BITS) + (_CLASSES - 1 + 8 + metadata) * (BINS + 14)


def learn_factors(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, metadata: Sequence[str] = (), seed: int = 1) -> FactorModel:
    """Weights and vectors that fit rows of (slots, values) to labels 0 and 1: logistic loss, batches, steps scaled for each slot."""
    good = (label.sum() + 0.5) / (len(label) + 1)
    bias = float(np.log(good / (1 - good)))
    if not len(label) or label.min() == label.max():
        return FactorModel(None, None, bias, tuple(metadata))
    draw, size = np.random.default_rng(seed), _slots(len(metadata))
    w, v = np.zeros(size), draw.normal(0, 0.05, (size, RANK))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        order = draw.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in some])])
            slots, x = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some]).astype(float)
            margin, sums = margins(w, v, bias, starts, slots, x)
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label[some]) / len(some)
            owner = np.repeat(np.arange(len(some)), np.diff(starts))
            pull = error[owner] * x
            used, at = np.unique(slots, return_inverse=True)
            gw = np.bincount(at, pull, len(used)) + DECAY * w[used]
            gv = np.stack([np.bincount(at, pull * (sums[owner, k] - v[slots, k] * x), len(used)) for k in range(RANK)], 1) + DECAY * v[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            w[used] -= RATE * gw / np.sqrt(seen_w[used])
            v[used] -= RATE * gv / np.sqrt(seen_v[used])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    return FactorModel(w.astype(np.float32), v.astype(np.float32), float(bias), tuple(metadata))


def _numbers(batch: pd.DataFrame, metadata: Sequence[str]) -> np.ndarray:
    return np.stack([batch[f"m{k}"].to_numpy(float) for k in range(len(metadata))], 1) if metadata else np.zeros((len(batch), 0))


def _inputs(docs: DataFrame, text: str, metadata: Sequence[str]) -> list:
    return [whole(text).alias("t"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]]


def fit_factors(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: Sequence[str] = (), max_rows: int = FIT_ROWS) -> FactorModel:
    """Fit on labelled rows of ``docs``; null labels count for nothing, null texts are empty, ``metadata`` names columns of numbers.

    Of repeated doc_ids each row counts, up to ``max_rows`` in all. Without
    rows of both labels the score is the share of good ones, 0.5 without any.
    """
    order = F.xxhash64("doc_id", "label")
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    chosen = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi").orderBy(order, "doc_id", "label").limit(max_rows)
    told = docs.select(F.col(doc_id).alias("doc_id"), *_inputs(docs, text, metadata)).join(F.broadcast(chosen), "doc_id")
    sample = told.orderBy(order, "doc_id", F.xxhash64("t")).limit(max_rows)  # doc_ids may repeat

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                starts, slots, values = features(part["t"].tolist(), _numbers(part, metadata))
                cut = lambda x, kind: [x[a:b].astype(kind).tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "s": cut(slots, "<i4"), "v": cut(values, "<f4")})
        give_back()

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(((y, s, v) for b in batches for y, s, v in zip(b["label"], b["s"], b["v"])), key=lambda r: (zlib.crc32(r[1]), r))
        rows = [(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(v, "<f4")) for _, s, v in got]
        model = learn_factors(rows, np.array([r[0] for r in got], float), metadata)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})
        give_back()

    dealt = sample.drop("doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    made = dealt.mapInPandas(featured, "label int, s binary, v binary").repartition(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else learn_factors([], np.zeros(0), metadata)


def score_factors(docs: DataFrame, model: FactorModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: good quality is likelier) for each row of ``docs``.

    Null texts are empty; an empty text is scored by its statistics and
    metadata. Repeated rows are scored alike; an empty table gives an empty
    result; of other columns than the model's metadata nothing is read.
    """
    shared, metadata = docs.sparkSession.sparkContext.broadcast(model), model.metadata
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t"):
                scores = shared.value.score(*features(part["t"].tolist(), _numbers(part, metadata)))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": scores.astype(float)})
        give_back()

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), *_inputs(docs, text, metadata)))
    return rows.mapInPandas(run, f"doc_id {kind}, score double")
