"""Quality rules: fixed base rules and a calibrated logistic regression on hashed n-grams.

The classifier is fitted, by one task, on at most ``FIT_ROWS`` labelled rows,
those with the smallest hashes of their doc_id. A fifth of them is held back to calibrate the
scores (Platt's method). All texts are scored in Arrow batches; a document is
rejected by a base rule or if its calibrated probability of good quality is
under the fixed threshold.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.linear import Rows, features, fit, on_executor
from foliant.llm.memory import give_back
from foliant.llm.text import WORD, whole
from foliant.runtime import spread

FIT_ROWS, FOLDS = 4000, 5
LEAST_WORDS, MOST_REPEATED, THRESHOLD = 50, 50, 0.3
BITS, CHARS, WORDS = 16, (1, 2, 3, 4), (1, 2)
_WORDS, _SYMBOLS = re.compile(WORD), re.compile(r"[#*$%&|<>]")


@dataclass
class QualityModel:
    """``weights`` over hashed n-grams, and the calibration from margin to probability; without weights all is good."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, text: str) -> float:
        if self.weights is None:
            return 1.0
        slots, values = features(text, BITS, CHARS, WORDS)
        margin = float(values @ self.weights[slots]) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50))))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled rows (null labels and texts count for nothing); with one class only, all is good."""
    order = F.xxhash64("doc_id", "quality")
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(order, "doc_id", "quality").limit(max_rows)
    sample = docs.where("text IS NOT NULL").select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))
    sample = sample.orderBy(order, "t").limit(max_rows)  # doc_ids may repeat
    made = on_executor(sample, "quality", BITS, CHARS, WORDS, False, learn_quality)
    return pickle.loads(made[0]) if made else QualityModel(None)


def learn_quality(rows: Rows, label: np.ndarray, fold: np.ndarray) -> Iterator[bytes]:
    """The pickled model of the rows: weights from all folds but 0, on which the margins are calibrated."""
    y = np.where(label == "0", -1.0, 1.0)
    if len(set(y)) < 2:
        yield pickle.dumps(QualityModel(None))
        return
    train = fold != 0
    w, b = fit(rows, y, hinge=False, use=train, steps=200, decay=1e-5)
    margin, target = (rows.dot(w) + b)[~train], (y[~train] + 1) / 2
    slope, shift = 1.0, 0.0
    if len(set(target)) == 2:
        good, bad = target.sum(), (1 - target).sum()
        goal = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
            v = p * (1 - p) + 1e-9
            g = np.array([((p - goal) * margin).sum() + 1e-3 * (slope - 1), (p - goal).sum()])
            h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
    yield pickle.dumps(QualityModel(w.astype(np.float32), b, slope, shift))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    repeated = 0
    if len(words) > 3:
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[triple] > 1)
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[at + j] = True
        repeated = int(covered.sum())
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the five measures, base_failed, kept, probability.

    Null texts are empty: no words, so a base rule rejects them. Repeated rows
    are scored alike; an empty table gives an empty result; of other columns
    nothing is read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measures(t) for t in batch["t"]], columns=names, dtype="int64")
            out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            out["probability"] = [shared.value.probability(t) for t in batch["t"]]
            out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out[["doc_id", *names, "base_failed", "kept", "probability"]]
        give_back()

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return spread(docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))).mapInPandas(run, schema)


def verdict_column(model: QualityModel, threshold: float = THRESHOLD):
    """A pandas UDF of the text: if the document is kept by the base rules and the model."""

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                n, _, _, _, repeated = measures(t)
                out.append(n >= LEAST_WORDS and 100 * repeated <= MOST_REPEATED * n and shared.value.probability(t) >= threshold)
            yield pd.Series(out, dtype="bool")
        give_back()

    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)
    return kept
