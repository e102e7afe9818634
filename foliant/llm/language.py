"""Language identification by hierarchy: the family first, then one-versus-one linear SVMs within it.

Both steps vote with linear support vector machines on hashed character
n-grams: between families, then between the languages of the family that won.
They are fitted, by one task, on at most ``PER_LANG`` texts of each language,
those with the smallest hashes of their doc_id and text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.linear import Rows, features, fit, on_executor
from foliant.runtime import spread

PER_LANG, BITS, CHARS = 500, 15, (1, 2, 3)
#: Machines at most, of 4 bytes for each of 2 ** BITS weights, hence 75 MB; the languages with the most rows have them.
MOST_MACHINES = 600
#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


@dataclass
class LanguageModel:
    """``machines`` maps a pair of families or of languages to (weights, bias); a positive margin is for the first."""

    groups: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def _vote(self, among: list[str], slots: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        wins, sums, margins = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0), {}
        for a, b in combinations(among, 2):
            w, bias = self.machines[a, b]
            m = float(values @ w[slots]) + bias
            margins[a, b], margins[b, a] = m, -m
            wins[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
        best = max(among, key=lambda c: (wins[c], sums[c]))
        least = min((margins[best, c] for c in among if c != best), default=50.0)
        return best, float(1 / (1 + np.exp(-2 * np.clip(least, -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.groups or not any(map(str.isalpha, text)):
            return "und", 0.0
        slots, values = features(text.lower(), BITS, CHARS)
        group, sure = self._vote(sorted(self.groups), slots, values)
        lang, sure_too = self._vote(self.groups[group], slots, values)
        return lang, sure * sure_too


def chosen_languages(counts: list[tuple[str, int]], most: int = MOST_MACHINES) -> list[str]:
    """Languages of (lang, rows) in order of their rows, as many as need no more than ``most`` machines."""
    members: dict[str, int] = {}
    machines, chosen = 0, []
    for lang, _ in sorted(counts, key=lambda c: (-c[1], c[0])):
        group = family(lang)
        more = members[group] if group in members else len(members)
        if machines + more > most:
            break
        machines += more
        members[group] = members.get(group, 0) + 1
        chosen.append(lang)
    return chosen


def language_sample(docs: DataFrame, counts: dict[str, int], per_lang: int = PER_LANG) -> DataFrame:
    """t, lang, fold: at most ``per_lang`` texts of each language of ``counts``, those with the smallest hashes of doc_id and text.

    A hash under a bound that about four times as many texts of the language
    meet lets a row in, so that ranking never sees more; equal rows count once.
    """
    spark = docs.sparkSession
    bounds = [(lang, min(1.0, 4 * per_lang / n) * 2.0**63) for lang, n in counts.items()]
    share = F.broadcast(spark.createDataFrame(bounds, "lang string, most double"))  # at most MOST_MACHINES rows
    h = F.xxhash64("doc_id", "text")
    near = docs.select("lang", h.alias("h"), F.col("text").alias("t")).join(share, "lang").where(F.abs(F.shiftright("h", 1)) * 2.0 <= F.col("most"))
    once = near.groupBy("lang", "h").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("r", rank).where(F.col("r") <= per_lang).select("t", "lang", F.col("h").alias("fold"))


def learn_machines(groups: dict[str, list[str]]):
    """A function that fits the machines of ``groups`` and yields each pickled: (pair, weights, bias)."""

    def learn(rows: Rows, label: np.ndarray, _: np.ndarray) -> Iterator[bytes]:
        families = np.array([family(x) for x in label], dtype=object)
        for names, have in [(sorted(groups), families), *[(members, label) for members in groups.values()]]:
            for a, b in combinations(names, 2):
                y = np.where(have == a, 1.0, -1.0)
                w, bias = fit(rows, y, hinge=True, use=(have == a) | (have == b))
                yield pickle.dumps(((a, b), w.astype(np.float32), bias))

    return learn


def fit_languages(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel:
    """Fit on doc_id, text, lang of ``docs``; rows with a null text or lang aren't used.

    Any number of lang values gives a model; those with the fewest rows are
    left out (and never predicted) once ``MOST_MACHINES`` are needed.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_MACHINES)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    langs = sorted(chosen_languages(list(counts.items())))
    if not langs:
        return LanguageModel({})
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family(lang), []).append(lang)
    sample = language_sample(usable, {x: counts[x] for x in langs}, per_lang)
    made = map(pickle.loads, on_executor(sample, "lang", BITS, CHARS, (), True, learn_machines(groups)))
    return LanguageModel(groups, {pair: (w, bias) for pair, w, bias in made})


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score. Only the text is an input.

    Null and empty texts and those without a letter are ``und`` with score 0,
    as is everything where no language was learned. An empty table gives an
    empty result; of other columns nothing is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([shared.value.predict(t) for t in batch["t"]], columns=["lang_pred", "score"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
