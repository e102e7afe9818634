"""Audit of sources: how the words of each source of a language diverge from those of the other sources and of the whole language.

Texts are cut to terms on their UTF-8 bytes: a lookup table in numpy tells the
class of each byte of many texts joined to one buffer, and the borders are
where the class changes. Slices are grouped by XXH64 and the bytes of each
compared with those of its group; a batch where they differ is grouped by the bytes
themselves. Tasks emit a row for each language, source and term, so one common
term gives a task few rows, however often it occurs.

Kept terms of a language are dealt to blocks of bounded size, each a CSR
matrix of sources by terms. All arithmetic is on whole numbers. For each source
the terms of all others are compared with it at once, and ``reduceat`` sums them by
source. What pairs have in common, that a term occurs in neither, is counted,
not computed, so the work grows with the entries, not with the terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.memory import give_back
from foliant.llm.text import slices, whole
from foliant.runtime import materialize, spread

#: Digits that a step of a long division adds; three steps give shares of 10 ** 9.
DIGITS = 3
#: A term needs so many documents of its language; so many terms of a group are reported.
LEAST_DOCS, TOP = 10, 10
#: Entries that a block of terms is made for, and sources that a block compares with all others.
BLOCK, SOURCES = 1 << 18, 256
#: Gaps that are computed at a time.
_CELLS = 1 << 18
#: Rows of counts that a task holds before it passes them on.
_HELD = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_slices(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the terms in a buffer: maximal runs of ASCII letters and bytes beyond ASCII."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[np.frombuffer(data, np.uint8)], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def grouped(pieces: list[bytes], hashed=xxhash.xxh64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and for each piece which of them it is."""
    h = np.fromiter(map(hashed, pieces), np.uint64, len(pieces))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    terms = [pieces[i] for i in first.tolist()]
    if list(map(terms.__getitem__, number.tolist())) != pieces:  # two terms with one hash
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        terms = list(known)
    return terms, number


def count_terms(group: np.ndarray, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of texts that belong to numbered groups, and for each group and term that meet: group, term, occurrences, texts."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(parts).lower()  # of bytes: A-Z only
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    start, end = term_slices(data)
    terms, number = grouped([data[a:b] for a, b in zip(start.tolist(), end.tolist())])
    text = np.searchsorted(ends, start, "right")
    met, times = np.unique(text * max(1, len(terms)) + number, return_counts=True)
    text, number = np.divmod(met, max(1, len(terms)))
    key, at, docs = np.unique(group[text] * max(1, len(terms)) + number, return_inverse=True, return_counts=True)
    sums = np.bincount(at, times, len(key)).astype(np.int64)  # exact below 2 ** 53
    return terms, *np.divmod(key, max(1, len(terms))), sums, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs for what meets in a task, from docs (lang, source, t); an empty term marks each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
        for batch in batches:
            for part in slices(batch, "t", rows=4096):
                group, names = pd.factorize(pd.MultiIndex.from_frame(part[["lang", "source"]]))
                terms, at, number, n, found = count_terms(group.astype(np.int64), part["t"].tolist())
                both = (n * (1 << 32) + found).tolist()  # texts of so few rows fit in 32 bits
                cuts = np.searchsorted(at, np.arange(len(names) + 1)).tolist()
                number = number.tolist()
                for k, name in enumerate(names):
                    counts = held[name]
                    counts.setdefault(b"", 0)
                    for x, v in zip(number[cuts[k] : cuts[k + 1]], both[cuts[k] : cuts[k + 1]]):
                        counts[terms[x]] = counts.get(terms[x], 0) + v
                if sum(map(len, held.values())) > _HELD:
                    yield from emitted(held)
        yield from emitted(held)
        give_back()

    return docs.mapInPandas(run, "lang string, source string, term string, n long, docs long")


def emitted(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pd.DataFrame]:
    """The counts so far as rows, which are then forgotten."""
    while held:
        (lang, source), counts = held.popitem()
        both = list(counts.values())
        yield pd.DataFrame({
            "lang": lang, "source": source, "term": [t.decode("utf-8", "surrogatepass") for t in counts],
            "n": [v >> 32 for v in both], "docs": [v & 0xFFFFFFFF for v in both],
        })


def kept_entries(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, all_n (in the language), first (one row of each term); written.

    Terms of fewer than ``least_docs`` documents of their language are left
    out; each (lang, source) has a row of the empty term.
    """
    rows = spread(docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("t")))
    # dealt by language and term, so that neither of the sums below needs another exchange
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", "term", "n", F.sum("n").over(one).alias("all_n"), F.sum("docs").over(one).alias("df"), (F.min("source").over(one) == F.col("source")).alias("first"))
    return materialize(told.where((F.col("term") == "") | (F.col("df") >= least_docs)).drop("df"), "divergence-entries")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10 ** 9 * count / total), by long division with three digits a step: exact for totals below 9 * 10 ** 15."""
    whole_part, rest = F.lit(0).cast("long"), count
    for step in (1, *[10**DIGITS] * 3):
        rest, whole_part = rest * step, whole_part * step
        whole_part, rest = whole_part + _div(rest, total), rest % total
    return whole_part + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division; both sides are at least 0."""
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of arrays of whole numbers."""
    whole_part, rest = np.zeros(np.broadcast(counts, total).shape, np.int64), counts
    for step in (1, *[10**DIGITS] * 3):
        rest, whole_part = rest * step, whole_part * step
        whole_part, rest = whole_part + rest // total, rest % total
    return whole_part + 1


def gap(p, q):
    """floor((p - q) ** 2 / (p + q)) of arrays."""
    d = p - q
    return d * d // (p + q)


def pair_sums(row: np.ndarray, term: np.ndarray, count: np.ndarray, total: np.ndarray, terms: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of gaps over all terms of the block) of each wanted source a and each source b after it.

    ``row`` (ascending), ``term``, ``count`` are the entries of a matrix of
    sources by terms, ``total`` what shares of each source are taken of.
    """
    size = len(total)
    indptr = np.searchsorted(row, np.arange(size + 1))
    value, zero = shares(count + 2, total[row]), shares(np.full(size, 2, np.int64), total)
    some, step, out = np.flatnonzero(np.diff(indptr)), max(1, _CELLS // max(1, size)), []
    for a in wanted.tolist():
        lo, hi = indptr[a], indptr[a + 1]
        dense = np.full(terms, zero[a])
        dense[term[lo:hi]] = value[lo:hi]
        sums = gap(zero[a], zero) * (terms - (hi - lo))
        for x in range(lo, hi, step):
            sums[a:] += gap(value[x : min(x + step, hi), None], zero[None, a:]).sum(0)
        if len(some):
            at = dense[term]
            sums[some] += np.add.reduceat(gap(at, value) - gap(at, zero[row]), indptr[some])
        out.append((np.full(size - a - 1, a), np.arange(a + 1, size), sums[a + 1 :]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _paired(block: pd.DataFrame) -> pd.DataFrame:
    """lang, a, b, part of a block: its entries (term, n) and a row without a term for each source, ``mine`` if it is compared here."""
    marks = block[block["term"].isna()].sort_values("source")
    entries = block[block["term"].notna()]
    names = pd.Index(marks["source"].astype(object))
    row = names.get_indexer(entries["source"])
    term, known = pd.factorize(entries["term"])
    order = np.lexsort((term, row))
    total = (marks["n"] + 2 * marks["v"]).to_numpy(np.int64)
    total = np.maximum(total, 1)  # no kept term: nothing is summed
    a, b, part = pair_sums(row[order], term[order], entries["n"].to_numpy(np.int64)[order], total, len(known), np.flatnonzero(marks["mine"].to_numpy(bool)))
    names = names.to_numpy()
    return pd.DataFrame({"lang": block["lang"].iloc[0], "a": names[a], "b": names[b], "part": part.astype(np.int64)})


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other one (``pair``) and the terms that tell it from its language (``term``).

    Null texts, languages and sources are empty strings; a source without
    terms has its pairs and no term, a language without kept terms has pairs
    of value 0, one with a single source no pairs. Repeated rows count again;
    an empty table gives an empty result; other columns aren't read. Ties are
    in order of the items' bytes.
    """
    entries = kept_entries(docs, lang, source, text, least_docs)
    mark = F.col("term") == ""
    groups = materialize(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), "divergence-groups")
    langs = entries.groupBy("lang").agg(
        F.sum(F.when(F.col("first") & ~mark, 1).otherwise(0)).alias("v"), F.sum("n").alias("lang_total"), F.sum(mark.cast("long")).alias("sources"), F.count("*").alias("entries")
    )
    langs = langs.withColumn("blocks", _div(F.col("entries"), F.lit(BLOCK)) + 1).withColumn("parts", (_div(F.col("sources") - 1, F.lit(SOURCES)) + 1).cast("int"))
    langs = materialize(langs, "divergence-langs")
    sized = groups.join(_small(langs), "lang")
    met = entries.where(~mark & (F.col("n") > 0)).join(_small(langs), "lang")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    p, q = share(F.col("n") + 2, F.col("total") + 2 * F.col("v")), share(F.col("all_n") + 2, F.col("lang_total") + 2 * F.col("v"))
    told = met.join(_small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    terms = told.select("*", rank).where(F.col("rank") <= top)

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece")
    cells = met.select("lang", "source", "term", "n", "v", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.lit(False).alias("mine"), every)
    marks = sized.select("lang", "source", F.col("total").alias("n"), "v", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    mine = F.pmod(F.xxhash64("source"), F.col("parts")) == F.col("piece")
    marks = marks.select("*", every).select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "v", "block", mine.alias("mine"), "piece")
    parts = cells.unionByName(marks).groupBy("lang", "block", "piece").applyInPandas(_paired, "lang string, a string, b string, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = sums.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])), "value")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", rank)
    return pairs.unionByName(terms)


def _small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has few rows and bytes; else Spark shuffles both sides."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    few = df.select(F.count("*").alias("rows"), F.sum(sum(texts[1:], texts[0])).alias("bytes")).first()
    return F.broadcast(df) if few["rows"] <= 20_000 and (few["bytes"] or 0) <= 1 << 20 else df
