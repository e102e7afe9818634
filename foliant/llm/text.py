"""Column expressions and ways through texts that several operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the fast built-in, which does just that for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lowered; null has none. ``bytes`` knows just the contracts' white space and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batch: pd.DataFrame, column: str, rows: int = 512, chars: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """``batch`` in parts of at most so many rows, and so many characters of ``column`` unless one row alone has more."""
    block = np.cumsum(np.fromiter((len(t) if t else 0 for t in batch[column]), np.int64, len(batch))) // chars
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(block, prepend=-1)), np.arange(0, len(batch), rows), [len(batch)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.iloc[lo:hi]
