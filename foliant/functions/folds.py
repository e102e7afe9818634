"""Folds along an array that tell something at each of its members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let

#: Members that one inner fold goes over.
PART = 64


def fold_each(items: Column, zero: Column, step: Callable[[Column, Column], Column], told: Callable[[Column], Column], kind: str) -> Column:
    """An array of ``told(state)`` (of type ``kind``) for the state after each item, where state = ``step(state, item)`` and first ``zero``.

    ``aggregate`` copies its state at each step, so a result that grows in it
    takes quadratic time. Here a first fold keeps only the states at the starts of
    parts; each part is then folded from its own start, with a result of at
    most ``PART`` members. That is linear up to some 100,000 items.
    """
    states, nothing = F.struct(zero.alias("state"), F.filter(F.array(F.struct(zero.alias("state"))), lambda _: F.lit(False)).alias("starts")), F.array().cast(f"array<{kind}>")

    def parts(items: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.floor((F.size(items) + PART - 1) / PART).cast("int")), lambda c: c * PART < F.size(items))
        return F.transform(numbers, lambda c: F.slice(items, c * PART + 1, F.lit(PART)))

    def starts(parts: Column) -> Column:
        def over(acc: Column, part: Column) -> Column:
            return F.struct(F.aggregate(part, acc["state"], step).alias("state"), F.array_append(acc["starts"], F.struct(acc["state"].alias("state"))).alias("starts"))

        # where the last part ends nobody needs to know
        some = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.aggregate(some, states, over, lambda acc: F.array_append(acc["starts"], F.struct(acc["state"].alias("state"))))

    def within(part: Column, start: Column) -> Column:
        # what a state tells is added in the step after it, so that no state is computed twice
        one = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], told(acc["state"])).alias("out"))
        last = lambda acc: F.slice(F.array_append(acc["out"], told(acc["state"])), F.lit(2), F.size(acc["out"]))
        return F.aggregate(part, F.struct(start.alias("state"), nothing.alias("out")), one, last)

    return let(items, lambda x: let(parts(x), lambda p: let(starts(p), lambda s: F.flatten(F.transform(p, lambda part, k: within(part, F.get(s, k)["state"]))))))
