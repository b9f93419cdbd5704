"""Walks over the elements of an array with a small state, in linear time.

A higher-order ``aggregate`` that appends to an array in its state copies
that array at every step.  Here the array is walked slice by slice: inside
a slice the outputs are appended to an array that starts empty, and a
finished slice is appended once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where nested lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def sliced_walk(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]],
                out_type: str, finish: Callable[[Column, Column], Column]) -> Column:
    """Walk ``items`` from ``state`` (a struct); ``step(state, item)`` gives the next state and an
    array of outputs.  ``finish(state, outputs)`` makes the result."""
    nothing = F.array().cast(f"array<{out_type}>")

    def one(acc: Column, item: Column) -> Column:
        new_state, outputs = step(acc["state"], item)
        return F.struct(new_state.alias("state"), F.concat(acc["out"], outputs).alias("out"))

    def over(xs: Column) -> Column:
        def one_slice(acc: Column, number: Column) -> Column:
            part = F.slice(xs, number * SLICE + 1, F.lit(SLICE))
            walked = F.aggregate(part, F.struct(acc["state"].alias("state"), nothing.alias("out")), one)
            return let(walked, lambda w: F.struct(w["state"].alias("state"),
                                                  F.concat(acc["out"], F.array(w["out"])).alias("out")))

        numbers = F.when(F.size(xs) > 0, F.sequence(F.lit(0), ((F.size(xs) - 1) / SLICE).cast("int"))) \
            .otherwise(F.array().cast("array<int>"))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        return F.aggregate(numbers, start, one_slice, lambda acc: finish(acc["state"], F.flatten(acc["out"])))

    return let(items, over)
