"""Running aggregates along keys of any size: inside slices of a key, shifted by what lies before the slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], slice_col: str, order: list[Column | str],
            values: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``df`` with one running aggregate (the row included) for each of ``values``.

    ``values`` maps a new column to (aggregate, input, combine).  ``slice_col`` cuts a key into
    slices that follow one another in ``order``; a slice is sorted in one task, a key is not.
    Only slices behind a key's first one are shifted, so a key in one slice costs nothing more.
    """
    slices = [*keys, slice_col]
    upto = Window.partitionBy(*slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({name: agg(value).over(upto) for name, (agg, value, _) in values.items()})
    whole = df.groupBy(*slices).agg(*[agg(value).alias(name) for name, (agg, value, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    shift = whole.select(*slices, F.row_number().over(Window.partitionBy(*keys).orderBy(slice_col)).alias("__nth"),
                         *[agg(F.col(name)).over(before).alias(f"__{name}") for name, (agg, _, _) in values.items()]) \
        .filter("__nth > 1").drop("__nth")
    return inside.join(shift, slices, "left").withColumns(
        {name: F.coalesce(combine(F.col(name), F.col(f"__{name}")), F.col(name)) for name, (_, _, combine) in values.items()}) \
        .drop(*[f"__{name}" for name in values])


def add(x: Column, y: Column) -> Column:
    return x + y


def xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)
