"""Join helper: broadcast a side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows of at most so many bytes.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


def broadcast_if_small(keys: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(keys)`` when a table of narrow keys is proven small, else ``keys``.

    For sides that are read or written already: the check runs the side's
    own plan.  Where it would run an aggregation over a large table, leave
    the choice to adaptive execution, which knows the size when it has run.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(16))
    rows, size = keys.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(keys) if rows <= max_rows and size <= BROADCAST_MAX_BYTES else keys
