"""Terms of texts, a column at a time: maximal runs of ASCII letters and digits and of everything beyond ASCII.

A-Z are lower-cased, every other ASCII character separates.  Both are one byte table over the
UTF-8 bytes, so the offsets of a column's texts stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20     # of text that is cut into terms at once (one text may be longer)

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = ord(" ")
_TABLE[ord("A"):ord("Z") + 1] += ord("a") - ord("A")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about SLICE_BYTES of the column ``text``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every term in ``texts``, in order; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])  # a slice keeps its parent's buffers
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(_TABLE[data].tobytes()))
    lists = pc.ascii_split_whitespace(plain)
    rows, terms = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(terms), 0)
    return rows[real.to_numpy(zero_copy_only=False)], terms.filter(real)
