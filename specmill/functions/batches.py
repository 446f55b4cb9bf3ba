"""Arrow batches in pieces, so that a Python worker never holds a whole batch as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa

# Rows that are Python objects at once; those of a batch (10,000 rows or 64 MB) take several times its bytes.
PIECE = 64


def in_pieces(f: Callable[..., Iterable], kind: pa.DataType, *columns: pa.Array, rows: int = PIECE) -> pa.Array:
    """The values that f gives for the lists of the columns' values, called on so many rows at a time."""
    starts = range(0, len(columns[0]), rows)
    parts = [pa.array(list(f(*[c.slice(i, rows).to_pylist() for c in columns])), kind) for i in starts]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
