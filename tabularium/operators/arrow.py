"""Arrow columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_of(table: pa.Table | pa.RecordBatch, x: str, p: int) -> np.ndarray:
    """The vectors as a matrix; a null vector, one of another length and null components become NaN."""
    column = table.column(x)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), p), False).to_numpy(zero_copy_only=False)
    if fits.all() and p:  # one copy
        flat = column.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
    out = np.full((len(column), p), np.nan)
    if fits.any():
        out[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
    return out


def classes_of(table: pa.Table | pa.RecordBatch, cls: str) -> tuple[np.ndarray, list]:
    """Each row's class as a number, and the classes by number."""
    column = table.column(cls)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode(null_encoding="encode")
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
