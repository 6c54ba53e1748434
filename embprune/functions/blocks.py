"""Numpy on Arrow batches of vectors, for products that expressions cannot block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of vectors as a 64-bit matrix; a null, or vectors of different lengths, are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    width = pc.min_max(pc.list_value_length(column))
    if column.null_count or width["min"] != width["max"]:
        raise ValueError(f"vectors must be there and of one length: {column.null_count} nulls, lengths {width['min']} to {width['max']}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_first(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """In each row the k largest similarities with their ids, largest first, ties to the smaller id."""
    if sims.shape[1] > 2 * k:
        limit = np.partition(sims, -k, 1)[:, -k, None]
        # As many as any row has at its limit and above, so that ties are all there.
        most = int((sims >= limit).sum(1).max())
        if most < sims.shape[1]:
            at = np.argpartition(sims, -most, 1)[:, -most:]
            sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
