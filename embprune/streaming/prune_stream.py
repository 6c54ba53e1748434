"""Prune vectors as they arrive: the violation test needs a row, the queries and their thresholds, so it keeps no state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.blocks import matrix
from ..operators.similarity import CELLS, query_blocks, with_thresholds


def prune_stream(rows: DataFrame, queries: DataFrame, thresholds: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows of a stream (or table) that violate no query: no similarity is strictly above the query's threshold.

    Works for every output mode and sink. Rows without a vector stay. Query blocks beyond the first are further passes over
    what is left, in the same stage. A query without threshold is an error.
    """
    known = with_thresholds(queries.select("id", "embedding"), thresholds)
    at = rows.columns.index(vector_col)
    for block in query_blocks(known, more=["threshold"]):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            _, q, limit = held.value
            step = max(1, CELLS // len(q))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    present = np.flatnonzero(part.column(at).is_valid().to_numpy(zero_copy_only=False))
                    keep = np.ones(part.num_rows, bool)
                    x = matrix(part.column(at).take(pa.array(present)))
                    if len(x):
                        keep[present] = ~(x @ q.T > limit).any(1)
                    yield part.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows
