"""Nearest neighbours of vectors within their group, for vectors that come from images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a group that are compared at a time.
BLOCK = 1024


def nearest(vectors: DataFrame, k: int = 3, group: str = "doc_id", row: str = "giorno") -> DataFrame:
    """(group, id, vicino, posto, somiglianza): for each vector (group, id, row, vector) the ``k`` most alike by cosine among those of other
    rows of its group; of equals the smaller id comes first. A group is a sheet, whose cells are a few hundred; it is compared
    in blocks, so that memory grows with its size alone. Vectors of length zero are like nothing (0)."""
    kind = vectors.schema[group].dataType.simpleString()
    schema_out = f"`{group}` {kind}, id long, vicino long, posto int, somiglianza double"

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("id").to_numpy(), kind="stable")
        ids, place = rows.column("id").to_numpy()[order], rows.column("place").to_numpy()[order]
        x = np.array(rows.column("vector").to_pylist(), float)[order]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parts = []
        for first in range(0, len(ids), BLOCK):
            some = slice(first, first + BLOCK)
            like = np.round(x[some] @ x.T, 6)
            like[place[some][:, None] == place[None, :]] = -np.inf
            best = np.argsort(-like, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(like, best, 1)
            r, c = np.nonzero(np.isfinite(value))
            parts.append((ids[some][r], ids[best[r, c]], c + 1, value[r, c]))
        a, b, n, s = (np.concatenate([p[j] for p in parts]) for j in range(4))
        name = rows.column(group)[0]
        return pa.table({group: pa.array([name.as_py()] * len(a), name.type), "id": pa.array(a, pa.int64()), "vicino": pa.array(b, pa.int64()), "posto": pa.array(n, pa.int32()), "somiglianza": pa.array(s, pa.float64())})

    return vectors.select(group, F.col("id").cast("long").alias("id"), F.col(row).cast("long").alias("place"), "vector").groupBy(group).applyInArrow(run, schema_out)
