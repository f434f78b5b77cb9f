"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scaled components stay below this, so that squared distances and inner products of up to 2^6 of them fit 64 bits.
MOST = 1 << 27


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that have a whole vector, and these vectors as floor(scale * x).

    A row has none if its vector is null, empty, or holds a null or a component
    that isn't finite.  Vectors of one batch that differ in length, and
    components of 2^27 or more once scaled, raise ValueError.
    """
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # null rows hold no values once flattened
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    kept = np.flatnonzero((lengths > 0) & (bad[ends] == bad[ends - lengths]))
    if not len(kept):
        return kept, np.zeros((0, 0), dtype=np.int64)
    size = lengths[kept]
    if (size != size[0]).any():
        raise ValueError(f"vectors of {size.min()} and {size.max()} components in one column")
    rows = values[(ends - lengths)[kept][:, None] + np.arange(size[0])] * scale
    if (np.abs(rows) >= MOST).any():
        raise ValueError(f"a component times {scale} is {MOST} or more")
    return kept, np.floor(rows).astype(np.int64)
