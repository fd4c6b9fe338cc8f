"""UTF-8 text columns of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_a:_b] = True


def count_tokens(column: pa.Array) -> np.ndarray:
    """Matches of ``[a-zA-Z0-9]+`` in each text (0 for a null)."""
    off, raw = utf8(column)
    if not len(raw):
        return np.zeros(len(off) - 1, np.int64)
    inside = _ALNUM[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]  # a text's own first byte can start a token
    starts[first] = inside[first]
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
