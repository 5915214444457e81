"""Batches of texts in slices: what Python makes of a text is many times as large, and a batch has 10,000 rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are gone through at a time; a longer text is by itself.
SLICE_BYTES = 256 << 10


def cuts(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of neighbouring rows whose texts have about ``most`` bytes, 64 more counted for each row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(texts)], strict=True))


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices by the texts of a column."""
    for batch in batches:
        for start, stop in cuts(batch.column(column)):
            yield batch.slice(start, stop - start)


def sliced(read: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A function of texts, applied to slices of them; what it has made of one is Arrow's before the next is read."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([read(texts.slice(start, stop - start)) for start, stop in cuts(texts)])

    return run
