"""Terms of whole texts as Arrow arrays: runs of ASCII letters, digits and non-ASCII bytes, only A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.common import WORD_BYTE

SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batches, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` of text; a longer text is a part of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            stop = min(stop, at + SLICE_ROWS, b.num_rows)
            yield b.slice(at, stop - at)
            at = stop


class Terms:
    """Terms of a part: ``values[i]`` is a term, ``first[d]:first[d + 1]`` are those of text ``d``."""

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]] if len(offsets) else data
        offsets = offsets - offsets[0]
        inside = WORD_BYTE[data]
        # A run ends where its text ends.
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(start, offsets)
        self.lengths = end - start
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = _LOWER[data[inside]]
        self.values = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(self.bounds), pa.py_buffer(np.ascontiguousarray(self.bytes))]
        )

    def counts(self) -> np.ndarray:
        """Number of terms of each text, repeats included."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each term is in."""
        counts = self.counts()
        return np.repeat(np.arange(len(counts)), counts)
