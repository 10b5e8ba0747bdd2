"""Texts of an Arrow batch as one run of bytes, for kernels that work on whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def groups(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most_bytes`` of text, or of one longer text."""
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()], np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most_bytes:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a line feed, and where each text begins (one more at the end)."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=starts[1:])
    return data, starts


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with ``latin`` also the capitals from U+00C0 to U+00DE."""
    out = _LOWER[data]
    if latin:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[capital] += 32
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and after-last positions of the runs of True; the last element must be False."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]
