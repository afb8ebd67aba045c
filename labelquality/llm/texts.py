"""Small helpers for text inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it


def trim() -> None:
    """Give memory that is free but held by allocators back to the system; workers live through many stages."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM:
        _MALLOC_TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, and one row at least: memory stays bounded."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        trim()


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and the n + 1 offsets of the parts."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix64 finaliser); one-to-one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
