"""Words of whole texts as byte offsets and hashes, vectorised over an Arrow string column.

A word is a run of bytes other than space and \\x09-\\x0D. Those are single ASCII bytes, so
splitting UTF-8 bytes there is the same as splitting characters. Work goes through slices of
SLICE_BYTES, as each byte takes some tens of bytes at work; only one longer text can make a slice larger."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 512 << 10
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system. A worker stays with its executor after a task, and what it holds counts there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over the batches of a task, which then leaves no freed memory with the worker."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return tidied


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES:
            _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column without copying; NULL reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), data


@dataclass
class Slice:
    """Words of the rows ``first`` .. ``first + len(counts) - 1`` of a batch."""

    first: int
    data: np.ndarray       # the rows' bytes
    offsets: np.ndarray    # of the rows in data, one more than rows
    starts: np.ndarray     # of the words in data
    ends: np.ndarray
    counts: np.ndarray     # words per row

    @property
    def bounds(self) -> np.ndarray:
        """Index of each row's first word, one more than rows."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self, lane: int = 0) -> np.ndarray:
        """One 64-bit hash per word; the two lanes are independent."""
        n = len(self.data)
        base = _BASE[lane]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[lane][self.data] * powers(base, n)[:n], out=sums[1:])
        inverse = pow(base, -1, 1 << 64)
        at_start = powers(inverse, n)[self.starts]
        return mix((sums[self.ends] - sums[self.starts]) * at_start + (self.ends - self.starts).astype(np.uint64))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    offsets, data = string_buffers(column)
    rows = len(offsets) - 1
    at = 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), rows)
        part = data[offsets[at]: offsets[end]]
        local = offsets[at: end + 1] - offsets[at]
        inside = ~IS_SPACE[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = local[1:-1]
        edges = edges[(edges > 0) & (edges < len(part))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(starts)
        ends = np.flatnonzero(ends) + 1
        counts = np.diff(np.searchsorted(starts, local))
        yield Slice(at, part, local, starts, ends, counts)
        at = end


def grams(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every k consecutive word hashes; crosses rows, so the caller masks."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(base) + words[i: i + n]
    return mix(out)
