"""Vectorised word scanning and hashing over Arrow text columns.

A word's 64-bit hash is a polynomial of its bytes, taken as a difference of
running sums, so that whole batches are hashed without a Python loop over words.
Texts of any length are scanned in segments of about ``SEGMENT`` bytes that are
cut between words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
U = np.uint64
_M64 = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_VALUE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_FOLDED = _VALUE[FOLD]
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of the base and of its inverse; they grow to the longest segment seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT + 4096)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``size`` bytes of text; a longer text is a run of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = text_buffer(column)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that hands freed memory back to the system when its task ends.

    Workers are reused, so what an idle one holds back counts against its executor."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
            if trim:
                trim(0)

    return tidy


#: Letters: ASCII letters and every byte beyond ASCII.
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray = IS_WORD, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the n + 1 word offsets of the n texts.

    A-Z count as a-z.  ``member`` tells which bytes make words.  With ``prefixes``
    the hashes have a column for the word and one for each prefix of so many bytes."""
    edges = np.unique(at[:-1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(data):
        hi = min(lo + SEGMENT, len(data))
        if hi < len(data):  # cut at the last gap, or else at the next one
            gaps = np.flatnonzero(~member[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                step = hi
                while step < len(data) and not len(gaps):
                    gaps = np.flatnonzero(~member[data[step : step + SEGMENT]])
                    hi = step + int(gaps[0]) + 1 if len(gaps) else min(step + SEGMENT, len(data))
                    step += SEGMENT
        part = data[lo:hi]
        is_word = member[part]
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        inner = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] - lo
        cut = np.zeros(len(part) + 1, dtype=bool)
        cut[inner] = True
        start = np.flatnonzero(is_word & (~before | cut[:-1]))
        end = np.flatnonzero(np.append(before & (~is_word | cut[:-1]), is_word[-1]))
        up, down = _POWERS(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(_FOLDED[part] * up[: len(part)], out=total[1:])
        stops = [end, *(np.minimum(end, start + k) for k in prefixes)]
        h = np.stack([mixed((total[e] - total[start]) * down[start]) for e in stops], 1)
        found.append((start + lo, end + lo, h if prefixes else h[:, 0]))
        lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1 + len(prefixes)) if prefixes else 0, U), np.zeros(len(at), np.int64)
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, end, h, np.searchsorted(start, at)
