"""Text as byte arrays: Arrow batches in, numpy spans and hashes out.

Batches are walked in blocks of whole documents of about a quarter of a megabyte, so the
temporaries stay in cache and memory is bounded by the block or by the longest
single text, never by the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
U64 = np.uint64

_BYTES = np.arange(256, dtype=np.uint8)
#: Space and \t \n \v \f \r.
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, U64), np.ones(1, U64))


def release() -> None:
    """Gives freed memory back to the system; Python workers live on after a task and share their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a worker keeps from task to task, by name; tasks of another kind drop it.
kept: dict[str, object] = {}


def forget(keeps: str | None = None) -> None:
    """Drops what tasks of other kinds have kept; a function of the module, as a worker has one of each but many closures."""
    others = [name for name in kept if name != keeps]
    for name in others:
        del kept[name]
    if others:
        release()


def tidy(run, keeps: str | None = None):
    """run, an iterator over batches, with its memory released at the end of the task, and at its start what other kinds of tasks have kept."""

    def wrapped(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        _powers = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) for runs of whole texts of about limit bytes."""
    offsets, data = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of set flags, cut at the offsets of texts."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = flags.copy()
    first[1:] &= ~flags[:-1] | cut[1:n]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: ASCII letters and digits, and every byte of longer characters.
IS_CORE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def core_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without surrounding ASCII punctuation: starts, ends, first word of each text; words of punctuation only are left out."""
    starts, ends = spans(~IS_SPACE[data], offsets)
    if not len(starts):
        return starts, ends, np.zeros(len(offsets), np.int64)
    core, at = IS_CORE[data], np.arange(len(data))
    begin = np.minimum.accumulate(np.where(core, at, len(data))[::-1])[::-1][starts]
    end = np.maximum.accumulate(np.where(core, at, -1))[ends - 1] + 1
    keep = begin < ends
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(begin, offsets)


class Words:
    """Words of a block of texts: spans, 64-bit hashes, and first word of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = True):
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = spans(~IS_SPACE[data], offsets)
        self.first = np.searchsorted(self.starts, offsets)  # text i has words first[i]:first[i+1]
        self.prefix = prefix_hash(self.data)
        self.hashes = span_hash(self.prefix, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; prefix[j] - prefix[i] identifies data[i:j] up to a power of the base."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hash(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of `width` consecutive words, and first window of each text.

    A text of fewer words has one window, its whole sequence; without words, none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    short = np.repeat(n < width, count)
    length = np.where(short, np.repeat(n, count), width)
    acc = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = length > k
            term = mix(hashes[np.where(inside, at + k, at)] + U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            acc = np.where(inside, acc * U64(0xD6E8FEB86659FD93) + term, acc)
        acc = mix(acc + length.astype(U64))
    return acc, begin


def ragged_unique(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each text, and first value of each text."""
    group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, group)) if len(values) < 64 else _group_sort(values, group, begin)
    v, g = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    v, g = v[keep], g[keep]
    return v, np.searchsorted(g, np.arange(len(begin)))


def _group_sort(values: np.ndarray, group: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order by (group, value): one sort by value, then a stable one by group, which is a counting sort for small integers."""
    by_value = np.argsort(values, kind="stable")
    small = group.astype(np.uint16) if len(begin) <= 1 << 16 else group
    return by_value[np.argsort(small[by_value], kind="stable")]
