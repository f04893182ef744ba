"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word.

Words of up to ``SHORT`` bytes have a sum of byte values times powers, mixed;
longer ones, for which texts of two letters with one such sum can be written
down, have a cryptographic hash.  Of n distinct words about n^2 / 2^65 pairs
share a hash: some 3 of ten thousand million words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SLICE_BYTES = 2 << 20
SHORT = 64
_MULTIPLIER, _SECOND = 0x9E3779B97F4A7C15 | 1, 0xE7037ED1A0B428DB | 1
_SEPARATORS = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits both depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(factor: int) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))
    values[65:91] = values[97:123]  # A-Z count as a-z
    values[list(_SEPARATORS)] = 0
    return values


# Of the word hash, and of a second one that shares nothing with it.
_VALUES = _byte_values(0xD1342543DE82EF95), _byte_values(0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SEPARATORS)] = False
_POWERS = {}


def _powers(n: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get(second, [()])[0]) < n:
        size, base = max(n, SEGMENT), _SECOND if second else _MULTIPLIER
        found = []
        for step in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, step, dtype=np.uint64)
            factors[0] = 1
            found.append(np.multiply.accumulate(factors))
        _POWERS[second] = tuple(found)
    return _POWERS[second]


def split_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each word of the texts that ``offsets`` bound."""
    word = _IS_WORD[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[at_text] |= word[at_text]
    return np.flatnonzero(starts)


def run_hashes(raw: np.ndarray, starts: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the bytes from each start to the next one, separators left out, A-Z as a-z; ``second``: another one.

    Bytes are handled in segments that end before a start, so memory beyond the
    result is bounded by the longest run.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + SEGMENT)))
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(raw)
        up, down = _powers(hi - lo, second)
        rel = starts[a:b] - lo
        out[a:b] = np.add.reduceat(_VALUES[second][raw[lo:hi]] * up[: hi - lo], rel) * down[rel]
        a = b
    out = mix(out)
    for i in np.flatnonzero(np.diff(starts, append=len(raw)) > SHORT):
        run = raw[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(raw)]
        word = _LOWER[run[_IS_WORD[run]]]
        if len(word) > SHORT:
            out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, person=b"second" if second else b"").digest(), "little")
    return out


def word_hashes(column: pa.Array, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) for words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    raw, offsets = split_buffers(column)
    starts = word_starts(raw, offsets)
    return run_hashes(raw, starts, second), np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words, its text); texts with 1 to n-1 words give one shorter run."""
    counts = np.diff(bounds)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), runs)
    first = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    out = np.zeros(len(owner), dtype=np.uint64)
    length = np.minimum(counts, n)[owner]
    for i in range(n):
        here = length > i
        out[here] = mix(out[here] * np.uint64(0x2545F4914F6CDD1D) + hashes[first[here] + i] + np.uint64(i + 1))
    return out, owner


def release() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system: workers are reused over stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text (one text at least) and at most ``rows`` rows."""
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            before = lengths[a - 1] if a else 0
            b = min(a + rows, max(a + 1, int(np.searchsorted(lengths, before + size))))
            yield batch.slice(a, b - a)
            a = b
