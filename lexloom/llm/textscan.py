"""Vectorised scans over the UTF-8 buffer of an Arrow string column: words, lines, hashes of both, without a Python object per word.

Hashes are 64-bit polynomials over randomly mapped bytes, finished with a bit mixer. Two texts of equal hash are taken as
equal; the chance of a false match among n values is n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int, base: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size == CHUNK_BYTES + 1:  # longer ones belong to one giant text and are not kept
            _powers[base] = known
    return known[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(rows: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_BYTES of text; a longer text stands alone."""
    _, offsets = buffers(rows.column(column))
    at = 0
    while at < rows.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield rows.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run outside [\\x20\\x09-\\x0D]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    opens, closes = np.ones(n, bool), np.ones(n, bool)
    opens[1:] = ~solid[:-1]
    closes[:-1] = ~solid[1:]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & opens)
    return starts, np.flatnonzero(solid & closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each \\n-separated line; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    by_start, by_end = np.lexsort((starts, rows)), np.lexsort((ends, rows))
    return starts[by_start], ends[by_end], rows[by_start]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; seeds give independent hashes."""
    base, inverse = (_BASE, _INVERSE) if not seed else ((b := (_BASE * (2 * seed + 1) + 2 * seed) % 2**64 | 1), pow(b, -1, 2**64))
    if not len(data):
        return mix(np.zeros(len(starts), np.uint64) + np.uint64(seed))
    table = _BYTE if not seed else mix(_BYTE + np.uint64(seed)) | np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(len(data), base), out=total[1:])
    h = (total[ends] - total[starts]) * _power(len(data) + 1, inverse)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def windows(h: np.ndarray, rows: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of `width` words inside one row."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(rows[: len(h) - width + 1] == rows[width - 1 :])
    return first, window_hashes(h, first, width, seed)


def window_hashes(h: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the `width` words from each of `first`; a seed gives an independent one."""
    if seed:
        h = mix(h ^ np.uint64(0xA0761D6478BD642F * (2 * seed + 1) % 2**64))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(len(h), _BASE), out=total[1:])
    return mix((total[first + width] - total[first]) * _power(len(h) + 1, _INVERSE)[first])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row of bytes."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]] if len(keys) else np.zeros(0, bool)
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag
