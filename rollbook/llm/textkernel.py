"""Vectorised word scanning over Arrow text buffers.

Texts stay UTF-8 bytes. A word is a maximal run of bytes that are ASCII digits, ASCII letters
(lower-cased) or not ASCII, so words are split alike everywhere in this package.

Three kinds of keys serve three needs. ``digest`` (128 bits, cryptographic) is the identity of a text or of
its words; nothing that it says is equal is compared again. ``span_keys`` are 64-bit hashes of words, read
eight bytes at a time and mixed at each step, for memories of one task and for features. ``prefix_hashes``
with ``span_hashes`` give all substrings of one length at once, but texts can be made that collide, so
they only choose candidates that are compared afterwards, or look up pieces of some dozen bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)

#: Lower case for A-Z; zero for every byte that separates words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    FOLD[_a : _b + 1] = 0
#: As FOLD, but digits separate too.
FOLD_LETTERS = FOLD.copy()
FOLD_LETTERS[48:58] = 0

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + 4096)
        up, down = np.full(m, _U(_R)), np.full(m, _U(_R_INV))
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, scaled, are the hashes of substrings."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of data[start:end] for arrays of starts and ends."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


#: Spans of more bytes are hashed one by one.
_LONG = 2048


def digest(raw: bytes | memoryview | np.ndarray) -> bytes:
    """The identity of a string of bytes."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The identity of each row of a block."""
    raw = memoryview(np.ascontiguousarray(data))
    return [digest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of starts and ends."""
    size = end - start
    out = mix(size.astype(np.uint64) + _U(_R))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    on, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(on):
        lane, rest = lanes[start[on] + at], size[on] - at
        short = rest < 8
        lane[short] &= (_U(1) << (rest[short] * 8).astype(np.uint64)) - _U(1)
        out[on] = mix(out[on] ^ lane)
        at += 8
        on = on[rest > 8]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def keys_of(items: list[bytes]) -> np.ndarray:
    """The key that span_keys gives each of these strings."""
    data, at = np.frombuffer(b"".join(items), np.uint8), np.cumsum([0, *map(len, items)])
    return span_keys(data, at[:-1], at[1:])


def hash_bytes(items: list[bytes]) -> np.ndarray:
    """The hash that span_hashes gives each of these strings."""
    data, at = np.frombuffer(b"".join(items), np.uint8), np.cumsum([0, *map(len, items)])
    return span_hashes(prefix_hashes(data), at[:-1], at[1:])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes (a longer text is a run of its own): first, end, bytes, offsets."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of a block: byte spans, hashes, and for each row the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = FOLD):
        self.folded = fold[data]
        inside = self.folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        first[borders] |= inside[borders]
        last[borders - 1] |= inside[borders - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.range = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.range)
        self.hash = span_keys(self.folded, self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their rows; a shorter text, if it has words, is one run."""
    n = len(words.hash)
    mult = mix(np.arange(1, size + 1).astype(np.uint64)) | _U(1)
    left = np.repeat(words.range[1:], words.count) - np.arange(n)
    padded = np.concatenate([words.hash, np.zeros(size, np.uint64)])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += np.where(left > k, padded[k : k + n], _U(0)) * mult[k]
    at = np.arange(n) - np.repeat(words.range[:-1], words.count)
    keep = (left >= size) | ((at == 0) & (np.repeat(words.count, words.count) < size))
    return mix(total[keep]), words.rows()[keep]


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with these columns, cast to the schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema)
