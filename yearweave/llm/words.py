"""Words of many texts at once: where they are, and 64-bit hashes of words and of word windows.

All functions work on numpy arrays inside a task. Memory follows SEGMENT and the longest single
text, never the partition.
"""

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_INV_P = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

#: Bytes to bytes: white space to a blank, all others unchanged.
WHITE = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
#: A-Z to a-z; whatever is not a digit, a letter or part of a non-ASCII character to a blank.
FOLDED = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd number modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, U64(self.base & _MASK))
            steps[0] = U64(1)
            self.table = np.multiply.accumulate(steps)
        return self.table[:n]


_UP, _DOWN = _Powers(_P), _Powers(_INV_P)


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64((seed * 2 + 1) * _Q & _MASK))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not blanks."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff((buf != 32).view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash per word, a polynomial in its bytes. Works through SEGMENT bytes at a time."""
    values = byte_values(seed)
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(values[buf[lo:hi]] * _UP.upto(hi - lo), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _DOWN.upto(hi - lo)[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(_Q))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values; len(hashes) - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    block, size = hashes, 1
    acc, done = None, 0
    rest = width
    while rest:
        if rest & 1:
            m = len(hashes) - done - size + 1
            part = block[done : done + m] if acc is not None else block[:m]
            acc = part.copy() if acc is None else acc[:m] * U64(pow(_Q, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            m = len(hashes) - 2 * size + 1
            block = block[:m] * U64(pow(_Q, size, 1 << 64)) + block[size : size + m]
            size *= 2
    return mix(acc[:n])


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions, in the joined words of several texts, at which a window lies in one text."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(total) + width <= ends)


def groups(texts: Iterable[bytes], limit: int = SEGMENT) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `limit` bytes together, with the index of the first."""
    first, some, size = 0, [], 0
    for text in texts:
        if some and size + len(text) > limit:
            yield first, some
            first, some, size = first + len(some), [], 0
        some.append(text)
        size += len(text)
    if some:
        yield first, some


class Words:
    """The words of a group of texts: bytes, spans, and how many each text has."""

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(texts).translate(table)
        self.buf = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = spans(self.buf)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.cumsum(lengths + 1)
        upto = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(upto, prepend=0)
        self.first = upto - self.counts

    def hashes(self, seed: int = 1) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends, seed)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
