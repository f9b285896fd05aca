"""Array views of Arrow string columns: words, hashes and shingles of many texts at once.

Everything works on UTF-8 bytes. A word is a maximal run of bytes outside ``\\x20`` and
``\\x09-\\x0D``; the other bytes of multi-byte characters are never in that set, so byte runs
and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in blocks of about so many bytes, which bounds a worker's memory.
BLOCK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + (BLOCK >> 1), 2 * len(have) if have is not None else 0)
        out = np.empty(size, U)
        out[0] = 1
        done = 1
        while done < size:  # doubling
            k = min(done, size - done)
            out[done : done + k] = out[:k] * U(pow(base, done, 1 << 64))
            done += k
        _powers[name] = have = out
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range ``data[start:end]``; equal bytes give equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1 + salt)) * _power("p", _P, n + 1)[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("i", _INV, n + 1)[starts]
    return mix(raw ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


@dataclass
class Block:
    """Some texts side by side. ``rows`` are their positions in the batch."""

    rows: slice
    data: np.ndarray  # bytes of all texts
    at: np.ndarray  # text k is data[at[k]:at[k + 1]]

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, fold: bool = True, space: np.ndarray = _SPACE) -> "Words":
        """Runs of bytes outside ``space`` (256 flags)."""
        data = _LOWER[self.data] if fold else self.data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~space[self.data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        s = np.flatnonzero(begins)
        e = np.flatnonzero(ends) + 1
        first = np.searchsorted(s, self.at)
        return Words(self, data, s, e, first)


@dataclass
class Words:
    block: Block
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text k are first[k] .. first[k + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.block)), self.counts)


_SHINGLE = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` hashes from each position on (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    acc = np.zeros(n, U)
    for j in range(k):
        acc = mix(acc + h[j : j + n] * U(_SHINGLE[j % 5]) + U(j + 1)) if j % 4 == 3 else acc * U(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(acc ^ U(k))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string array, in order, in blocks of about ``limit`` bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off, buf = column.buffers()
    at = np.frombuffer(off, np.int32, count=n + 1, offset=column.offset * 4).astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield Block(slice(k, end), data[at[k] : at[end]], at[k : end + 1] - at[k])
        k = end


def starts_of(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point."""
    return (data & 0xC0) != 0x80
