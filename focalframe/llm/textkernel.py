"""Whole-text tokenising and hashing over Arrow string batches, as array operations on their bytes.

A batch is cut into chunks of whole rows of about ``CHUNK`` bytes, so that temporary arrays stay small.
Words get 64-bit hashes: a polynomial in random byte values, reduced modulo 2^64 and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` pseudorandom 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


class Alphabet:
    """Which bytes part words, and the value each other byte adds to a word's hash; A-Z count as a-z.

    With ``characters`` the letters of scripts written without spaces are words of their own, and full-width signs part words.
    """

    def __init__(self, parting: np.ndarray, characters: bool = False) -> None:
        self.parting, self.characters = parting, characters
        self.value = seeded(256, 11) | U(1)
        self.value[65:91] = self.value[97:123]
        self.value[parting] = 0


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


def _beside_letters(digits: bool) -> np.ndarray:
    out = np.ones(256, bool)
    out[65:91] = out[97:123] = out[128:] = False
    if digits:
        out[48:58] = False
    return out


SPACED = Alphabet(_spaces())
ALNUM = Alphabet(_beside_letters(True))
LETTERS = Alphabet(_beside_letters(False))
LINES = Alphabet(_beside_letters(True), characters=True)

#: First and last code points: letters of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han), and full-width signs.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SIGNS = ((0x2000, 0x206F), (0x3000, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the UTF-8 bytes: which begin a letter of a script without spaces, which follow one, which belong to full-width signs."""
    alone, after, signs = (np.zeros(len(buf) + 4, bool) for _ in range(3))
    for size, low, high in ((3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((buf >= low) & (buf < high))
        at = at[at + size <= len(buf)]
        code = (buf[at] & (0xFF >> (size + 1))).astype(np.int64)
        for j in range(1, size):
            code = code << 6 | (buf[at + j] & 0x3F)
        letter, sign = (np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges]) for ranges in (UNSPACED, SIGNS))
        alone[at[letter]] = after[at[letter] + size] = True
        for j in range(size):
            signs[at[sign] + j] = True
    return alone[: len(buf)], after[: len(buf)], signs[: len(buf)]


class _Powers(list):
    """Two tables that grow with use; a kernel that is sent to a task leaves them behind, and the task makes its own."""

    def __init__(self) -> None:
        super().__init__([np.ones(1, U), np.ones(1, U)])

    def __reduce__(self) -> tuple:
        return _Powers, ()


_BASE = 0x5851F42D4C957F2D
_POWERS = _Powers()


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least ``n`` places."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U)
    return _POWERS


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of about ``size`` bytes; a longer row stands alone."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end
        row = end


def word_starts(buf: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Places of the words' first bytes in rows that the offsets ``at`` bound."""
    inside = ~alphabet.parting[buf]
    if alphabet.characters and len(buf) and buf.max() >= 0xE0:
        alone, after, signs = unspaced(buf)
        inside &= ~signs
    else:
        alone = after = False
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first |= inside & (alone | after)
    edges = at[:-1][at[:-1] < len(buf)]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


def words(data: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows ``data[at[i]:at[i+1]]``, and for each row the offset of its words among them."""
    buf, at = data[at[0] : at[-1]], at - at[0]
    n = len(buf)
    starts = word_starts(buf, at, alphabet)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    power, inverse = _powers(n)
    value = alphabet.value[buf]
    if alphabet.characters and buf.max() >= 0xE0:
        value[unspaced(buf)[2]] = 0
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(value * power[:n], starts) * inverse[starts]
    return mix(sums), np.searchsorted(starts, at)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sequences(hashes: np.ndarray, offsets: np.ndarray, seed: int = 29) -> np.ndarray:
    """A hash of each row's whole sequence of words; 0 for a row without words."""
    out = np.zeros(len(offsets) - 1, U)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        power, inverse = _powers(len(hashes) + 1)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(hashes + U(seed)) * power[: len(hashes)], offsets[full]) * inverse[offsets[full]]
            out[full] = mix(sums ^ mix(np.diff(offsets)[full].astype(U)))
    return out


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's ``k``-word shingles; a row of fewer words has its whole sequence as one."""
    counts = np.diff(offsets)
    made = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    sizes = made.copy()
    sizes[short] = 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begin[-1], U)
    if made.any():
        n = len(hashes) - k + 1
        salts = seeded(k, 5) | U(1)
        with np.errstate(over="ignore"):
            every = hashes[:n] * salts[0]
            for j in range(1, k):
                every += hashes[j : j + n] * salts[j]
        row = rows_of(offsets)
        whole = row[:n] == row[k - 1 :]
        place = np.ones(len(out), bool)
        place[begin[short]] = False
        out[place] = mix(every[whole])
    for r in short:
        out[begin[r]] = sequences(hashes[offsets[r] : offsets[r + 1]], np.array([0, counts[r]]))[0]
    for r in np.flatnonzero(sizes > 1):
        out[begin[r] : begin[r + 1]].sort()
    if not len(out):
        return out, begin
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[begin]


def listed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of longs as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
