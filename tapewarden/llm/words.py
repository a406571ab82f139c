"""Word and shingle hashes of Arrow text columns, a few numpy passes for many documents at once.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. None of those bytes occurs
inside a multi-byte UTF-8 sequence, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of numpy work takes; a longer text goes alone.
ROUND_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_SIGN = np.zeros(256, dtype=bool)
_IS_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]
_BYTE_VALUE[_IS_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15 & ~7 | 3)  # 3 mod 8: its powers differ in low bits as late as possible
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Texts(NamedTuple):
    """Rows ``first`` to ``first + len(bounds) - 1`` of a column as bytes; row i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def text_rounds(column: pa.Array, limit: int = ROUND_BYTES) -> Iterator[Texts]:
    """Consecutive rows of a string column, about ``limit`` bytes at a time; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)
    offsets = offsets[column.offset :].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Hash of each word, where the words of row i begin (``rows[i]`` to ``rows[i + 1]``), and the words' first bytes."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray


def words(texts: Texts, split_punctuation: bool = False) -> Words:
    """The words of each row; with ``split_punctuation`` runs of ASCII punctuation are words of their own."""
    data, bounds = texts.data, texts.bounds
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64))
    space = _IS_SPACE[data]
    begins = ~space
    if split_punctuation:
        sign = _IS_SIGN[data]
        begins[1:] &= space[:-1] | (sign[1:] != sign[:-1])
    else:
        begins[1:] &= space[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    begins[heads] = ~space[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64))
    sums = np.add.reduceat(_BYTE_VALUE[data] * powers(_STEP, n), starts)
    return Words(mixed(sums * powers(_BACK, n)[starts]), np.searchsorted(starts, bounds), starts)


def word_beginnings(texts: Texts, found: Words, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes of each word, A-Z lower-cased, or of the whole of a shorter word."""
    data = np.concatenate([texts.data, np.full(length, 32, np.uint8)])
    out = np.zeros(len(found.starts), dtype=np.uint64)
    inside = np.ones(len(found.starts), dtype=bool)
    ends = np.repeat(texts.bounds[1:], np.diff(found.rows))  # the next text begins without a space
    for k in range(length):
        byte = data[found.starts + k]
        inside &= ~_IS_SPACE[byte] & (found.starts + k < ends)
        out += np.where(inside, _BYTE_VALUE[byte], np.uint64(0)) * _PLACE[k]
    return mixed(out)


def shingles(found: Words, width: int = 5) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each row, sorted; a shorter text is one shingle, an empty one none."""
    hashes, rows, _ = found
    n = len(hashes)
    joined = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        joined += hashes[k : k + len(joined)] * _PLACE[k]
    joined = mixed(joined)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= width:
            one = np.sort(joined[a : b - width + 1])
            fresh = np.ones(len(one), dtype=bool)
            fresh[1:] = one[1:] != one[:-1]
            out.append(one[fresh])
        elif b > a:
            short = np.add.reduce(hashes[a:b] * _PLACE[: b - a])
            out.append(mixed(np.array([short + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def flat_shingles(found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of :func:`shingles` one behind the other, and where each begins and ends."""
    hashes, rows, _ = found
    sizes = np.diff(rows)
    joined = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        joined += hashes[k : k + len(joined)] * _PLACE[k]
    joined = mixed(joined)
    owner = np.repeat(np.arange(len(sizes)), np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64)))
    counts = np.bincount(owner, minlength=len(sizes))
    heads = np.cumsum(counts) - counts
    at = np.arange(len(owner)) + (rows[:-1] - heads)[owner]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    element = np.zeros(len(owner), dtype=np.uint64)
    full = sizes[owner] >= width
    element[full] = joined[at[full]]
    sums = sizes[short].astype(np.uint64)
    for k in range(width - 1):
        has = sizes[short] > k
        sums[has] += hashes[rows[:-1][short[has]] + k] * _PLACE[k]
    element[heads[short]] = mixed(sums)
    order = np.argsort(element)
    order = order[np.argsort(owner[order], kind="stable")]
    element = element[order]
    fresh = np.ones(len(element), dtype=bool)
    fresh[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    return element[fresh], np.append(0, np.cumsum(np.bincount(owner[fresh], minlength=len(sizes))))


def fingerprints(element: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fingerprint` of sets one behind the other, none of them empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a = np.add.reduceat(mixed(element ^ np.uint64(0x5851F42D4C957F2D)), starts)
    b = np.add.reduceat(mixed(element * np.uint64(0xD6E8FEB86659FD93)), starts)
    return a.view(np.int64), b.view(np.int64)


def fingerprint(one: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of shingles."""
    a = np.add.reduce(mixed(one ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mixed(one * np.uint64(0xD6E8FEB86659FD93)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
