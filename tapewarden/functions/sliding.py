"""Vectorised work over variable-length trailing windows (numpy, one chunk at a time).

Row ``i`` owns the ``size[i]`` values that end ``skip`` places before it
(``skip = 0`` ends with its own value). Chunks are bounded by the caller's
split, blocks bound the temporary matrices here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

_BLOCK = 4096
#: Columns that are skipped or summed together.
_STRIPE = 32


def _windows(
    values: np.ndarray, size: np.ndarray, skip: int, width: int
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of ``(rows, matrix of trailing values, mask of the ones that count)``.

    The matrix has whole stripes of columns up to the largest window of the block, so short windows cost little.
    """
    width = -(-max(width, 1) // _STRIPE) * _STRIPE
    padded = np.concatenate([np.zeros(width - 1 + skip), values])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(values)]
    for start in range(0, len(values), _BLOCK):
        rows = slice(start, start + _BLOCK)
        held = max(int(size[rows].max(initial=1)), 1)
        used = -(-held // _STRIPE) * _STRIPE
        yield rows, view[rows, width - used :], np.arange(used) >= (used - size[rows])[:, None]


def _row_sums(matrix: np.ndarray) -> np.ndarray:
    """Sums of rows, stripe by stripe from the left: leading stripes of zeros change no bit."""
    stripes = matrix.reshape(len(matrix), -1, _STRIPE).sum(axis=2)
    total = np.zeros(len(matrix))
    for stripe in stripes.T:
        total += stripe
    return total


def moments(values: np.ndarray, size: np.ndarray, skip: int, ddof: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation per row, in two passes; empty gives (0, 0), a single value deviation 0.

    Sums are taken of distances to the window's last value, so a flat window has
    exactly its value as mean and deviation 0. They run in the same order wherever a tape was cut.
    """
    mean, std = np.zeros(len(values)), np.zeros(len(values))
    for rows, matrix, mask in _windows(values, size, skip, width):
        n = size[rows]
        anchor = np.where(n > 0, matrix[:, -1], 0.0)
        away = np.where(mask, matrix - anchor[:, None], 0.0)
        centre = _row_sums(away) / np.maximum(n, 1)
        gaps = np.where(mask, away - centre[:, None], 0.0)
        mean[rows] = anchor + centre
        std[rows] = np.where(n > 1, np.sqrt(_row_sums(gaps * gaps) / np.maximum(n - ddof, 1)), 0.0)
    return mean, std


def medians(values: np.ndarray, size: np.ndarray, skip: int, width: int, drop_largest: int = 0) -> np.ndarray:
    """Median per row, optionally after dropping the largest values; zero when nothing is left."""
    out = np.zeros(len(values))
    for rows, matrix, mask in _windows(values, size, skip, width):
        ordered = np.where(mask, matrix, np.inf)
        ordered.sort(axis=1)
        n = size[rows] - drop_largest
        lines = np.arange(len(n))
        high = ordered[lines, np.maximum(n // 2, 0)]
        low = ordered[lines, np.maximum((n - 1) // 2, 0)]
        middle = np.where(low == high, low, (low + high) / 2.0)
        out[rows] = np.where(n > 0, middle, 0.0)
    return out


def latest_match(
    times: np.ndarray,
    owner: np.ndarray,
    side: np.ndarray,
    price: np.ndarray,
    size: np.ndarray,
    reach_us: int,
    most_rows: int,
    price_tolerance: float,
    size_tolerance: float,
    differs: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> np.ndarray:
    """Position of the latest earlier counter-trade per row, -1 for none.

    Looks back one row further per pass and only at rows still unmatched and
    in reach, so the work is the number of rows inside the reach.
    ``owner`` is negative where there is none; ``differs`` compares identities.
    """
    found = np.full(len(times), -1)
    rows = np.flatnonzero(owner >= 0)
    for lag in range(1, most_rows):
        rows = rows[rows >= lag]
        rows = rows[times[rows] - times[rows - lag] <= reach_us]
        if not len(rows):
            break
        other = rows - lag
        hit = (owner[other] == owner[rows]) & (side[other] != side[rows])
        hit &= np.abs(price[other] - price[rows]) / price[rows] <= price_tolerance
        larger = np.maximum(np.maximum(np.abs(size[other]), np.abs(size[rows])), 1e-9)
        hit &= np.abs(size[other] - size[rows]) / larger <= size_tolerance
        hit[hit] = differs(other[hit], rows[hit])
        found[rows[hit]] = other[hit]
        rows = rows[~hit]
    return found


def arrow_columns(compute: Callable, order: str):
    """An ``applyInArrow`` function appending ``compute(chunk)`` (name to array) to a chunk sorted by ``order``."""

    def run(chunk):
        import pyarrow as pa

        ranks = chunk.column(order).to_numpy()
        if len(ranks) > 1 and not (np.diff(ranks) > 0).all():
            chunk = chunk.take(pa.array(np.argsort(ranks, kind="stable")))
        for name, values in compute(chunk).items():
            chunk = chunk.append_column(name, values if isinstance(values, pa.ChunkedArray) else pa.array(values))
        return chunk

    return run
