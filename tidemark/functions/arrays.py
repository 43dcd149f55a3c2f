"""Steps over a key's rows as numpy arrays, where a window would go through its whole frame again for every row.

Null is NaN. Frames count rows and are null until enough non-null rows are in them, as in ``frames``. A frame is summed from its oldest
row on, as a window does, with one operation for all rows of the key (and for all columns of a stack); nothing is subtracted, so no earlier value costs precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows whose frames are sorted at once.
_BLOCK = 4096


def along(df: DataFrame, read: Iterable[str], added: Iterable[str], *steps: Callable[[dict[str, np.ndarray]], None], key: str = "symbol", order: str = "date") -> DataFrame:
    """Add the columns ``added`` (doubles), which the steps put beside the columns ``read`` of a key's rows in order. A task holds one
    key's rows at a time, one shuffle by the key at most."""
    read, added = list(read), list(added)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        series = {c: rows[c].cast(pa.float64()).to_numpy() for c in read}
        with np.errstate(all="ignore"):
            for step in steps:
                step(series)
        for c in added:
            rows = rows.append_column(c, pa.array(series[c], pa.float64(), from_pandas=True))
        return rows

    return df.groupBy(key).applyInArrow(run, schema)


def lag(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]])


def known(x: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    return np.where(np.isnan(x), otherwise, x)


def div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; null where b is 0."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _ahead(x: np.ndarray, n: int, by: float) -> np.ndarray:
    return np.concatenate([np.full((*x.shape[:-1], n - 1), by), x], axis=-1)


def count(x: np.ndarray, n: int) -> np.ndarray:
    """Of the non-null values of the last n rows."""
    so_far = np.cumsum(_ahead(~np.isnan(x), n + 1, False), axis=-1)
    return (so_far[..., n:] - so_far[..., :-n]).astype(float)


def total(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the non-null values of the last n rows, 0 without any."""
    values, out = _ahead(known(x), n, 0.0), np.zeros(x.shape)
    for k in range(n):
        out += values[..., k : k + x.shape[-1]]
    return out


def mean(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    m = count(x, n)
    return np.where(m >= (n if least is None else least), total(x, n) / np.maximum(m, 1), np.nan)


def moments(x: np.ndarray, n: int, third: bool = False) -> tuple[np.ndarray, ...]:
    """Number and mean of the non-null values of the last n rows, and the sums of their squares and cubes about it."""
    values, weights, size = _ahead(known(x), n, 0.0), _ahead((~np.isnan(x)).astype(float), n, 0.0), x.shape[-1]
    m, middle, square, cube = (np.zeros(x.shape) for _ in range(4))
    for k in range(n):
        v = weights[..., k : k + size]
        m += v
        d = (values[..., k : k + size] - middle) * v
        part = d / np.maximum(m, 1.0)
        middle += part
        square += d * (d - part)
        if third:
            cube += d * (d * d - part * part) - 3.0 * part * square
    return (m, middle, square, cube) if third else (m, middle, square)


def products(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the pairs of non-null values of the last n rows, and the sum of their products about their means."""
    there, size = ~(np.isnan(x) | np.isnan(y)), x.shape[-1]
    a, b, weights = _ahead(np.where(there, x, 0.0), n, 0.0), _ahead(np.where(there, y, 0.0), n, 0.0), _ahead(there.astype(float), n, 0.0)
    m, left, right, out = (np.zeros(x.shape) for _ in range(4))
    for k in range(n):
        v = weights[..., k : k + size]
        m += v
        d = (a[..., k : k + size] - left) * v
        left += d / np.maximum(m, 1.0)
        right += (b[..., k : k + size] - right) * v / np.maximum(m, 1.0)
        out += d * (b[..., k : k + size] - right)
    return m, out


def carried(x: np.ndarray) -> np.ndarray:
    """The last value that is not null; 0 before the first."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at < 0, 0.0, x[np.maximum(at, 0)])


def largest(x: np.ndarray, n: int) -> np.ndarray:
    """The largest non-null value of the last n rows: of stretches that double in length."""
    out, length = x, 1
    while length < n:
        by = min(length, n - length)
        out, length = np.fmax(out, lag(out, by)), length + by
    return out


def corrected_skew(x: np.ndarray, n: int) -> np.ndarray:
    """Bias-corrected skewness; null below n values or without spread."""
    m, _, square, cube = moments(x, n, True)
    return np.where((m >= n) & (m > 2) & (square > 0), np.sqrt(m) * cube / np.sqrt(square * square * square) * np.sqrt(m * (m - 1)) / (m - 2), np.nan)


def std(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """The sample deviation."""
    m, _, square = moments(x, n)
    return np.where((m >= (n if least is None else least)) & (m > 1), np.sqrt(square / np.maximum(m - 1, 1)), np.nan)


def zscore(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """(x - rolling mean) / rolling sample deviation; null where the deviation is 0."""
    return div(x - mean(x, n, least), std(x, n, least))


def quantile(x: np.ndarray, q: float, n: int, least: int) -> np.ndarray:
    """Between the two values next to it, of the non-null values of the last n rows."""
    values, out = _ahead(x, n, np.nan), np.full(len(x), np.nan)
    for at in range(0, len(x), _BLOCK):
        frames = np.sort(np.lib.stride_tricks.sliding_window_view(values[at : at + _BLOCK + n - 1], n), axis=1)
        m = n - np.isnan(frames).sum(1)
        place = q * np.maximum(m - 1, 0)
        low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
        below, above = (np.take_along_axis(frames, p[:, None], 1)[:, 0] for p in (low, high))
        out[at : at + _BLOCK] = np.where(m >= max(least, 1), np.where(low == high, below, (high - place) * below + (place - low) * above), np.nan)
    return out


def ema(x: np.ndarray, span: float) -> np.ndarray:
    """The recursive average of ``frames.ema``: a null leaves it as it was."""
    alpha = 2.0 / (span + 1)
    out, y = [], np.nan
    for v in x.tolist():
        if v == v:
            y = v if y != y else y * (1 - alpha) + v * alpha
        out.append(y)
    return np.array(out, float)
