"""Least squares per key by merged triangular factors.

Each task turns its rows of a key into one small triangular factor of (1, predictors, response), and factors of
the same key are stacked and made triangular again. No products of predictors are ever formed, so digits
that moments lose are kept, and the plan is the same for one predictor and for fifty: a factor travels
as one array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A term is aliased when what earlier terms leave of it is this small against its length.
TOLERANCE = 1e-11
#: Keys whose factors one task holds before it hands them on.
HELD_KEYS = 20_000

_FIT = (
    "n long, terms int, df long, intercept double, coefficients array<double>, errors array<double>,"
    " sse double, sst double, r2 double, adj_r2 double, mse double"
)


def triangular(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a stack of rows, filled up to a square with zeros."""
    size = rows.shape[1]
    if len(rows) < size:
        rows = np.vstack([rows, np.zeros((size - len(rows), size))])
    return np.linalg.qr(rows, mode="r")


def solve_factor(r: np.ndarray, n: int, tolerance: float = TOLERANCE) -> tuple:
    """A fit from the factor of (1, predictors, response): ``_FIT`` without keys.

    Aliased terms are dropped from left to right and have NULL coefficients.
    """
    k = r.shape[1] - 2
    kept, j = list(range(k + 1)), 0
    while j < len(kept):
        if abs(r[j, j]) <= tolerance * np.linalg.norm(r[: j + 1, j]):
            r = triangular(np.delete(r, j, axis=1))
            del kept[j]
        else:
            j += 1
    terms = len(kept)
    upper, effects = r[:terms, :terms], r[:, -1]
    solution = np.linalg.solve(upper, effects[:terms])
    sse, sst = float((effects[terms:] ** 2).sum()), float((effects[1:] ** 2).sum())
    df = n - terms
    inverse = np.linalg.solve(upper, np.eye(terms))
    errors = np.sqrt((inverse**2).sum(axis=1) * sse / df) if df > 0 else [None] * terms
    at = dict(zip(kept, zip(solution, errors, strict=True), strict=True))
    slopes = [None if i not in at else float(at[i][0]) for i in range(1, k + 1)]
    spread = [None if i not in at or at[i][1] is None else float(at[i][1]) for i in range(1, k + 1)]
    r2 = 1 - sse / sst if sst > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    return n, terms, df, float(at[0][0]), slopes, spread, sse, sst, r2, adjusted, sse / n


def _packed(r: np.ndarray) -> list[float]:
    return r[np.triu_indices(len(r))].tolist()


def _unpacked(values: np.ndarray, size: int) -> np.ndarray:
    r = np.zeros((size, size))
    r[np.triu_indices(size)] = values
    return r


def qr_fits(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], tolerance: float = TOLERANCE
) -> DataFrame:
    """One fit of ``y ~ xs`` with an intercept for every key; coefficients as arrays in the order of ``xs``.

    Rows with a null or NaN in ``y`` or ``xs`` are left out; a key without any other row is not listed. A key
    with any share of the rows costs one factor a task in the single shuffle, and factors are merged
    one by one, so memory does not depend on rows or tasks.
    """
    names, size = list(keys), len(xs) + 2
    numbers = [F.col(c).cast("double") for c in (*xs, y)]
    rows = df.select(*names, F.array(*numbers).alias("__v")).where(
        ~F.exists("__v", lambda v: v.isNull() | F.isnan(v))
    )
    fields = [rows.schema[c] for c in names]
    factor = T.StructType([*fields, T.StructField("__n", T.LongType()), T.StructField("__r", T.ArrayType(T.DoubleType()))])
    fitted = T.StructType([*fields, *T.StructType.fromDDL(_FIT).fields])

    def key_of(values: tuple) -> tuple:
        return tuple(None if v is None or v != v else v for v in values)

    def frame(found: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([row[i] for row in found], dtype=object) for i, c in enumerate(columns)})

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        handed = lambda: frame([(*k, n, _packed(r)) for k, (n, r) in held.items()], factor.names)
        for batch in batches:
            if batch.empty:
                continue
            values = np.vstack(batch["__v"].to_numpy())
            values = np.hstack([np.ones((len(values), 1)), values])
            groups = batch.groupby(names, dropna=False, sort=False).indices if names else {(): np.arange(len(batch))}
            for key, at in groups.items():
                key = key_of(key if isinstance(key, tuple) else (key,))
                n, r = held.get(key, (0, np.empty((0, size))))
                held[key] = n + len(at), triangular(np.vstack([r, values[at]]))
            if len(held) > HELD_KEYS:
                yield handed()
                held.clear()
        yield handed()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n, r = None, 0, None
        for batch in batches:
            done = []
            for *key, more, values in batch.itertuples(index=False):
                key, other = key_of(tuple(key)), _unpacked(np.asarray(values), size)
                if key == current:
                    n, r = n + more, triangular(np.vstack([r, other]))
                    continue
                if r is not None:
                    done.append((*current, *solve_factor(r, n, tolerance)))
                current, n, r = key, more, other
            yield frame(done, fitted.names)
        if r is not None:
            yield frame([(*current, *solve_factor(r, n, tolerance))], fitted.names)

    factors = rows.mapInPandas(reduce_rows, factor)
    together = factors.repartition(*names).sortWithinPartitions(*names) if names else factors.coalesce(1)
    return together.mapInPandas(merge, fitted)
