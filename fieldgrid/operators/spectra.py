"""Spectral responses at even steps of wavelength, by quadratic splines through the samples of each band."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Nanometres between the values of a response.
STEP = 2.5


def _basis(knots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of all quadratic B-splines at some places, by the recurrence of degrees."""
    last = np.searchsorted(knots, knots[-1]) - 1  # the last interval holds its right end
    where = np.minimum(np.searchsorted(knots, at, side="right") - 1, last)
    b = (np.arange(len(knots) - 1)[None, :] == where[:, None]).astype(float)
    for degree in (1, 2):
        n = len(knots) - degree - 1
        left, right = knots[degree : degree + n] - knots[:n], knots[degree + 1 : degree + 1 + n] - knots[1 : 1 + n]
        up = np.divide(at[:, None] - knots[:n], left, out=np.zeros((len(at), n)), where=left > 0)
        down = np.divide(knots[degree + 1 : degree + 1 + n] - at[:, None], right, out=np.zeros((len(at), n)), where=right > 0)
        b = up * b[:, :n] + down * b[:, 1 : n + 1]
    return b


def quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The quadratic spline through (x, y), with knots between the samples but the first and last gap, at some places."""
    if len(x) < 3:
        return np.interp(at, x, y)
    middle = (x[1:] + x[:-1]) / 2
    knots = np.concatenate([[x[0]] * 3, middle[1:-1], [x[-1]] * 3])
    return _basis(knots, at) @ np.linalg.solve(_basis(knots, x), y)


def at_even_steps(samples: DataFrame, by: str, low: float, high: float, step: float = STEP) -> DataFrame:
    """(by, wavelength, response) from ``low`` on, the last at ``high`` or within a step beyond; outside of a band's samples null.

    ``samples``: (by, wavelength, response), a band's some hundred rows; a repeated wavelength counts with its mean.
    """
    kind = dict(samples.dtypes)[by]
    at = low + step * np.arange(int(np.ceil((high - low) / step)) + 1)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.dropna().groupby("wavelength")["response"].mean()
        x, y = s.index.to_numpy(float), s.to_numpy(float)
        out = np.full(len(at), np.nan)
        if len(x):
            inside = (at >= x[0]) & (at <= x[-1])
            out[inside] = quadratic(x, y, at[inside])
        return pd.DataFrame({by: pdf[by].iloc[0], "wavelength": at, "response": pd.array(out, dtype="Float64")})

    return samples.select(by, "wavelength", "response").groupBy(by).applyInPandas(resample, f"`{by}` {kind}, wavelength double, response double")
