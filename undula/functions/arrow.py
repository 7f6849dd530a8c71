"""Kernels that built-in functions can't express well, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _matrices(column: pd.Series):
    """(row, channels x length) of each case."""
    for i, case in enumerate(column):
        yield i, np.array([np.asarray(c, float) for c in case])


def per_case(x: Column, function, kind: str = "array<array<double>>") -> Column:
    """``function(channels x length) -> nested list or array`` of each case."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        out = [function(m) for _, m in _matrices(column)]
        return pd.Series([o if isinstance(o, list) else list(o) for o in out], dtype=object)

    return run(x)


def per_batch(x: Column, function, kind: str = "array<double>", rows: int = 256) -> Column:
    """``function(cases x channels x length) -> cases x anything`` of runs of cases whose shapes agree."""

    def run(column: pd.Series) -> pd.Series:
        out, held, shape = [], [], None

        def flush() -> None:
            if held:
                out.extend(function(np.stack(held)))
                held.clear()

        for _, m in _matrices(column):
            if m.shape != shape or len(held) == rows:
                flush()
                shape = m.shape
            held.append(m)
        flush()
        return pd.Series([list(o) if np.ndim(o) == 2 else o for o in out], dtype=object)

    return F.pandas_udf(run, kind)(x)


def next_power(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def magnitudes(m: np.ndarray, pad: bool = True, mode: str = "constant", value: float = 0.0) -> np.ndarray:
    """Unscaled magnitudes of the first half of the Fourier transform along the last axis."""
    if pad and (extra := next_power(m.shape[-1]) - m.shape[-1]):
        more = {"constant_values": value} if mode == "constant" else {}
        m = np.pad(m, ((0, 0),) * (m.ndim - 1) + ((0, extra),), mode=mode, **more)
    return np.abs(np.fft.fft(m)[..., : m.shape[-1] // 2])


def burg(a: np.ndarray, order: int, demean: bool = False) -> np.ndarray:
    """Autoregressive coefficients along the last axis by Burg's recursion (forward and backward errors minimised together)."""
    a = a - a.mean(-1, keepdims=True) if demean else a
    forward, backward, coef = a[..., 1:], a[..., :-1], np.zeros((*a.shape[:-1], 0))
    for _ in range(order):
        size = ((forward**2).sum(-1) + (backward**2).sum(-1))[..., None]
        k = np.divide(2 * (forward * backward).sum(-1)[..., None], size, out=np.full(size.shape, np.nan), where=size > 0)
        coef = np.concatenate([coef - k * coef[..., ::-1], k], -1)
        forward, backward = (forward - k * backward)[..., 1:], (backward - k * forward)[..., :-1]
    return coef
