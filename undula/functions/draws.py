"""Seeded draws: on the driver by a generator of its own, in a plan by a hash of the case."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def generator(seed: int | None) -> np.random.RandomState:
    """A generator that no other draw shares; None seeds it from the system."""
    return np.random.RandomState(seed)


def log_weights(n_choice: int) -> np.ndarray:
    """Cumulative shares of choices 0..n-1, choice i weighing 2 ** -ln(i + 1)."""
    w = 2.0 ** -np.log(np.arange(1, n_choice + 1))
    return np.cumsum(w / w.sum())


def choice_log(n_choice: int, n_sample: int, rng: np.random.RandomState) -> np.ndarray:
    """``n_sample`` choices with replacement that favour small numbers; zeros if there is one choice at most."""
    if n_choice <= 1:
        return np.zeros(n_sample, np.int64)
    return np.minimum(np.searchsorted(log_weights(n_choice), rng.random_sample(n_sample), "right"), n_choice - 1)


def choice_log_column(n_choice: int, *keys: Column | str, seed: int = 0) -> Column:
    """The same distribution in a plan: a row's draw depends on its keys and the seed only."""
    if n_choice <= 1:
        return F.lit(0)
    u = share_of_case(F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)), seed)
    edges = [float(v) for v in log_weights(n_choice)[:-1]]
    return F.size(F.filter(F.lit(edges), lambda e: e <= u))


def share_of_case(key: Column | str, seed: int = 0) -> Column:
    """A number from 0 to below 1 that depends on a case's id and a seed only: 52 bits of an MD5."""
    text = F.concat_ws("|", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def share_of(i: int, n_choice: int) -> float:
    """Probability of choice ``i``."""
    return 2.0 ** -math.log(i + 1) / sum(2.0 ** -math.log(k) for k in range(1, n_choice + 1))
