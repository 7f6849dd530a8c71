"""Channel selection, interval slices and feature masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = int | Sequence[int] | slice


def check_key(key: Key) -> Key:
    """A channel key is an int, a list of ints, or a slice of ints and None without a step."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if whole(key):
        return key
    if isinstance(key, slice):
        if key.step is None and all(v is None or whole(v) for v in (key.start, key.stop)):
            return key
    elif isinstance(key, (list, tuple)) and key and all(map(whole, key)):
        return key
    raise ValueError("channels are given by an int, a list of ints or a slice with int or None bounds")


def channels_of(key: Key, n_channels: int) -> list[int]:
    """Channel numbers that a key picks; negative ones count from the end."""
    check_key(key)
    if isinstance(key, slice):
        return list(range(n_channels))[key]
    picked = [k if k >= 0 else n_channels + k for k in ([key] if isinstance(key, int) else key)]
    if any(not 0 <= k < n_channels for k in picked):
        raise ValueError(f"channel {key} is out of range for {n_channels} channels")
    return picked


def select_channels(x: Column, channels: Sequence[int]) -> Column:
    if list(channels) == list(range(channels[0], channels[0] + len(channels))):
        return F.slice(x, channels[0] + 1, len(channels))
    return F.array(*(F.element_at(x, k + 1) for k in channels))


def interval(c: Column, start: Column | int, end: Column | int, dilation: Column | int = 1) -> Column:
    """Every ``dilation``-th value of [start, end) of one channel."""
    start, end = (F.lit(v) if isinstance(v, int) else v for v in (start, end))
    part = F.slice(c, start + 1, end - start)
    if isinstance(dilation, int) and dilation == 1:
        return part
    return F.filter(part, lambda v, i: i % dilation == 0)


def check_mask(mask: Sequence[bool] | None, n_features: int, raise_error: bool = True) -> bool:
    """Whether a feature mask fits; wrong ones raise, or count as False."""
    fine = mask is None or (len(mask) == n_features and all(isinstance(m, bool) for m in mask))
    if not fine and raise_error:
        raise ValueError(f"the mask must hold {n_features} booleans")
    return fine
