"""Uniform numbers that depend on a key alone.

A draw is the first 52 bits of the MD5 of its key, so any engine, partitioning
or retry gives the same draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) for the key; strings are literal tags, columns are cast to text."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(_SCALE)


def uniform_of(*key: object) -> float:
    """The same number in Python."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / _SCALE


def uniforms(before: str, names: Iterable[object], after: str = "") -> np.ndarray:
    """The numbers of all keys ``before`` + name + ``after``, where these have the bars between the parts of a key."""
    md5 = hashlib.md5
    raw = b"".join([md5(f"{before}{n}{after}".encode()).digest() for n in names])
    return (np.frombuffer(raw, ">u8")[::2] >> np.uint64(12)).astype(float) / _SCALE


def normal(*key: Column | str | int) -> Column:
    """A standard normal draw for the key, by Box and Muller; u is moved off 0."""
    u, v = uniform(*key, "r"), uniform(*key, "a")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
