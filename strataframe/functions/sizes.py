"""Small helpers: sizes as text, clamping, grouping, a bounded dictionary."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ["B", "kB", "MB", "GB", "TB", "PB"]


def format_bytes(n: float) -> str:
    """``1234567`` as ``1.23 MB``; powers of ten."""
    for unit in _UNITS[:-1]:
        if abs(n) < 1000:
            return f"{n:.2f} {unit}"
        n /= 1000
    return f"{n:.2f} {_UNITS[-1]}"


def parse_bytes(text: str) -> int:
    """Bytes of ``"5 kB"``, ``"1.5MiB"`` or ``"100"``: decimal units, and binary ones with an i."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:e[0-9]+)?)?\s*([kmgtp]?i?b?)\s*", text.lower())
    if not m:
        raise ValueError(f"{text!r} is no size")
    unit = m[2].rstrip("b")
    base = 1024 if unit.endswith("i") else 1000
    return int(float(m[1] or 1) * base ** ("kmgtp".index(unit[0]) + 1 if unit else 0))


def bound(low, high, value):
    """The value clamped to low..high; columns and numbers alike."""
    if isinstance(value, Column):
        return F.greatest(F.lit(low), F.least(F.lit(high), value))
    return max(low, min(high, value))


def unique_everseen(items: Iterable, key: Callable | None = None) -> Iterator:
    """Items whose key was not seen before, in order."""
    seen = set()
    for x in items:
        k = key(x) if key else x
        if k not in seen:
            seen.add(k)
            yield x


def grouper(items: Iterable, n: int) -> Iterator[tuple]:
    """Tuples of n items, the last maybe shorter."""
    return itertools.batched(items, n)


def pairwise(items: Iterable) -> Iterator[tuple]:
    return itertools.pairwise(items)


def next_prime(n: int) -> int:
    """The least prime at or above n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


class BoundedDict(dict):
    """A dictionary of at most ``maxsize`` items; one more puts out the one that has been in longest, read or not."""

    def __init__(self, *args, maxsize: int = 1000, **kwargs):
        super().__init__()
        self.maxsize = maxsize
        self.update(*args, **kwargs)

    def __setitem__(self, key, value) -> None:
        if key not in self and len(self) >= self.maxsize:
            del self[next(iter(self))]
        super().__setitem__(key, value)

    def setdefault(self, key, default=None):
        if key not in self:
            self[key] = default
        return self[key]

    def update(self, *args, **kwargs) -> None:
        for k, v in dict(*args, **kwargs).items():
            self[k] = v
