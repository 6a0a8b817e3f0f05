"""Normalisers by name, as pairs of column functions, forward and inverse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Callable[[Column], Column], Callable[[Column], Column]]
_KINDS: dict[str, Callable[..., Pair]] = {}


def register(name: str, make: Callable[..., Pair]) -> None:
    """Add a kind: a function of its parameters that gives the pair."""
    if name in _KINDS:
        raise ValueError(f"a normaliser named {name} is registered")
    _KINDS[name] = make


def normaliser(name: str, **parameters) -> Pair:
    if name not in _KINDS:
        raise ValueError(f"no normaliser is named {name}")
    return _KINDS[name](**parameters)


def on_array(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.transform(a, f)


#: A logarithm of what has none is null.
register("identity", lambda: (lambda x: x, lambda x: x))
register("zscore", lambda mean, stdev: (lambda x: F.try_divide(x - mean, F.lit(float(stdev))), lambda x: x * stdev + mean))
register("log", lambda: (F.ln, F.exp))
register("log1p", lambda: (lambda x: F.when(x > -1, F.log1p(x)), F.expm1))
