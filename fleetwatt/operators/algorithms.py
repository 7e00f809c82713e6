"""User folds: a named algorithm with arguments, run like the built-in filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from fleetwatt.operators.fold import Fold, run_fold
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline

_REGISTRY: dict[str, Callable[..., Fold]] = {}


def register_algorithm(name: str, factory: Callable[..., Fold]) -> None:
    _REGISTRY[name] = factory


def create_algorithm(spec: str) -> Fold:
    """`name arg arg` -> the fold its factory makes from the arguments."""
    name, *args = spec.split()
    if name not in _REGISTRY:
        raise KeyError(f"unknown algorithm {name!r}, known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](*args)


def run_algorithm(df: DataFrame, spec: str, args: Mapping[str, Column], tl: Timeline = DEVICE_TIME) -> DataFrame:
    return run_fold(df, create_algorithm(spec), args, tl)
