"""The catalogue that operator modules enter their queries into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *frames: str, sql: str | None = None) -> Callable:
    """Enter a function of the named frames as query ``name``; ``sql`` gives the same rows in DuckDB."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = lambda spark, sf_dir: fn(*(binding.frame(spark, sf_dir, f) for f in frames))
        if sql is not None:
            ORACLES[name] = binding.with_frames(frames, sql)
        return fn

    return add
