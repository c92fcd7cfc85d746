"""Transforms and jobs by name, in place of loadable plug-ins: a transform maps a DataFrame, a job makes several."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

_TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
_JOBS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def transform(name: str):
    """Registers f(df, **options) -> df."""
    return lambda f: _TRANSFORMS.setdefault(name, f)


def job(name: str):
    """Registers f(spark, **options) -> {name: df}."""
    return lambda f: _JOBS.setdefault(name, f)


def load() -> None:
    """Registers what installed packages offer under the entry points strandlake.transforms and strandlake.jobs."""
    for group, into in (("strandlake.transforms", _TRANSFORMS), ("strandlake.jobs", _JOBS)):
        for e in entry_points(group=group):
            into.setdefault(e.name, e.load())


def names() -> dict[str, list[str]]:
    return {"transforms": sorted(_TRANSFORMS), "jobs": sorted(_JOBS)}


def apply(df: DataFrame, name: str, **options) -> DataFrame:
    return _TRANSFORMS[name](df, **options)


def run(spark: SparkSession, name: str, **options) -> dict[str, DataFrame]:
    return _JOBS[name](spark, **options)


def write_parts(df: DataFrame, path: str, *by: str, fmt: str = "parquet") -> None:
    """One folder for each value of `by` (sample, region, chunk): one pass, whatever their number."""
    df.write.partitionBy(*by).format(fmt).save(path)


def register_function(spark: SparkSession, name: str, f: Callable, returns: str = "double") -> None:
    """A Python function for expressions, over Arrow batches (pandas in, pandas out)."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(f, returns))
