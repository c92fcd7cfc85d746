"""Registered queries: each plan module adds (name, query, DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.session import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under its name, with its SQL twin if there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 10 AND l_discount > 0.02")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("avg_qty"), F.median("l_quantity").alias("median_qty"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from strandlake.plans import aggregates, block_twins, calling_twins, filters, genotype_twins, haplotype_twins, joins, record_twins, run_twins, segment_twins, site_reports, streams, variant_twins  # noqa: E402,F401  (they register their queries)
