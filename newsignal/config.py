"""Small configuration tables. Their sizes are fixed by the literals in ``fixed_values``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal import fixed_values as fv


def commodity_table(spark: SparkSession) -> DataFrame:
    """One row per known commodity name; the length is that of a literal list, so it is broadcast."""
    rows = [F.struct(*[F.lit(value).alias(name) for name, value in zip(fv.COMMODITY_FIELDS, row)])
            for row in fv.COMMODITIES]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def with_commodity_config(df: DataFrame, *fields: str) -> DataFrame:
    """Attach configuration columns by commodity name; an unknown commodity gets NULLs."""
    wanted = fields or tuple(fv.COMMODITY_FIELDS[1:])
    table = commodity_table(df.sparkSession).select("commodity", *wanted)
    return df.join(table, "commodity", "left")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value of a literal map for ``key``, or the default."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(mapping.items())])
    value = F.element_at(table, key)
    return value if default is None else F.coalesce(value, F.lit(default))
