"""Keyed writes as frame-to-frame operators: the tables do not enforce keys, these do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.functions.text import is_blank


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key in the given order.

    ``row_number() = 1`` is limited per task before the shuffle, so a key that holds a large share of
    the rows sends one candidate per task and not its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def insert_absent(existing: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[Column]) -> DataFrame:
    """Rows of the batch to append: the first per key, unless the key is stored already."""
    fresh = one_per_key(batch, keys, order)
    return fresh.join(existing.select(*keys), list(keys), "left_anti")


def insert_status(existing: DataFrame, batch: DataFrame, keys: Sequence[str],
                  row_id: str) -> DataFrame:
    """The batch with a ``status`` per row: inserted for the first new row of a key, else duplicate.

    ``row_id`` is unique in the batch and gives the order of arrival.
    """
    firsts = batch.groupBy(*keys).agg(F.min(row_id).alias("_first"))
    stored = existing.groupBy(*keys).agg(F.lit(True).alias("_stored"))
    return (batch.join(firsts.join(stored, list(keys), "left"), list(keys))
            .withColumn("status", F.when((F.col(row_id) == F.col("_first"))
                                         & F.col("_stored").isNull(), "inserted")
                        .otherwise("duplicate"))
            .drop("_first", "_stored"))


def replace_upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str],
                   order: Sequence[Column]) -> DataFrame:
    """Whole new table content: the batch wins over stored rows, its own last row over earlier ones.

    ``order`` ranks rows inside the batch, latest first.
    """
    both = (existing.withColumn("_new", F.lit(0))
            .unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True))
    return one_per_key(both, keys, [F.col("_new").desc(), *order]).drop("_new")


def merge_nonempty(existing: DataFrame, update: DataFrame, key: str, columns: Sequence[str],
                   decisive: Sequence[str], stamp: str | None = None, now: Column | None = None
                   ) -> DataFrame:
    """Coalescing update: a non-empty new value wins, else the stored one stays.

    A row is touched only if one of the ``decisive`` columns would change; ``changed`` says so.
    Keys that are only in the update are not inserted.
    """
    new = update.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(new, key, "left")

    def merged(name: str) -> Column:
        fresh = F.col(f"_new_{name}")
        if dict(existing.dtypes)[name] == "string":
            fresh = F.when(fresh != "", fresh)
        return F.coalesce(fresh, F.col(name))

    changed = F.lit(False)
    for name in decisive:
        changed = changed | ~merged(name).eqNullSafe(F.col(name))
    joined = joined.withColumn("changed", changed)
    out = []
    for name in existing.columns:
        if name in columns:
            out.append(F.when(F.col("changed"), merged(name)).otherwise(F.col(name)).alias(name))
        elif name == stamp:
            out.append(F.when(F.col("changed"), now).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out, "changed")


def fill_missing(existing: DataFrame, computed: DataFrame, keys: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Fill only the NULLs of the named columns from a computed frame with one row per key."""
    new = computed.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(new, list(keys), "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c)
        for c in existing.columns])


def drop_blank_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(~is_blank(F.col(key)))


def union_distinct_by_id(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources, one row per key; an earlier source wins."""
    tagged = [df.withColumn("_source", F.lit(n)) for n, df in enumerate(sources)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    return one_per_key(both, [key], [F.col("_source")]).drop("_source")
