"""Curves over a whole table in the order of day and id, from associative summaries.

A window over all rows would need one task, and balanced ranges would need a sample and a written copy. Here the
cut is fixed by the keys alone: rows lie in cells of a day and the upper bits of the id, cells in blocks, blocks in
days. A cell has at most 2**18 ids, a block 2**23 cells and a day 2**23 blocks, so a day that holds a third of
all rows is spread like any other. Every cell is summarised once; summaries are combined upwards to the days, of
which there are as many as the calendar has, and what precedes a day, block or cell is handed down again.

Days are dates and ids whole numbers. Rows without a day come first, and those without an id first in their day.
Rows of one day and id share a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS, BLOCK_BITS = 18, 41
KEYS = ("_day", "_block", "_cell")


@dataclass(frozen=True)
class Summary:
    """How summaries of neighbours combine.

    ``before``: stages of columns saying what precedes a child inside its parent, given the window of the parent;
    ``whole``: aggregates of the children that summarise the parent, given the name of the child key;
    ``handed``: what precedes a child in the whole order, from its own columns and those of its parent (``given_``).
    """

    before: Callable[..., list[dict[str, Column]]]
    whole: Callable[[str], list[Column]]
    handed: dict[str, Column]


def in_cells(rows: DataFrame, day: str, row_id: str) -> DataFrame:
    number = F.col(row_id).cast("bigint")
    return rows.withColumns({
        "_day": F.coalesce(F.unix_date(F.col(day).cast("date")), F.lit(-2**31)),
        "_block": F.coalesce(F.shiftright(number, BLOCK_BITS), F.lit(-2**(63 - BLOCK_BITS) - 1)).cast("bigint"),
        "_cell": F.coalesce(F.shiftright(number, CELL_BITS), F.lit(-2**(63 - CELL_BITS) - 1)).cast("bigint")})


def _inside(row_id: str):
    return Window.partitionBy(*KEYS).orderBy(row_id)


def _climb(cells: DataFrame, summary: Summary) -> tuple[list[DataFrame], DataFrame]:
    """The levels cell, block and day with what precedes each child in its parent, and the summary of everything."""
    levels, frame = [], cells
    for depth in (2, 1, 0):
        parent, child = KEYS[:depth], KEYS[depth]
        for stage in summary.before(Window.partitionBy(*parent).orderBy(child)):
            frame = frame.withColumns(stage)
        levels.append(frame)
        frame = frame.groupBy(*parent).agg(*summary.whole(child))
    return levels, frame


def _descend(levels: list[DataFrame], summary: Summary) -> DataFrame:
    """What precedes each cell in the whole order."""
    days, *lower = reversed(levels)
    above = days.select("_day", *[F.col(f"before_{name}").alias(name) for name in summary.handed])
    for depth, level in enumerate(lower, 1):
        given = above.select(*KEYS[:depth], *[F.col(name).alias(f"given_{name}") for name in summary.handed])
        above = level.join(given, list(KEYS[:depth])).select(
            *KEYS[:depth + 1], *[value.alias(name) for name, value in summary.handed.items()])
    return above


# --- equity -------------------------------------------------------------------------------------


def _equity_summary(sums: Mapping[str, Column] = {}) -> Summary:
    """total, highest and lowest equity and deepest fall of a stretch, counted from its start; and further sums."""
    def before(order):
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return [{"before_total": F.coalesce(F.sum("total").over(earlier), F.lit(0.0))},
                {"before_top": F.max(F.col("before_total") + F.col("top")).over(earlier)}]

    def whole(_):
        start = F.col("before_total")
        return [F.sum("total").alias("total"), F.max(start + F.col("top")).alias("top"), F.min(start + F.col("low")).alias("low"),
                F.min(F.least(F.col("fall"), start + F.col("low") - F.col("before_top"))).alias("fall"),
                *[F.sum(name).alias(name) for name in sums]]

    handed = {"total": F.col("given_total") + F.col("before_total"),
              "top": F.greatest(F.col("given_top"), F.col("given_total") + F.col("before_top"))}
    return Summary(before, whole, handed)


def _with_equity(rows: DataFrame, pnl: str, day: str, row_id: str) -> DataFrame:
    """Equity and its peak counted from the start of the row's cell."""
    order = _inside(row_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    celled = in_cells(rows, day, row_id).withColumn("_pnl", F.coalesce(F.col(pnl), F.lit(0.0)))
    return celled.withColumn("_sum", F.sum("_pnl").over(order)).withColumn("_peak", F.max("_sum").over(order))


def _equity_cells(placed: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    return placed.groupBy(*KEYS).agg(
        F.sum("_pnl").alias("total"), F.max("_sum").alias("top"), F.min("_sum").alias("low"),
        F.min(F.col("_sum") - F.col("_peak")).alias("fall"), *[value.alias(name) for name, value in sums.items()])


def equity_curve(rows: DataFrame, pnl: str, day: str = "prediction_date", row_id: str = "id") -> DataFrame:
    """Equity, running peak (starting at the first equity) and drawdown of every row."""
    summary = _equity_summary()
    placed = _with_equity(rows, pnl, day, row_id)
    levels, _ = _climb(_equity_cells(placed, {}), summary)
    found = placed.join(_descend(levels, summary), list(KEYS))
    found = found.withColumns({"equity": F.col("total") + F.col("_sum"), "peak": F.greatest(F.col("top"), F.col("total") + F.col("_peak"))})
    return found.select(*rows.columns, "equity", "peak", (F.col("equity") - F.col("peak")).alias("drawdown"))


def equity_totals(rows: DataFrame, pnl: str, sums: Mapping[str, Column] | None = None, day: str = "prediction_date",
                  row_id: str = "id") -> DataFrame:
    """One row: the deepest ``fall`` from a peak (null without rows) and the given sums or counts, in one pass."""
    sums = sums or {}
    _, everything = _climb(_equity_cells(_with_equity(rows, pnl, day, row_id), sums), _equity_summary(sums))
    return everything.select("fall", *sums)


# --- rolling means ------------------------------------------------------------------------------


def _last(values: Column, most: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - most, F.lit(0)) + 1, F.lit(most))


def _tail_summary(most: int) -> Summary:
    """The last values of a stretch, in order; nulls are kept, as they fill a place of the frame."""
    def before(order):
        earlier = F.collect_list("tail").over(order.rowsBetween(-most, -1))
        return [{"before_tail": _last(F.flatten(earlier), most)}]

    def whole(child):
        return [F.max_by(_last(F.concat("before_tail", "tail"), most), child).alias("tail")]

    return Summary(before, whole, {"tail": _last(F.concat("given_tail", "before_tail"), most)})


def rolling_mean(rows: DataFrame, value: str, out: str, size: int, min_rows: int = 1, day: str = "prediction_date",
                 row_id: str = "id") -> DataFrame:
    """Mean of the values in the last ``size`` rows of the whole order, null with fewer than ``min_rows`` values.

    A cell hands on its last ``size - 1`` values; frames are short, so that is a short array.
    """
    if size < 2:
        raise ValueError("a rolling mean needs at least two rows")
    celled = in_cells(rows, day, row_id)
    item = F.struct(F.col(value).cast("double").alias("v"))
    backwards = Window.partitionBy(*KEYS).orderBy(F.col(row_id).desc())
    ends = celled.select(*KEYS, row_id, item.alias("_item"), F.row_number().over(backwards).alias("_back")).filter(F.col("_back") < size)
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), "_item")))
    cells = ends.groupBy(*KEYS).agg(F.transform(pairs, lambda pair: pair["_item"]).alias("tail"))
    summary = _tail_summary(size - 1)
    levels, _ = _climb(cells, summary)
    frame = _inside(row_id).rowsBetween(-(size - 1), Window.currentRow)
    placed = celled.withColumns({"_n": F.count(value).over(frame), "_s": F.sum(F.col(value).cast("double")).over(frame),
                                 "_at": F.row_number().over(_inside(row_id))}).join(_descend(levels, summary), list(KEYS))
    missing = F.greatest(F.lit(size) - F.col("_at"), F.lit(0))
    borrowed = F.slice("tail", F.greatest(F.size("tail") - missing, F.lit(0)) + 1, missing)
    borrowed = F.filter(borrowed, lambda x: x["v"].isNotNull())
    n = F.col("_n") + F.size(borrowed)
    total = F.coalesce("_s", F.lit(0.0)) + F.aggregate(borrowed, F.lit(0.0), lambda acc, x: acc + x["v"])
    return placed.select(*rows.columns, F.when((n >= min_rows) & (n > 0), total / n).alias(out))


# --- percentile ---------------------------------------------------------------------------------

COARSE, FINE = 4096, 2**20


def _cell_of(number: Column) -> Column:
    """A whole number that never falls as the value grows; infinities and NaN lie at the ends."""
    steps = F.signum(number) * F.log1p(F.abs(number)) * COARSE
    return F.when(F.isnan(number), F.lit(10**9)).otherwise(F.floor(F.greatest(F.least(steps, F.lit(1e9)), F.lit(-1e9)))).cast("bigint")


def _part_of(number: Column, low: Column, high: Column) -> Column:
    wide = F.coalesce((high > low) & (high - low < F.lit(float("inf"))), F.lit(False))
    return F.when(wide, F.floor((number - low) / (high - low) * FINE)).otherwise(0).cast("bigint")


def exact_percentile(df: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row (n, percentile) with linear interpolation between the two neighbouring values; null values do not count.

    Equal values are counted together. Their counts are summed in cells of equal ratio (at most some six million for
    any doubles), the one or two cells that hold the wanted ranks are cut into 2**20 equal parts, and only the values
    of the parts that hold them are ranked: about 2**20 doubles fit in a part.
    """
    counts = df.select(F.col(value).cast("double").alias("_value")).groupBy("_value").agg(F.count("_value").alias("_n"))
    counts = counts.filter("_n > 0").withColumn("_cell", _cell_of(F.col("_value")))

    def upto(*keys: str, by: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def holds(rank: str) -> Column:
        return (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_from") + F.col("_n"))

    cells = counts.groupBy("_cell").agg(F.sum("_n").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    position = (F.col("n") - 1) * F.lit(float(quantile))
    cells = cells.withColumns({"_from": upto(by="_cell") - F.col("_n"), "n": F.sum("_n").over(Window.partitionBy())}).withColumns({
        "_position": position, "_low": F.floor(position), "_high": F.least(F.floor(position) + 1, F.col("n") - 1)})
    ranks = ["n", "_position", "_low", "_high"]
    hit = cells.filter(holds("_low") | holds("_high")).select("_cell", F.col("_from").alias("_cell_from"), "_lo", "_hi", *ranks)
    inner = counts.join(F.broadcast(hit), "_cell").withColumn("_part", _part_of(F.col("_value"), F.col("_lo"), F.col("_hi")))
    parts = inner.groupBy("_cell", "_part", "_cell_from", *ranks).agg(F.sum("_n").alias("_n"))
    parts = parts.withColumn("_from", F.col("_cell_from") + upto("_cell", by="_part") - F.col("_n"))
    hit_parts = parts.filter(holds("_low") | holds("_high")).select("_cell", "_part", F.col("_from").alias("_part_from"))
    values = inner.join(F.broadcast(hit_parts), ["_cell", "_part"]).withColumn(
        "_from", F.col("_part_from") + upto("_cell", "_part", by="_value") - F.col("_n"))
    low, high = (F.max(F.when(holds(rank), F.col("_value"))) for rank in ("_low", "_high"))
    return values.agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"),
                      (low + (high - low) * (F.max("_position") - F.max("_low"))).alias("percentile"))
