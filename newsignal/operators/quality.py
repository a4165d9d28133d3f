"""Data-quality checks over the predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal import fixed_values as fv


def shared_prices(predictions: DataFrame, left: str = "%Brent%", right: str = "%Dubai%",
                  tolerance: float = fv.SAME_PRICE_TOLERANCE) -> DataFrame:
    """Rows of one commodity whose entry price equals that of another one on the same day.

    The tolerance becomes an equality key: prices fall into cells of its width and a row looks into
    its own and the two neighbouring cells. The right side is counted per day and price first, so a
    crowded day costs one row per distinct price and pairs are never listed; ``n_matches`` is their
    number.
    """
    cell = F.floor(F.col("entry_price") / tolerance)
    priced = predictions.filter(F.col("entry_price").isNotNull())
    other = (priced.filter(F.col("commodity").like(right))
             .groupBy("prediction_date", F.col("entry_price").alias("_price"))
             .agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_cell", F.floor(F.col("_price") / tolerance)))
    own = priced.filter(F.col("commodity").like(left))
    probes = own.select("id", "prediction_date", "entry_price",
                        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    hits = (probes.join(other, ["prediction_date", "_cell"])
            .filter(F.abs(F.col("entry_price") - F.col("_price")) < tolerance)
            .groupBy("id").agg(F.sum("_n").alias("n_matches")))
    return own.join(hits, "id").select("id", "commodity", "prediction_date", "entry_price", "n_matches")


# --- checks ---------------------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def price_source_breakdown(predictions: DataFrame) -> DataFrame:
    return predictions.filter("entry_price is not null").groupBy(
        F.coalesce("entry_price_source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"))


def _same_price() -> Column:
    return F.abs(F.col("exit_price") - F.col("entry_price")) < fv.SAME_PRICE_TOLERANCE


def same_price_rows(predictions: DataFrame) -> DataFrame:
    return predictions.filter(_same_price()).select(
        "id", "commodity", "prediction_date", "entry_price", "exit_price")


def _band() -> Column:
    return F.when(F.col("confidence") >= 0.7, "high (>=0.7)").when(F.col("confidence") >= 0.5, "medium (0.5-0.7)").otherwise("low (<0.5)")


def win_rate_by_band(predictions: DataFrame) -> DataFrame:
    return predictions.filter("outcome is not null and confidence is not null").groupBy(
        _band().alias("band")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "correct").alias("wins"),
        F.round(F.count_if(F.col("outcome") == "correct") / F.count(F.lit(1)) * 100, 1).alias("win_rate_pct"))


def _sign_conflict() -> Column:
    return (((F.col("outcome") == "correct") & (F.col("pnl_usd") < 0))
            | ((F.col("outcome") == "incorrect") & (F.col("pnl_usd") > 0)))


def sign_conflicts(predictions: DataFrame) -> DataFrame:
    return predictions.filter(_sign_conflict()).select("id", "commodity", "prediction_date", "outcome", "pnl_usd")


def check_sums(predictions: DataFrame) -> DataFrame:
    """One row with what the checks need, from one pass: rows are counted by confidence, by direction, by band and in
    all (grouping sets, combined in the tasks), and the few hundred counts are folded into one row."""
    source = F.coalesce("entry_price_source", F.lit("unknown"))
    priced = F.col("entry_price").isNotNull()
    rows = predictions.select(
        F.round("confidence", 2).alias("conf"), "direction",
        F.when(F.col("outcome").isNotNull() & F.col("confidence").isNotNull(), _band()).alias("band"),
        F.coalesce(F.col("outcome") == "correct", F.lit(False)).alias("win"), priced.alias("priced"),
        *[(priced & (source == value)).alias(name) for name, value in (("unknown", "unknown"), ("tier1", fv.TIER1), ("tier2", fv.TIER2))],
        F.coalesce(_same_price(), F.lit(False)).alias("same"), F.coalesce(_sign_conflict(), F.lit(False)).alias("conflict"))
    flags = ["win", "priced", "unknown", "tier1", "tier2", "same", "conflict"]
    by = [F.col(c) for c in ("conf", "direction", "band")]
    counts = rows.groupingSets([[by[0]], [by[1]], [by[2]], []], *by).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in flags])
    conf, direction, band = (F.when((F.col("g") == g) & F.col(c).isNotNull(), F.col("n")) for g, c in ((3, "conf"), (5, "direction"), (6, "band")))
    line = F.struct("band", F.round(F.col("win") / F.col("n") * 100, 1).alias("win_rate_pct"), F.col("win").alias("wins"), F.col("n").alias("total"))
    return counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("g") == 7, F.col(c))), F.lit(0)).alias(c) for c in flags],
        F.sum(conf).alias("conf_total"), F.max(conf).alias("conf_n"),
        F.max_by("conf", F.when(conf.isNotNull(), F.struct(F.col("n"), -F.col("conf")))).alias("conf_top"),
        F.sum(direction).alias("direction_total"), F.max(direction).alias("direction_n"),
        F.min_by("direction", F.when(direction.isNotNull(), F.struct(-F.col("n"), F.col("direction")))).alias("direction_top"),
        F.array_sort(F.collect_list(F.when(band.isNotNull(), line))).alias("lines"))


def _by_count(n: Column) -> Column:
    return F.when(n == 0, "PASS").when(n < 5, "WARN").otherwise("FAIL")


def _check(check_id: int, name: str, status, detail: Column, affected: Column) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(name).alias("name"),
                    (status if isinstance(status, Column) else F.lit(status)).alias("status"), detail.alias("detail"),
                    affected.cast("bigint").alias("affected_rows"))


def _price_source_audit() -> Column:
    part = F.col("unknown") / F.greatest("priced", F.lit(1))
    status = F.when(F.col("unknown") == 0, "PASS").when(part < 0.8, "WARN").otherwise("FAIL")
    detail = _text(f"{fv.TIER1}=", F.col("tier1"), f", {fv.TIER2}=", F.col("tier2"), ", unknown=",
                   F.col("unknown"), " (total with price=", F.col("priced"), ")")
    return _check(1, "Price Source Audit", status, detail, F.col("unknown"))


def _confidence_clustering() -> Column:
    """Share of the most frequent confidence, rounded to two digits; the smaller value on a tie."""
    pct = F.coalesce(F.try_divide("conf_n", "conf_total") * 100, F.lit(0.0))
    status = F.when(pct < 60, "PASS").when(pct < 80, "WARN").otherwise("FAIL")
    detail = F.when(F.col("conf_total").isNull(), "No predictions found").otherwise(_text(
        "Top confidence value ", F.col("conf_top"), " appears in ", F.col("conf_n"), "/", F.col("conf_total"),
        " rows (", F.round(pct, 0).cast("int"), "%)"))
    return _check(4, "Confidence Clustering", status, detail, F.when(pct >= 60, F.col("conf_n")).otherwise(0))


def _direction_bias() -> Column:
    pct = F.coalesce(F.try_divide("direction_n", "direction_total") * 100, F.lit(0.0))
    status = F.when(pct < 70, "PASS").when(pct < 85, "WARN").otherwise("FAIL")
    detail = F.when(F.col("direction_total").isNull(), "No predictions found").otherwise(_text(
        "'", F.col("direction_top"), "' is ", F.round(pct, 0).cast("int"), "% of all predictions"))
    return _check(5, "Direction Bias", status, detail, F.lit(0))


def _win_rates() -> Column:
    """Always PASS; the detail lists the bands (three at most) in name order."""
    detail = F.array_join(F.transform("lines", lambda b: _text(
        b["band"], ": ", F.round(b["win_rate_pct"], 0).cast("int"), "% win rate (", b["wins"], "/",
        b["total"], ")")), " | ")
    return _check(6, "Win Rate by Confidence", "PASS", F.when(F.size("lines") == 0, "No resolved predictions").otherwise(detail), F.lit(0))


def run_all_checks(predictions: DataFrame) -> DataFrame:
    """(check_id, name, status, detail, affected_rows) of the seven checks: one pass for six of them and the tolerance
    join for rows that share the price of another commodity."""
    shared = shared_prices(predictions).agg(F.coalesce(F.sum("n_matches"), F.lit(0)).alias("shared"))
    sums = check_sums(predictions).join(F.broadcast(shared))  # one row each
    same, both, conflict = F.col("same"), F.col("shared"), F.col("conflict")
    return sums.select(F.inline(F.array(
        _price_source_audit(),
        _check(2, "Same-Day Price Check", _by_count(same), _text(same, " rows with entry_price == exit_price"), same),
        _check(3, "Shared Price Check", _by_count(both), _text(both, " Brent rows sharing the Dubai entry price"), both),
        _confidence_clustering(), _direction_bias(), _win_rates(),
        _check(7, "P&L Sign Consistency", _by_count(conflict), _text(conflict, " rows where P&L sign contradicts outcome label"), conflict))))


def status_totals(report: DataFrame) -> DataFrame:
    return report.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
                        for s in ("PASS", "WARN", "FAIL")])


def violation_sample(rows: DataFrame, order: str = "id", size: int = 20) -> DataFrame:
    """First rows of a violation list as one array, beside their full number."""
    sample = rows.orderBy(order).limit(size).agg(
        F.array_sort(F.collect_list(F.struct(order, "commodity", "prediction_date"))).alias("sample"))
    return sample.withColumn("n_rows", rows.agg(F.count(F.lit(1))).scalar())
