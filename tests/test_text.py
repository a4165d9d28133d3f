"""Hand-made rows for the text rules."""

import pytest
from pyspark.sql import functions as F

from newsignal.functions import report_rows, rules, text


def one(spark, value, make):
    row = spark.range(1).select(F.lit(value).cast("string").alias("t"))
    return row.select(make(F.col("t")).alias("r")).first()["r"]


def test_section_is_skipped_until_a_marker(spark):
    raw = "Intro line here\nKey Benchmarks\n12 34\nAny text inside\n\nGlobal supply is tight\nKept line"
    assert one(spark, raw, text.clean_report_text) == "Intro line here\n\nGlobal supply is tight\nKept line"


def test_boilerplate_marker_does_not_close_a_section(spark):
    raw = "Contents\ninside\nAll rights reserved on supply\nstill inside\nOutlook for crude\nend"
    assert one(spark, raw, text.clean_report_text) == "Outlook for crude\nend"


def test_two_sections_and_consecutive_headers(spark):
    raw = "a\nContents\nContents\nx\ndemand rises\nb\nNorth Sea\ny\nexport falls\nc"
    assert one(spark, raw, text.clean_report_text) == "a\ndemand rises\nb\nexport falls\nc"


def test_blank_runs_collapse_and_edges_are_trimmed(spark):
    assert one(spark, "\n\n first \r\n\r\n\r\nsecond\r\n \n", text.clean_report_text) == "first\n\nsecond"
    assert one(spark, None, text.clean_report_text) == ""


def test_markup_is_decoded_once_in_order(spark):
    assert one(spark, "<p>a &amp;lt; b</p>", text.strip_markup) == " a < b "


@pytest.mark.parametrize("line,expected", [
    ("", False), ("12.5 / 13", True), ("Dubai PCAAT00 12.5 3.4", True), ("a" * 301, False),
    ("x" * 140 + "1" * 160, True), ("x" * 141 + "1" * 160, False), ("Prices rose in May", False)])
def test_price_lines(spark, line, expected):
    assert one(spark, line, text.is_price_line) is expected


def test_cleaning_is_stable(spark):
    raw = "Head\nContents\n1 2\nsupply grows\n\n\nMore text follows here"
    once = one(spark, raw, text.clean_report_text)
    assert one(spark, once, text.clean_report_text) == once


def test_narrative_keeps_sentences_only(spark):
    raw = "Too short\nThis sentence has enough words here\n1234567 89 a b c d e"
    assert one(spark, raw, text.extract_narrative) == "This sentence has enough words here"


def test_ngrams_and_accents(spark):
    make = lambda c: text.ngrams(text.tokens(c))
    assert one(spark, "Été à Genève x 42", make) == ["ete", "geneve", "42", "ete geneve", "geneve 42"]
    assert one(spark, "one", make) == ["one"]
    assert one(spark, "", make) == []


def test_row_shapes(spark):
    row = one(spark, "Dubai (May) PCAAT00 102.54-102.58 102.56 -14.450", report_rows.priced_row)
    assert row["symbol"] == "Dubai" and row["price"] == 102.56
    assert row["pct_change_24h"] == pytest.approx(-14.45 / 117.01 * 100)
    assert one(spark, "Dubai (May) PCAAT00 102.54 102.58 102.55 -14.450", report_rows.parse_row) is None
    quotes = one(spark, "Dubai (May) PCAAT00 102.54 102.58 102.55 -14.450", report_rows.quote_rows)
    assert [(q["symbol"], q["price"], q["change_abs"]) for q in quotes] == [("Dubai", 102.55, -14.45)]


@pytest.mark.parametrize("line", ["Dubai swap DBDAA00 11.0 0.5", "Oman spread vs Dubai PCABX00 0.75 0.1"])
def test_excluded_rows(spark, line):
    assert one(spark, line, report_rows.priced_row)["symbol"] is None


def test_zero_prior_price_has_no_change(spark):
    assert one(spark, "Dubai PCAAT00 5.0 5.0", report_rows.priced_row)["pct_change_24h"] is None


def test_relevant_section(spark):
    assert one(spark, "a\nb", report_rows.relevant_lines) == ["a", "b"]
    assert one(spark, "a\nKey benchmarks\nx\nMiddle East\ny\nContents\nz", report_rows.relevant_lines) == ["x", "y"]
    assert one(spark, "a\nKey benchmarks\nContents\nz", report_rows.relevant_lines) == [
        "a", "Key benchmarks", "Contents", "z"]


@pytest.mark.parametrize("name,expected", [
    ("scan_2024-05-06.txt", "2024-05-06"), ("06_05_2024 scan", "2024-05-06"), ("x20240506", "2024-05-06"),
    ("2024-13-45", None), ("plain", None)])
def test_file_dates(spark, name, expected):
    got = one(spark, name, report_rows.file_date)
    assert (got.isoformat() if got else None) == expected


def test_first_rule_wins_and_substrings_match(spark):
    assert one(spark, "OPEC under sanction", rules.event_type) == "opec_decision"
    assert one(spark, "toward the shore", rules.event_type) == "geopolitical"
    assert one(spark, "house prices", rules.region) == "us"
    assert one(spark, None, rules.event_type) == "other"
    assert one(spark, "toward", lambda c: rules.any_keyword(c, ["war"], whole_words=True)) is False


def test_most_keywords_win_and_ties_follow_the_order(spark):
    assert one(spark, "brent and urals in europe, dubai", rules.commodity_group) == "brent"
    assert one(spark, "wti and brent", rules.commodity_group) == "brent"
    assert one(spark, "nothing", rules.commodity_group) == "general"


def test_uuid(spark):
    good = " 0A0B0C0D-1111-2222-3333-444455556666\n"
    assert one(spark, good, rules.is_uuid) is True
    assert one(spark, good.strip() + "0", rules.is_uuid) is False
    assert one(spark, None, rules.is_uuid) is False
