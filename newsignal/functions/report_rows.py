"""Price-table rows in report text: section, row grammar and symbols, as column expressions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsignal import fixed_values as fv
from newsignal.functions.rules import any_keyword
from newsignal.functions.text import SPACE, candidate_lines, let, strip

NUMBER = r"[+-]?\d+(?:\.\d+)?"
SIGNED = r"-?\d+(?:\.\d+)?"
LABEL_CODE = r"^(.+?) ([A-Z0-9]{6,8}) "
# label, code, then: range mid change | mid change | range mid | mid; groups 1, 2, mid, change
ROW_SHAPES = [
    (rf"{LABEL_CODE}{NUMBER}\s*-\s*{NUMBER} ({NUMBER}) ({NUMBER})$", True),
    (rf"{LABEL_CODE}({NUMBER}) ({NUMBER})$", True),
    (rf"{LABEL_CODE}{NUMBER}\s*-\s*{NUMBER} ({NUMBER})$", False),
    (rf"{LABEL_CODE}({NUMBER})$", False),
]
QUOTE_SHAPE = rf"{LABEL_CODE}({SIGNED}) ({SIGNED}) ({SIGNED}) ({SIGNED})$"


def parse_number(text: Column) -> Column:
    """Number with optional thousands separators; NULL when it is none."""
    return F.replace(strip(text), F.lit(","), F.lit("")).try_cast("double")


def pct_from_change(price: Column, change: Column) -> Column:
    """Percent change when the absolute change is known; NULL when the prior price is zero."""
    return F.try_divide(change, price - change) * 100


def compact(line: Column) -> Column:
    return strip(F.regexp_replace(line, rf"{SPACE}+", " "))


def row_symbol(label: Column, code: Column, aliases=fv.SYMBOL_ALIASES) -> Column:
    """Symbol of a row, by exact code or by an alias contained in the label; excluded rows are NULL."""

    def named(name: Column) -> Column:
        upper = F.upper(strip(code))
        chain = F.when(upper.startswith(fv.EXCLUDED_CODE_PREFIX)
                       | name.contains(fv.EXCLUDED_ROW_LABEL), F.lit(None).cast("string"))
        for symbol, _ in aliases:
            chain = chain.when(upper == symbol, F.lit(symbol))
        for symbol, words in aliases:
            chain = chain.when(any_keyword(name, words), F.lit(symbol))
        return chain

    return let(compact(F.lower(label)), named)


def exact_symbol(value: Column, aliases=fv.PAYLOAD_ALIASES) -> Column:
    """Symbol whose name or alias equals the value."""

    def named(name: Column) -> Column:
        chain = F
        for symbol, words in aliases:
            chain = chain.when(name.isin(symbol.lower(), *words), F.lit(symbol))
        return chain.otherwise(F.lit(None).cast("string"))

    return let(F.lower(compact(F.coalesce(value, F.lit("")))), named)


def parse_row(line: Column) -> Column:
    """Struct (label, code, mid, change) of a table row by the first row shape that fits, or NULL."""

    def shaped(text: Column) -> Column:
        chain = F
        for pattern, has_change in ROW_SHAPES:
            part = partial(F.regexp_extract, text, pattern)
            chain = chain.when(text.rlike(pattern), F.struct(
                part(1).alias("label"), part(2).alias("code"), part(3).alias("mid"),
                (part(4) if has_change else F.lit(None).cast("string")).alias("change")))
        return chain

    return let(compact(line), shaped)


def priced_row(line: Column) -> Column:
    """Struct (symbol, label, code, price, pct_change_24h) of a table row, or NULL."""

    def priced(row: Column) -> Column:
        price, change = parse_number(row["mid"]), parse_number(row["change"])
        return F.when(row.isNotNull(), F.struct(
            row_symbol(row["label"], row["code"]).alias("symbol"), row["label"].alias("label"),
            row["code"].alias("code"), price.alias("price"),
            pct_from_change(price, change).alias("pct_change_24h")))

    return let(parse_row(line), priced)


def first_per_symbol(rows: Column, symbols: list[str]) -> Column:
    """First row of each symbol in an array of rows, in the order of their appearance."""

    def firsts(numbered: Column) -> Column:
        found = F.array(*[
            F.get(F.filter(numbered, lambda item: item["row"]["symbol"] == symbol), F.lit(0))
            for symbol in symbols])
        return F.transform(F.array_sort(F.filter(found, lambda item: item.isNotNull())),
                           lambda item: item["row"])

    return let(F.transform(rows, lambda row, pos: F.struct(pos.alias("pos"), row.alias("row"))), firsts)


def line_codes(lines: Column) -> Column:
    """One code per line: S start, E end, K skipped header, O other."""
    return F.array_join(F.transform(
        lines,
        lambda line: F.when(any_keyword(F.lower(line), fv.SECTION_START), "S")
        .when(any_keyword(F.lower(line), fv.SECTION_END), "E")
        .when(F.lower(line).isin(fv.SECTION_HEADER_LINES), "K").otherwise("O")), "")


def relevant_lines(text: Column) -> Column:
    """Lines between the first start marker and the next end marker; all lines if there are none.

    A later start line inside the section is skipped, not collected.
    """

    def section(lines: Column) -> Column:
        # the codes of the section: what follows the first S, up to the next E
        def collect(found: Column) -> Column:
            begin, body = found["begin"], found["body"]
            kept = F.filter(
                F.zip_with(F.slice(lines, begin + 1, F.length(body)), F.split(body, ""),
                           lambda line, code: F.when(code == "O", line)),
                lambda line: line.isNotNull())
            return let(kept, lambda k: F.when((begin > 0) & (F.size(k) > 0), k).otherwise(lines))

        return let(
            let(line_codes(lines), lambda codes: F.struct(
                F.instr(codes, "S").alias("begin"),
                F.regexp_extract(codes, "^[^S]*S([^E]*)", 1).alias("body"))),
            collect)

    return let(candidate_lines(text), section)


def report_prices(text: Column) -> Column:
    """Array of price rows of a report text, the first row of every symbol."""
    rows = F.filter(F.transform(relevant_lines(text), priced_row),
                    lambda row: row["symbol"].isNotNull() & row["price"].isNotNull())
    return first_per_symbol(rows, [symbol for symbol, _ in fv.SYMBOL_ALIASES])


def quote_rows(text: Column) -> Column:
    """Array of (symbol, price, change_abs, evidence) from bid/ask/mid/change rows, first per symbol."""

    def quote(line: Column) -> Column:
        def shaped(short: Column) -> Column:
            part = partial(F.regexp_extract, short, QUOTE_SHAPE)
            return F.when(short.rlike(QUOTE_SHAPE), F.struct(
                exact_symbol(part(1)).alias("symbol"), parse_number(part(5)).alias("price"),
                parse_number(part(6)).alias("change_abs"),
                F.substring(line, 1, fv.EVIDENCE_CHARS).alias("evidence")))

        return let(F.regexp_replace(line, rf"{SPACE}+", " "), shaped)

    rows = F.filter(F.transform(candidate_lines(text), quote),
                    lambda row: row["symbol"].isNotNull() & row["price"].isNotNull())
    return first_per_symbol(rows, [symbol for symbol, _ in fv.PAYLOAD_ALIASES])


def report_type(name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return (F.when(any_keyword(lowered, ["marketscan", "arab gulf"]), "marketscan")
            .when(any_keyword(lowered, ["marketwire", "crude oil", "world oil"]), "marketwire")
            .otherwise("generic"))


def file_date(name: Column) -> Column:
    """Report date in a file name: Y-M-D, D-M-Y, then YYYYMMDD; an impossible date is NULL."""
    chain = F
    for pattern, order in zip(fv.FILE_DATE_PATTERNS, [(1, 2, 3), (3, 2, 1), (1, 2, 3)]):
        parts = [F.regexp_extract(name, pattern, group) for group in order]
        chain = chain.when(name.rlike(pattern), F.concat_ws("-", *parts))
    return chain.try_cast("date")
