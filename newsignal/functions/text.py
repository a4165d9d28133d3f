"""Text cleaning as column expressions.

A document stays in its own row from raw text to cleaned text: its lines are an array and every rule
is an array expression, so cleaning a corpus is a map over the scan without any shuffle.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsignal import fixed_values as fv

# white space as Python's str.strip() understands it: ASCII, control separators and Unicode spaces
SPACE = r"[\s\p{Z}\x{85}\x0B\x1C-\x1F]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, which gets it as a lambda variable.

    Array expressions are not covered by common-subexpression elimination, so a value that a body
    needs more than once is bound this way.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# the same characters as a list, for trimming
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}+", ""))


def alpha_share(text: Column) -> Column:
    """Share of letters; 0 for empty text."""
    size = F.length(text)
    return F.when(size > 0, letters(text) / size).otherwise(F.lit(0.0))


def strip_markup(raw: Column) -> Column:
    """Tags become blanks, then the known entities are decoded in their fixed order."""
    text = F.regexp_replace(raw, r"<[^>]+>", " ")
    for entity, plain in fv.HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines_of(text: Column) -> Column:
    """Array of stripped lines."""
    return F.transform(F.split(unify_newlines(text), "\n"), strip)


def is_boilerplate(line: Column) -> Column:
    """Any boilerplate pattern. The patterns that may match inside a line are tried only on lines
    that hold their fixed words, so that most lines are scanned once."""
    anchored = [p for p in fv.BOILERPLATE_PATTERNS if p.startswith("^")]
    floating = [p for p in fv.BOILERPLATE_PATTERNS if not p.startswith("^")]
    lowered = F.lower(line)
    hinted = reduce(lambda a, b: a | b, [lowered.contains(w) for w in fv.BOILERPLATE_HINTS])
    either = lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return (hinted & line.rlike(either(floating))) | line.rlike(either(anchored))


def is_table_header(line: Column) -> Column:
    return line.rlike("(?i)" + fv.TABLE_HEADERS)


def is_narrative_marker(line: Column) -> Column:
    return line.rlike("(?i)" + fv.NARRATIVE_MARKERS)


def is_price_line(line: Column) -> Column:
    """A stripped line that looks like a row of a price table."""
    size = F.length(line)
    tail = rf"{SPACE}[\p{{Nd}}.\-+/–]+$"
    row = (rf"^[\p{{L}}\p{{N}}_{SPACE[1:-1]}()/\-.]*{SPACE}+[A-Za-z0-9]{{4,8}}"
           rf"{SPACE}+[\p{{Nd}}.\-+{SPACE[1:-1]}/–]+$")
    # the cheap test stands first in each pair: a digit at all, a last word of digits and signs
    return (
        (size > 0) & (size <= fv.PRICE_LINE_MAX_CHARS)
        & (~line.rlike("[a-zA-Z]")
           | ((size > 10) & line.rlike(r"\p{Nd}") & (digits(line) / size > fv.PRICE_LINE_DIGIT_SHARE))
           | ((size <= fv.PRICE_PATTERN_MAX_CHARS) & line.rlike(tail) & line.rlike(row)))
    )


def mark_sections(codes: Column) -> Column:
    """Mark the lines of skipped sections in a string of line codes (one character per line).

    ``H`` opens a section and ``M`` closes it. Every match is one character long: an ``H`` anywhere,
    or any non-``M`` directly after the previous match. The pass is linear in the number of lines.
    """
    return F.regexp_replace(codes, r"H|\G(?!^)[^M]", "S")


def section_codes(lines: Column) -> Column:
    """One code per line: H header, M narrative marker, O other; skipped lines turned into S."""
    codes = F.transform(
        lines,
        lambda line: F.when(line == "", "O").when(is_table_header(line), "H")
        .when(is_narrative_marker(line), "M").otherwise("O"))
    return mark_sections(F.array_join(codes, ""))


def kept_lines(raw: Column) -> Column:
    """Lines that survive the boilerplate, section and price-row rules; blank lines stay.

    Section marks are worked out only for documents that have a section header.
    """

    def outside(lines: Column) -> Column:
        return F.filter(
            F.zip_with(lines, F.split(section_codes(lines), ""),
                       lambda line, code: F.when((line == "") | (code != "S"), line)),
            lambda line: line.isNotNull())

    def kept(lines: Column) -> Column:
        open_lines = F.when(F.exists(lines, is_table_header), outside(lines)).otherwise(lines)
        return F.filter(open_lines, lambda line: ~is_price_line(line))

    return let(F.filter(lines_of(strip_markup(raw)), lambda line: ~is_boilerplate(line)), kept)


def clean_report_text(raw: Column) -> Column:
    """Raw report text to cleaned text, whole document."""
    joined = F.array_join(kept_lines(raw), "\n")
    return strip(F.regexp_replace(F.coalesce(joined, F.lit("")), r"\n{3,}", "\n\n"))


def extract_narrative(raw: Column) -> Column:
    """Cleaned lines that read like sentences, joined by one blank."""
    # the lines are stripped, so splitting at white space counts their words
    sentences = F.filter(
        kept_lines(raw),
        lambda line: (line != "") & (F.size(F.split(line, rf"{SPACE}+")) >= fv.NARRATIVE_MIN_WORDS)
        & (alpha_share(line) >= fv.NARRATIVE_ALPHA_SHARE))
    return strip(F.coalesce(F.array_join(sentences, " "), F.lit("")))


def is_narrative_text(text: Column, min_alpha_share: float = fv.NARRATIVE_ALPHA_SHARE) -> Column:
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) >= fv.NARRATIVE_MIN_CHARS) & (alpha_share(body) >= min_alpha_share)


def training_snippet(body: Column, cap: int | None = None, chars: int | None = None) -> Column:
    """The narrative of a body; empty when the body is not narrative.

    ``cap`` and ``chars`` restrict it to the opening of the body and of its narrative (in the published
    training text ``fv.TRAIN_BODY_CAP`` and ``fv.TRAIN_SNIPPET_CHARS``).
    """
    def opening(value: Column, size: int | None) -> Column:
        return F.substring(value, 1, size) if size else value

    return let(
        opening(F.coalesce(body, F.lit("")), cap),
        lambda capped: F.when(is_narrative_text(capped), opening(extract_narrative(capped), chars)).otherwise(""))


def training_text(snippet: Column, headline: Column) -> Column:
    title = strip(F.coalesce(headline, F.lit("")))
    return F.when(snippet != "", strip(F.concat_ws(" ", strip(snippet), title))).otherwise(title)


def normalize_text(text: Column) -> Column:
    """Dashes to '-', runs of blanks to one, blank lines dropped."""
    plain = F.translate(text, "\r–—−", "\n---")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{2,}", "\n")


def candidate_lines(text: Column) -> Column:
    lines = F.transform(F.split(normalize_text(text), "\n"), strip)
    return F.filter(lines, lambda line: line != "")


def _accent_pairs() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode decomposition rule."""
    source, target = [], []
    for code in range(0x00C0, 0x1F00):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char and char.islower():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _accent_pairs()


def fold_accents(lowered: Column) -> Column:
    """Accents off lowercase text: precomposed letters to their base."""
    return F.when(lowered.rlike(r"[^\x00-\x7F]"), F.translate(lowered, _ACCENTED, _BASE)).otherwise(lowered)


def tokens(text: Column) -> Column:
    """Lowercase, accent-free words of two or more word characters.

    Combining marks go before the words are cut; precomposed letters are letters either way, so they
    are folded word by word, and only in words that are not plain ASCII.
    """
    plain = F.regexp_replace(F.lower(text), r"\p{Mn}+", "")
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.transform(words, fold_accents)


def ngrams(words: Column) -> Column:
    """Single words followed by pairs of neighbours."""

    def with_pairs(word: Column) -> Column:
        # zip_with pads the shorter side, so the pair made of the last word alone is dropped
        pairs = F.zip_with(word, F.slice(word, 2, F.size(word)),
                           lambda left, right: F.concat(left, F.lit(" "), right))
        return F.concat(word, F.filter(pairs, lambda pair: pair.isNotNull()))

    return let(words, with_pairs)
