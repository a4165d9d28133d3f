"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every pattern is applied so that a text is read in linear time: an email is sought around each ``@``, digit
groups start where a run of digits starts. Kinds that a pattern and a checksum or length settle (email, ip,
card, phone) are always reported. The others (iban by mod 97, national phone numbers, national ids, cards
that fail Luhn) are reported if pattern, checksum and nearby words together reach ``threshold``.

Defined results: a null or empty text has no spans. Spans of one kind never overlap; spans of different kinds
may. Repeated rows get equal results. Extra columns are not read, or handed on unchanged by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban", "national_phone", "national_id")
THRESHOLD = 0.6
_REACH = 40  # characters on either side in which context words count

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# fixed values: context words by kind
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "national_phone": ("phone", "call", "tel", "mobile", "fax", "contact", "telefon", "teléfono", "téléphone"),
    "national_id": ("ssn", "social security", "tax id", "national id", "identity"),
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"), "phone": ("phone", "call", "tel", "mobile", "fax"),
}
_PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.7, "phone": 0.7, "iban": 0.7, "national_phone": 0.5, "national_id": 0.4}
_NEAR = 0.25


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _octets(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.split("."))


def _digits(match: str) -> str:
    return match.translate(_SIGNS)


_SIGNS = str.maketrans("", "", " ().+-")


def _proposals(text: str):
    """(kind, start, end) that pattern and checksum or length allow, kind by kind, from left to right."""
    yield from (("email", a, b) for a, b in _emails(text))
    yield from (("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    yield from (("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", "")))
    yield from (("national_phone", *m.span()) for m in _NATIONAL_PHONE.finditer(text))
    yield from (("national_id", *m.span()) for m in _NATIONAL_ID.finditer(text))


def spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Spans by kind in the order of ``KINDS``, then by start, in code points, ends exclusive."""
    found, taken = [], []
    for kind, start, end in _proposals(text or ""):
        around = text[max(0, start - _REACH): start].lower() + " " + text[end: end + _REACH].lower()
        score = min(1.0, _PRIOR[kind] + _NEAR * any(word in around for word in CONTEXT[kind]))
        if kind in BASE:
            taken.append((start, end))
        elif score < threshold or any(a < end and start < b for a, b in taken):
            continue  # below the threshold, or part of a span that is settled
        found.append(Span(kind, start, end, score))
    return found


def _listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and min_score of every row."""
    schema = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, min_score double")

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        counts = np.zeros((len(BASE), len(texts)), dtype=np.int64)
        digests, listed, lowest = [], [], []
        for row, text in enumerate(texts):
            found = spans(text.as_py(), threshold)
            base = [s for s in found if s.kind in BASE]
            for span in base:
                counts[BASE.index(span.kind), row] += 1
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            listed.append(_listed(found))
            lowest.append(min((s.score for s in found), default=None))
        return {**{f"n_{kind}": pa.array(counts[k]) for k, kind in enumerate(BASE)},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(listed, pa.string()),
                "min_score": pa.array(lowest, pa.float64())}

    return map_texts(docs, schema, work, ["doc_id"])


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, done = [], 0
    for span in sorted(spans(text, threshold), key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            parts += [text[done: span.start], f"<{span.kind}>"]
        done = max(done, span.end)
    return "".join([*parts, text[done:]]) if parts else text


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, with personal data masked and ``n_chars`` (if there is one) counted again."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            texts = pa.array([None if t is None else masked(t, threshold) for t in column.to_pylist()], column.type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
