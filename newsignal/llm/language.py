"""Language identification in two steps: the family, then one-versus-one linear support vector machines.

Features are 1- to 3-grams of bytes of lower-cased letters, hashed to 2^16 slots; the value of a slot is its
share of the n-grams of the text, times a constant. One machine per family separates it from the others, and
the family with the largest margin is chosen. Within it one machine per pair of languages votes; ties go to
the larger sum of margins, then to the smaller code. Both steps are dot products over whole Arrow batches.

Which languages belong together is a parameter; a language of no listed family is a family of its own.

Defined results: ``und`` with score 0 for a null text or one without a letter. A label that is null or blank is
not learnt from. With a single learnt language everything else gets that language. Repeated rows get equal
results; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm import linear
from newsignal.llm.features import byte_ngrams, counted
from newsignal.llm.shared import map_texts, text_pieces

# fixed values: ISO codes of closely related languages
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "sinitic": ("zh", "yue"),
}
UNKNOWN = "und"
_ORDERS = (1, 2, 3)


def family_of(language: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((name for name, members in families.items() if language in members), language)


@dataclass(frozen=True)
class LanguageModel:
    bits: int
    scale: float
    languages: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]  # languages of each family
    pairs: tuple[tuple[str, str], ...]
    machines: tuple[np.ndarray, ...]  # one weight vector per family, then one per pair

    def margins(self, texts: pa.Array) -> np.ndarray:
        """One row per text, one column per machine."""
        weights = np.stack(self.machines, axis=1) if self.machines else np.zeros((1 << self.bits, 0))
        parts = [np.zeros((0, weights.shape[1]))]
        for first, last, data, offsets in text_pieces(texts, 1 << 19):
            feature, row = byte_ngrams(data, offsets, self.bits, _ORDERS)
            total = np.maximum(np.bincount(row, minlength=last - first), 1)
            sums = [np.bincount(row, weights=weights[feature, k], minlength=last - first) for k in range(weights.shape[1])]
            parts.append(self.scale * np.stack(sums, axis=1) / total[:, None] if sums else np.zeros((last - first, 0)))
        return np.concatenate(parts)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and a score from 0 to 1: the product of the chosen family's and language's certainty."""
        margins = self.margins(texts)
        known = has_letter(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n = len(self.groups)
        chosen = margins[:, :n].argmax(axis=1) if n > 1 else np.zeros(len(texts), np.int64)
        certainty = linear.sigmoid(margins[np.arange(len(texts)), chosen]) if n > 1 else np.ones(len(texts))
        found = np.empty(len(texts), dtype=object)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(chosen == g)
            votes = np.zeros((len(rows), len(members)))
            sums = np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    margin = margins[rows, n + k]
                    for language, sign in ((a, 1.0), (b, -1.0)):
                        at = members.index(language)
                        votes[:, at] += sign * margin > 0
                        sums[:, at] += sign * margin
            best = np.lexsort((np.broadcast_to(-np.arange(len(members)), votes.shape), sums, votes), axis=1)[:, -1]
            found[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                certainty[rows] *= linear.sigmoid(sums[np.arange(len(rows)), best] / (len(members) - 1))
        found[~known] = UNKNOWN
        return found.tolist(), np.where(known, certainty, 0.0)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text holds a Unicode letter."""
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, *, bound: int = 16_000, shards: int = 4, bits: int = 16, scale: float = 32.0,
        penalty: float = 1e-4, epochs: int = 2, most: int = 500,
        families: dict[str, tuple[str, ...]] | None = None) -> LanguageModel:
    """Fit on at most about ``bound`` rows of ``docs`` (doc_id, text, lang) that are not held out.

    There may be at most ``most`` languages: the pairs within a family are a machine each.
    """
    families = FAMILIES if families is None else families
    known = docs.filter("trim(lang) <> ''").filter(~linear.held_out(4, 2))
    languages = tuple(sorted(row["lang"] for row in known.select("lang").distinct().limit(most + 1).collect()))
    if len(languages) > most:
        raise ValueError(f"more than {most} languages: raise `most`, or clean the labels")
    codes = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)]) if languages else None
    names = sorted({family_of(lang, families) for lang in languages})
    groups = tuple(tuple(lang for lang in languages if family_of(lang, families) == name) for name in names)
    pairs = tuple(pair for members in groups for pair in combinations(members, 2))
    if not languages:
        return LanguageModel(bits, scale, (), (), (), ())
    sample = linear.sampled(known.select("doc_id", "text", "lang"), bound)
    sample = sample.select("doc_id", "text", codes[F.col("lang")].alias("target"))
    index = {lang: k for k, lang in enumerate(languages)}
    # of each machine: the languages on its side, and those on the other
    sides = [({index[x] for x in members}, set(range(len(languages))) - {index[x] for x in members}) for members in groups]
    sides += [({index[a]}, {index[b]}) for a, b in pairs]

    def vectorise(data: np.ndarray, offsets: np.ndarray):
        row, feature, count = counted(*byte_ngrams(data, offsets, bits, _ORDERS), bits)
        total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
        return row, feature, scale * count / total[row]

    def train(table: pa.Table):
        rows = linear.rows_of(table, vectorise)
        return {k: _machine(rows, np.isin(rows.target, list(mine)), np.isin(rows.target, list(theirs)))
                for k, (mine, theirs) in enumerate(sides)}

    def _machine(rows: linear.Rows, mine: np.ndarray, theirs: np.ndarray):
        """Hinge loss with an L2 penalty by stochastic steps; the shrinking is kept in one factor."""
        weights, factor, steps = np.zeros(1 << bits), 1.0, 0
        for _ in range(epochs):
            for i in np.flatnonzero(mine | theirs):
                at, x = rows.row(i)
                side = 1.0 if mine[i] else -1.0
                steps += 1
                rate = 1.0 / (penalty * (steps + 1.0 / penalty))
                margin = side * factor * (weights[at] @ x)
                factor *= 1.0 - rate * penalty
                if margin < 1.0:
                    weights[at] += rate * side / factor * x
        at = np.flatnonzero(weights)
        return at, weights[at] * factor

    found = linear.fit(sample, train, shards)
    machines = tuple(linear.dense(found.get(k), 1 << bits) for k in range(len(sides)))
    return LanguageModel(bits, scale, languages, groups, pairs, machines)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    def work(texts: pa.Array) -> dict[str, pa.Array]:
        languages, scores = model.predict(texts)
        return {"lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores, pa.float64())}

    found = map_texts(docs, "lang_pred string, score double", work, ["doc_id"])
    return found.select("doc_id", linear.held_out(4, 2).alias("held_out"), "lang_pred", "score")
