"""Token counts of a unigram vocabulary: the best segmentation of a text, counted and not built.

An Aho-Corasick automaton lists all pieces of the vocabulary that end at a place; dynamic programming keeps, for
each place, the best score and the number of pieces of the segmentation that has it. Tie rule of the tokenizer: among equal scores the
earliest start, so the longest last piece, wins. A character that is no piece costs the lowest score less 10; a
run of such characters is one unknown piece, or its bytes if the vocabulary has byte pieces.

No piece holds the space mark after another character, so the best segmentation of a text is that of its words,
one by one; likewise a word falls apart wherever no piece holds two neighbouring characters. A worker counts each
different part once and keeps up to ``_KEPT`` counts. If a vocabulary has pieces across words, texts are counted as
a whole.

The vocabulary is read on the driver from a file that is a parameter; it is broadcast, at most ``bound`` pieces.

Defined results: a null or empty text has 0 tokens. Repeated rows get equal counts; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import map_texts

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_PENALTY = 10.0
_NEVER = float("-inf")
_KEPT = 500_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_pieces: bool = True
    prefix: bool = True  # whether a text starts with a space mark


def read_vocabulary(path: str = DEFAULT_VOCABULARY, bound: int = 2_000_000) -> Vocabulary:
    """Normal pieces and their scores, as unigram log probabilities, of a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if len(ids) > bound:
        raise ValueError(f"more than {bound} pieces")
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(tuple(model.id_to_piece(i) for i in normal), tuple(model.get_score(i) for i in normal),
                      any(model.is_byte(i) for i in ids))


@dataclass
class Counter:
    """Counts the tokens of texts with one vocabulary."""
    vocabulary: Vocabulary
    kept: dict[str, int] = field(default_factory=dict)
    older: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pieces, scores = self.vocabulary.pieces, self.vocabulary.scores
        best: dict[str, float] = {}
        for piece, score in zip(pieces, scores):
            best.setdefault(piece, score)
        self.automaton = ahocorasick.Automaton()
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if best:
            self.automaton.make_automaton()
        self.empty = not best
        self.unknown = min(scores, default=0.0) - _PENALTY
        self.by_words = not any(SPACE in piece.lstrip(SPACE) for piece in best)
        self.joined = {pair for piece in best for pair in zip(piece, piece[1:])}
        if not self.vocabulary.byte_pieces:  # unknown neighbours are one token, so they are counted together
            covered = set().union(*best)
            self.by_words = self.by_words and {SPACE, "\n"} <= covered
        line_end = any("\n" in piece for piece in best) or not self.vocabulary.byte_pieces
        # a word takes the marks before it; a line end that no piece holds stands alone
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if line_end else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        line = (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE)
        if not self.by_words:
            return self._best(line)
        kept = self.kept
        total = 0
        for word in self.words.findall(line):
            found = kept.get(word)
            total += self._word(word) if found is None else found
        return total

    def _word(self, word: str) -> int:
        """Count of a word that the younger half of the cache does not hold."""
        found = self.older.get(word)
        if found is None:
            found = 0
            for part in self._parts(word):
                count = self.kept.get(part)
                if count is None:
                    count = self.older.get(part)
                    if count is None:
                        count = self._best(part)
                    self.kept[part] = count
                found += count
        if len(self.kept) >= _KEPT // 2:
            self.older = dict(self.kept)
            self.kept.clear()
        self.kept[word] = found
        return found

    def _parts(self, word: str) -> list[str]:
        """``word`` cut wherever no piece holds the two characters next to each other."""
        cuts = [0, *(at for at, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined), len(word)]
        return [word[x:y] for x, y in zip(cuts, cuts[1:])]

    def _best(self, line: str) -> int:
        """Number of tokens of the best segmentation."""
        size = len(line)
        score, count = [0.0] + [_NEVER] * size, [0] * (size + 1)
        unknown = bytearray(size + 1)  # whether the last piece is unknown

        def settle(places) -> None:
            """Offer the unknown piece where the last character alone is no piece."""
            for end in places:
                value = score[end - 1] + self.unknown
                if value > score[end]:
                    score[end], unknown[end] = value, 1
                    if self.vocabulary.byte_pieces:
                        count[end] = count[end - 1] + len(line[end - 1].encode("utf-8", "surrogatepass"))
                    else:  # a run of unknown characters is one token
                        count[end] = count[end - 1] + (not unknown[end - 1])

        done, shortest = 0, 1
        for end, (length, piece_score) in () if self.empty else self.automaton.iter(line):  # longest first
            end += 1
            if end != done:
                if shortest != 1 or end != done + 1:
                    settle(range(done + (shortest == 1), end))
                done = end
            value = score[end - length] + piece_score
            if value > score[end]:
                score[end], count[end] = value, count[end - length] + 1
            shortest = length
        settle(range(done + (shortest == 1), size + 1))
        return count[size]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counters: dict[int, Counter] = {}

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        counter = counters.get(0) or counters.setdefault(0, Counter(shared.value))
        return {"n_tokens": pa.array([counter.count(text.as_py()) for text in texts], pa.int64())}

    return map_texts(docs, "n_tokens long", work, ["doc_id"])


def totals(counted: DataFrame) -> DataFrame:
    """Documents and tokens in all."""
    return counted.agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
