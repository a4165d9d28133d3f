"""Best-two-fit packing of tokenised documents into sequences of at most ``size`` tokens.

A document is its token ids and an end id. Longer ones are cut into pieces of ``size`` tokens, the first of which may
be shorter. Only lengths matter to a packing, so it is planned over the histogram of lengths, which has ``size``
entries whatever the number of documents: a bin is filled with the longest piece that still fits, again and again;
then its smallest piece is exchanged for two unpacked ones whose sum fits the widened gap more tightly. Exchanges eat
small pieces that later bins may need more, so the plan is made for several least gaps from which a bin is worth an
exchange, and the one with the fewest bins is used. The same bin is repeated while its lengths last, which is what bin
after bin would give, so a plan has at most a few thousand runs of equal bins.

Pieces are numbered within their length by counters of their tasks and an offset for each task and length; the number
of a piece says in which run, bin and place it goes. Text is read once, no piece is moved to be packed, and no length,
however frequent, meets in one task.

Token ids are those of the ``tokenizers`` library for the file given; special tokens in a text are ordinary text.
Files of byte-level pair merges, whose ids are their merge ranks, are encoded by ``tiktoken`` with the same ranks and
split pattern, which gives the same ids (tested) in a fifth of the time; other files by ``tokenizers`` itself.

Defined results: a null or empty text is its end id alone. Repeated rows are documents of their own, and a null id
stays null. Extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from newsignal.llm.shared import materialise

SIZE = 1024
END_ID = 2
_WIDE = 1 << 42  # above any number of pieces of one length
_ENCODERS: dict[int, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else the next free code point."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_ranks(file: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level pair-merge file whose ids are its merge order; None for any other kind of file."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True) and not file.get("normalizer") and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not plain:
        return None
    signs = _byte_signs()
    special = {token["content"] for token in file.get("added_tokens", [])}
    pieces = [(piece, number) for piece, number in model["vocab"].items() if piece not in special]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    in_order = [piece for piece, _ in sorted(pieces, key=lambda x: x[1])]
    if in_order[256:] != merged or not all(c in signs for piece in in_order for c in piece):
        return None
    return {bytes(signs[c] for c in piece): number for piece, number in pieces}


@dataclass
class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers."""
    text: str

    def __post_init__(self) -> None:
        ranks = merge_ranks(json.loads(self.text))
        self.quick = self.slow = None
        if ranks is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_str(self.text)
            self.slow.encode_special_tokens = True
        else:
            import public_tokenizers
            import tiktoken
            self.quick = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.quick is not None:
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cuts(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all of ``size`` but the first."""
    first = length % size or min(length, size)
    return [(0, first), *((start, size) for start in range(first, length, size))] if length else []


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, the task (part) that cut it and its number there among
    those of its length (place); with ``ids`` also its token ids (binary, little-endian unsigned 32-bit)."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = StructType(docs.select("doc_id").schema.fields + StructType.fromDDL(
        "piece int, start long, length int, ids_crc32 long, part int, place long" + (", ids binary" if ids else "")).fields)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        text = shared.value
        encoder = _ENCODERS.get(hash(text)) or _ENCODERS.setdefault(hash(text), Encoder(text))
        seen = np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, number, start, length, crc, place, kept = [], [], [], [], [], [], []
            for at, value in enumerate(batch.column("text")):
                data = encoder.ids(value.as_py()).tobytes() + end
                for k, (first, count) in enumerate(cuts(len(data) // 4, size)):
                    own = data[4 * first: 4 * (first + count)]
                    row.append(at)
                    number.append(k)
                    start.append(first)
                    length.append(count)
                    crc.append(zlib.crc32(own))
                    place.append(seen[count])
                    seen[count] += 1
                    if ids:
                        kept.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)),
                 pa.array(place, pa.int64())] + ([pa.array(kept, pa.binary())] if ids else []), names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _two(counts: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum of at most ``room``; the larger first, ties by the largest; or (0, 0)."""
    if room < 2:
        return 0, 0
    lengths = np.arange(room + 1)
    below = np.maximum.accumulate(np.where(counts[: room + 1] > 0, lengths, 0))  # longest unpacked length up to here
    first = lengths[1:][counts[1: room + 1] > 0]
    if not len(first):
        return 0, 0
    second = below[np.minimum(room - first, first)]
    alone = (second == first) & (counts[first] < 2)
    second = np.where(alone, below[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(first[best]), int(second[best])) if total[best] else (0, 0)


Runs = list[tuple[int, list[tuple[int, int]]]]


def plan(histogram: dict[int, int], size: int = SIZE) -> Runs:
    """Runs of equal bins: (number of bins, [(length, pieces of that length in each bin), ...]), longest lengths first.

    The best of the plans with exchanges from gaps of 1, 2, 4, ... tokens on; the last of them has no bin to exchange.
    """
    gaps = [1 << k for k in range(size.bit_length() + 1)]
    return min((_filled(histogram, size, gap) for gap in gaps), key=lambda runs: sum(bins for bins, _ in runs))


def _filled(histogram: dict[int, int], size: int, least_gap: int) -> Runs:
    counts = np.zeros(size + 1, np.int64)
    for length, number in histogram.items():
        counts[length] = number
    runs = []
    while counts.any():
        before, room, used = counts.copy(), size, defaultdict(int)
        while room:
            fit = np.flatnonzero(counts[1: room + 1])
            if not len(fit):
                break
            longest = int(fit[-1]) + 1
            uses = min(int(counts[longest]), room // longest)
            used[longest] += uses
            counts[longest] -= uses
            room -= uses * longest
        smallest = min(used)
        one, two = _two(counts, room + smallest) if room >= least_gap else (0, 0)
        if one + two > smallest:
            for length, change in ((smallest, -1), (one, 1), (two, 1)):
                used[length] += change
                if not used[length]:
                    del used[length]
        bins = min(int(before[length]) // uses for length, uses in used.items())
        counts = before
        for length, uses in used.items():
            counts[length] -= bins * uses
        runs.append((bins, sorted(used.items(), reverse=True)))
    return runs


def _slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each run and length: the first number of the length there (key: by length, then number), its first bin, its
    pieces per bin and where they begin in the bin."""
    taken: dict[int, int] = defaultdict(int)
    rows, bin_no = [], 0
    for bins, used in runs:
        offset = 0
        for length, uses in used:
            rows.append((length * _WIDE + taken[length], bin_no, uses, offset))
            taken[length] += bins * uses
            offset += length * uses
        bin_no += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "bin", "uses", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The columns of :func:`pieces` with sequence_id and offset: the sequence a piece belongs to and its place there."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, size, end_id, ids))
    counts = materialise(cut.groupBy("part", "length").agg((F.max("place") + 1).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, size)))  # bounded by ``size``, see plan
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select(*cut.columns, (F.col("base") + F.col("place")).alias("number"))
    schema = StructType([f for f in cut.schema.fields if f.name not in ("part", "place")]
                        + StructType.fromDDL("sequence_id long, offset long").fields)

    def run(batches):
        table = slots.value
        for batch in batches:
            number, length = batch.column("number").to_numpy(), batch.column("length").to_numpy().astype(np.int64)
            at = np.searchsorted(table["key"], length * _WIDE + number, side="right") - 1
            inside = number - table["key"][at] % _WIDE
            uses = table["uses"][at]
            kept = [batch.column(name) for name in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(table["bin"][at] + inside // uses), pa.array(table["offset"][at] + inside % uses * length)],
                names=schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens (array of ids), doc_ids of each sequence, from :func:`pack` with ``ids``.

    A group has at most ``size`` pieces, as a piece has a token at least.
    """
    def run(batches):
        for batch in batches:
            tokens = [np.frombuffer(b"".join(piece["ids"] for piece in row), "<u4").astype(np.int32) for row in batch.column("rows").to_pylist()]
            ids = [[piece["doc_id"] for piece in row] for row in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(tokens, pa.list_(pa.int32())),
                                              pa.array(ids, pa.list_(kind))], names=["sequence_id", "tokens", "doc_ids"])

    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(packed.schema["doc_id"].dataType)
    rows = F.sort_array(F.collect_list(F.struct("offset", "piece", "doc_id", "ids"))).alias("rows")
    return packed.groupBy("sequence_id").agg(rows).mapInArrow(
        run, f"sequence_id long, tokens array<int>, doc_ids array<{packed.schema['doc_id'].dataType.simpleString()}>")


def report(packed: DataFrame) -> DataFrame:
    """The columns of the packing, lengths as longs."""
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
