"""Packing of tokenised documents: ids against the tokenizer library, places against the rules, plans bin by bin."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsignal.llm import packing, queries


def library():
    made = Tokenizer.from_file(packing.default_tokenizer())
    made.encode_special_tokens = True
    return made


def bin_by_bin(histogram, size, least_gap):
    """The same rule, one bin after the other and piece by piece."""
    left, bins = Counter({k: v for k, v in histogram.items() if v}), []
    while left:
        own, room = [], size
        while fit := [x for x in left if x <= room]:
            own.append(max(fit))
            room -= own[-1]
            left[own[-1]] -= 1
            left += Counter()
        if room >= least_gap:
            pairs = [(a + b, a, b) for a in left for b in left if b <= a and (a != b or left[a] > 1) and a + b <= room + own[-1]]
            if pairs and max(pairs)[0] > own[-1]:
                _, a, b = max(pairs)
                left[own[-1]] += 1
                own[-1:] = [a, b]
                left.subtract([a, b])
                left += Counter()
        bins.append(sorted(own, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_the_bins_of_the_rule(seed):
    rng = random.Random(seed)
    histogram = {length: rng.randint(0, 5) for length in range(rng.randint(1, 9), 30)}
    for gap in (1, 4, 64):
        runs = packing._filled(histogram, 32, gap)
        assert [sorted((x for x, n in used for _ in range(n)), reverse=True) for bins, used in runs for _ in range(bins)] == bin_by_bin(histogram, 32, gap)
    assert sum(n for n, _ in packing.plan(histogram, 32)) == min(len(bin_by_bin(histogram, 32, 1 << k)) for k in range(7))


def test_plans_are_near_the_least_number_of_bins():
    rng = random.Random(3)
    thirds = {length: rng.randint(0, 9) for length in range(200, 400)}
    least = -(-sum(x * n for x, n in thirds.items()) // 1024)
    got = sum(n for n, _ in packing.plan(thirds))
    assert got <= 1.03 * least < sum(n for n, _ in packing._filled(thirds, 1024, 2048))  # the exchange helps
    assert packing.plan({}) == [] and packing.plan({1024: 5}) == [(5, [(1024, 1)])]


@pytest.mark.parametrize("text", [
    "<|endoftext|> a", "a\u0085 b  \x1c c²Ⅷ's 'S I'LL", "퟿\U0001f600 x" * 3, " " * 3000, "\n" * 999 + "x", " \n" * 500, "a" * 3000, "  lead and trail  ", "é" * 1500])
def test_ids_are_those_of_the_library(text):
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    assert encoder.quick is not None
    assert encoder.ids(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_go_through_the_library():
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    assert encoder.quick is None and len(encoder.ids("Some WORDS here")) == 3


def test_cuts():
    assert packing.cuts(0) == [] and packing.cuts(1024) == [(0, 1024)] and packing.cuts(1025) == [(0, 1), (1, 1024)]
    assert packing.cuts(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def check(rows, texts, size=1024):
    """Every piece once, its ids those of the library, sequences gapless from 0."""
    made, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {d for d, _ in texts}
    for doc, text in texts:
        ids = np.array([*made.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cuts(len(ids), size)
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes()) for r in mine]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op13_packing(spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                                "sequence_id": "bigint", "offset": "bigint"}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = got.collect()
    used = check(rows, texts)
    assert used <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_odd_rows_and_sequences(spark):
    data = [(1, None), (2, ""), (3, "word " * 5000), (4, "same"), (5, "same"), (6, "x"), (None, "no id")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("length", F.lit("name clash")).withColumn("place", F.lit(1)).repartition(3)
    packed = packing.pack(docs, ids=True)
    check(packed.collect(), data)
    made = packing.sequences(packed).collect()
    tokens = sum(len(r["tokens"]) for r in made)
    assert tokens == packed.agg(F.sum("length")).first()[0] and all(len(r["tokens"]) <= 1024 for r in made)
    assert sum(r["tokens"].count(2) for r in made) == len(data)
    repeated = packing.pack(docs.filter("doc_id = 4").unionByName(docs.filter("doc_id = 4"))).collect()
    assert len(repeated) == 2 and len({(r["sequence_id"], r["offset"]) for r in repeated}) == 2
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = {packing.pack(docs.repartition(n)).select("sequence_id").distinct().count() for n in (1, 7)}
    assert len(counts) == 1
