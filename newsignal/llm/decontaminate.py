"""Benchmark decontamination with DataFrame functions only: n-grams of the test items sought in all texts.

Texts are sequences of lower-cased words. A window is ``size`` consecutive words of an item (the whole item
if it is shorter). A window of k words covers a whole block of b = (k + 1) // 2 words that starts at a multiple
of b, wherever it occurs, so a document only offers its aligned blocks, n / b of them, to a broadcast hash set
of the b-grams of the windows. Around a block that hits, the few possible windows are compared word by word.
The scan is one pass: the rows of a document (itself, and its verified hits) meet in one narrow aggregation.

The hash set is broadcast. It holds at most ``bound`` windows at a time; larger benchmarks are taken in
blocks of windows, each against all documents.

Defined results: null and empty texts have no words and no hits; an item without words has no window; an item
without id marks words but is not listed; repeated items count once; each of several equal rows gets the
same result. Extra columns are not read, or handed on unchanged by :func:`remove`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.shared import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLACES = 30  # a code holds a block length above this many bits of position


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def windows_of(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """gram (the words of a window), k (their number), items (the ids that have it, sorted) of a benchmark."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).distinct()
    items = items.withColumn("k", F.least(F.lit(size), F.size("words"))).filter("k > 0")
    grams = items.select("item", "k", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
    grams = grams.select("item", "k", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("k"))).alias("gram"))
    return grams.groupBy("k", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], with_documents: bool) -> DataFrame:
    """Rows (doc_id, digest, n_words, at, k, items): verified windows, and with at = -1 each row itself."""
    steps = sorted({(k + 1) // 2 for k in lengths})
    mask = (1 << _PLACES) - 1
    n = F.size("words")
    codes = [F.array(F.lit(-1).cast("long"))] if with_documents else []
    codes += [F.when(n >= b, F.sequence(F.lit(b << _PLACES), F.lit(b << _PLACES) + n - b, F.lit(b).cast("long")))
              .otherwise(F.array().cast("array<long>")) for b in steps]
    split = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    split = split.select("doc_id", "digest", "words", n.alias("n_words"), F.explode(F.concat(*codes)).alias("code"))
    b, at = F.shiftright("code", _PLACES).cast("int"), F.col("code").bitwiseAND(F.lit(mask)).cast("int")
    block = F.concat_ws(" ", F.slice("words", at + 1, b))
    split = split.withColumn("block", F.when(F.col("code") >= 0, F.xxhash64(b, block)))

    # the b-grams by which a window can be found: those at its first b places
    half = F.floor((F.col("k") + 1) / 2).cast("int")
    seeds = windows.select("k", half.alias("b"), F.split("gram", " ").alias("w"))
    seeds = seeds.select("b", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("b") + 1)).alias("at"), "w")
    seeds = seeds.select(F.xxhash64("b", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("b")))).alias("seed")).distinct()
    found = split.join(F.broadcast(seeds), F.col("block") == F.col("seed"), "left").filter("code = -1 or seed is not null")

    first = F.greatest(at - b + 1, F.lit(0))
    around = found.select(
        "doc_id", "digest", "n_words", "code", b.alias("b"), first.alias("first"), at.alias("last"),
        F.when(F.col("code") >= 0, F.slice("words", first + 1, b * 4)).alias("near"))
    starts = F.when(F.col("code") >= 0, F.sequence("first", "last")).otherwise(F.array(F.lit(-1)))
    tried = around.select("doc_id", "digest", "n_words", "b", "first", "near", F.explode(starts).alias("at"))
    sizes = F.when(F.col("at") >= 0, F.array(F.col("b") * 2 - 1, F.col("b") * 2)).otherwise(F.array(F.lit(0)))
    tried = tried.select("*", F.explode(sizes).alias("k"))
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("k") <= F.col("n_words"))
    gram = F.when(inside, F.concat_ws(" ", F.slice("near", F.col("at") - F.col("first") + 1, F.col("k"))))
    tried = tried.select("doc_id", "digest", "n_words", "at", "k", gram.alias("found"))
    return tried.join(F.broadcast(windows.select("gram", "items")), F.col("found") == F.col("gram"), "left").filter(
        "at = -1 or gram is not null").select("doc_id", "digest", "n_words", "at", "k", "items")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = 500_000) -> DataFrame:
    """One row per document row with any number of hits: doc_id, digest, n_words, spans, items, copies.

    ``spans`` are the verified windows (at, k) in words, ``items`` the sorted item ids.
    """
    windows = materialise(windows_of(benchmark, size))
    sizes = {row["k"]: row["n"] for row in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    parts = max(1, -(-sum(sizes.values()) // bound))
    found = [_hits(docs, windows.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part) if parts > 1 else windows,
                   list(sizes), part == 0) for part in range(parts)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    span = F.when(F.col("at") >= 0, F.struct("at", "k"))
    return rows.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("items").alias("items"),
        F.count(F.when(F.col("at") == -1, 1)).cast("int").alias("copies")).select(
        "doc_id", "digest", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "copies")


def _covered(spans: Column) -> Column:
    """Number of words in the union of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda state, span: F.struct(
            F.greatest(state["end"], span["at"] + span["k"]).alias("end"),
            (state["total"] + F.greatest(F.lit(0), span["at"] + span["k"] - F.greatest(state["end"], span["at"]))).alias("total")),
        lambda state: state["total"])


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = hits(docs, benchmark, size, bound)
    n_hit = _covered(F.col("spans"))
    counted = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    return counted.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", size: int = 10, bound: int = 500_000) -> DataFrame:
    """``docs``, all columns, without contaminated documents, or (``mode="span"``) without the words of the hits.

    Only documents with hits are written down; the others are handed on as they are. In span mode the words of
    a hit and the signs up to the next word go, and ``n_chars`` (if there is one) is counted again.
    """
    bad = materialise(hits(docs, benchmark, size, bound).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest"), F.array_sort("spans").alias("__llm_spans")))
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.xxhash64("text") == F.col("__llm_digest"))
    if mode == "document":
        return docs.join(bad, same, "left_anti")
    joined = docs.join(bad, same, "left")
    words = F.regexp_extract_all("text", F.lit(_CASED_WORD), F.lit(0))
    gaps = F.split("text", _CASED_WORD)  # one more than words
    hit = lambda i: F.exists("__llm_spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["k"]))
    left = F.filter(F.transform(F.arrays_zip(words.alias("w"), F.slice(gaps, 2, F.size(words)).alias("g")),
                                lambda pair, i: F.when(~hit(i), F.concat(pair["w"], pair["g"]))), lambda x: x.isNotNull())
    text = F.when(F.col("__llm_spans").isNull(), F.col("text")).otherwise(F.concat(gaps[0], F.array_join(left, "")))
    cleaned = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__llm_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return cleaned.select(docs.columns)


ORACLE = r"""
with items as (
  select distinct cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, k, array_to_string(w[pos:pos + k - 1], ' ') as gram
  from (select item, w, k, unnest(range(1, len(w) - k + 2)) as pos
        from (select item, w, least(10, len(w)) as k from items) where k > 0)),
docs as (
  select row_number() over () as row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
lengths as (select distinct k from windows),
places as (
  select row_no, k, w, unnest(range(1, len(w) - k + 2)) as pos from docs, lengths where len(w) >= k),
found as (
  select p.row_no, p.pos, p.k, x.item
  from (select row_no, pos, k, array_to_string(w[pos:pos + k - 1], ' ') as gram from places) p
  join windows x on x.k = p.k and x.gram = p.gram),
hit_words as (select distinct row_no, unnest(range(pos, pos + k)) as word from found),
n_hits as (select row_no, count(*) as n_hit from hit_words group by row_no),
n_items as (
  select row_no, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct row_no, item from found where item is not null) group by row_no)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.listed, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join n_hits h using (row_no) left join n_items i using (row_no)
"""
