"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a fixed 60-bit hash of its id. A source takes whole copies of all its documents and, for
the remaining budget, the documents below a threshold of that hash. The threshold is found without sorting:
sizes are summed by source and hash bucket, running sums over the buckets find the one in which the budget
ends, and only the documents of that bucket are summed again by the next bits. A larger budget always takes
a superset. The source totals, the histograms and the thresholds grow with the number of sources alone.

Defined results: a null or empty text has size 0 and is taken 0 times; null is a source of its own, the last
one; documents of equal id share a hash and are taken together; a null id is hashed as an empty text. Empty
tables give empty results. Columns that the mixture adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.llm.shared import materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_LEVELS = ((48, 12), (36, 12), (0, 36))  # (shift, bits) of the hash, from the top; the last level is exact


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the id's md5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, from one row (source, source_size) per source.

    Sources share the sum of all sizes by weight; a target stops at ``most`` times its source and the excess
    is shared again. With sources in the order of cap / weight, those before the first that stays below its
    cap are capped and the others get the same amount per unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("turn", turn).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    ranked = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level of the first free source holds for all that follow
    ranked = ranked.withColumn("free", F.first(free, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("free").isNull(), F.col("cap").cast("double")).otherwise(F.col("free") * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies, threshold: a document is taken ``copies`` times, and once more if
    its hash is below the threshold. ``sized`` has source, size, hash; ``goals`` comes from :func:`targets`."""
    copies = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    state = goals.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = materialise(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0))
    for shift, bits in _LEVELS:
        exact = shift == 0
        sought = state.filter("open").select("source", "prefix", "left")
        inside = sized.alias("d").join(
            sought.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright("d.hash", shift + bits) == F.col("s.prefix"))).select(
            "d.source", F.shiftright("d.hash", shift).alias("bucket"), "d.size", "s.left")
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("size").over(running))
        ends = sums.filter(F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("bucket", "size", "upto")).alias("end"))
        state = state.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
        found, before = F.col("e.end").isNotNull() & F.col("open"), F.col("e.end.upto") - F.col("e.end.size")
        spare = F.col("left") - before
        # the boundary document itself goes to the nearer side
        bucket = F.col("e.end.bucket") + (F.when(F.col("e.end.size") - spare <= spare, 1).otherwise(0) if exact else 0)
        # an open source whose budget ends in no bucket takes everything below its prefix + 1
        past = (F.col("prefix") + 1) * F.lit(1 << bits)
        state = materialise(state.select(
            "t.source", "source_size", "target", "copies",
            F.when(found, spare).otherwise(F.col("left")).alias("left"),
            F.when(found, bucket).when(F.col("open"), past).otherwise(F.shiftleft("prefix", bits)).alias("prefix"),
            found.alias("open")))
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row of thresholds per source).

    Sizes and hashes are written once: the passes of the histogram read narrow rows, never texts.
    """
    sized = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, materialise(targets(totals, weights, most)))


def _taken(size: Column, hashed: Column) -> Column:
    return (size * (F.col("g.copies") + F.when(hashed < F.col("g.threshold"), 1).otherwise(0))).cast("long")


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sized, limits = mix(docs, **how)
    return sized.alias("d").join(limits.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "d.doc_id", "d.size", "g.source_size", "g.target", _taken(F.col("d.size"), F.col("d.hash")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Rows that the mix takes, all columns, with size, source_size, target, taken and copies."""
    _, limits = mix(docs, **how)
    added = ("size", "source_size", "target", "taken", "copies")
    size, hashed = size_of(F.col("d.text")), hash_of(F.col("d.doc_id"))
    joined = docs.alias("d").join(limits.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    times = F.col("g.copies") + F.when(hashed < F.col("g.threshold"), 1).otherwise(0)
    return joined.filter(times > 0).filter(size > 0).select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in added],
        size.alias("size"), "g.source_size", "g.target", (size * times).cast("long").alias("taken"), times.cast("long").alias("copies"))


ORACLE = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (
  select *, source_size * 3 as cap, [5, 2, 1][1 + (turn % 3)] as weight
  from (select *, row_number() over (order by source nulls last) - 1 as turn from totals)),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0))
          / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0)) as level
  from ranked),
freed as (
  select *, first_value(case when level * weight <= cap then level end ignore nulls)
              over (order by cap / weight, turn rows between unbounded preceding and current row) as free
  from levels),
goals as (
  select source, source_size, cast(case when free is null then cap else free * weight end as double) as target from freed),
budgets as (
  select *, target - copies * source_size as budget
  from (select *, case when source_size = 0 then 0 else cast(floor(target / source_size) as bigint) end as copies from goals)),
summed as (select source, h, sum(size) as size from sized group by source, h),
running as (select *, sum(size) over (partition by source order by h) as upto from summed),
kept as (
  select r.source, r.h, (b.budget > 0 and r.upto - r.size <= b.budget
         and (r.upto <= b.budget or r.upto - b.budget <= b.budget - (r.upto - r.size))) as chosen
  from running r join budgets b on r.source is not distinct from b.source)
select s.doc_id, s.size, b.source_size, b.target,
       cast(s.size * (b.copies + case when k.chosen then 1 else 0 end) as bigint) as taken
from sized s
join budgets b on s.source is not distinct from b.source
join kept k on s.source is not distinct from k.source and s.h = k.h
"""
