"""Repair of conversations against a plain version that keeps every audit as a string."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newsignal.llm import conversation

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def repaired(rows):
    """Counts, cost, audit and hash of one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}  # forward: an audit of the same cost is never the beginning of another one at the same row

    def offer(table, state, cost, audit, out):
        table[state] = min(table.get(state, (1 << 60, "", ())), (cost, audit, out))

    def inserted(table):
        more = dict(table)
        for state, (cost, audit, out) in table.items():
            offer(more, after[state], cost + 5, audit + "I", (*out, {"u": "user:", "a": "assistant:"}[after[state]]))
        return more

    for (_, role, text), fault in zip(rows, faults):
        step = {}
        for state, (cost, audit, out) in inserted(best).items():
            offer(step, state, cost + 2, audit + "D", out)
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                if role[:1] == after[state] or state == "" and role[:1] == "s":
                    offer(step, role[:1], cost + extra, audit + "K", (*out, f"{role}:{text}"))
                offer(step, after[state], cost + 1 + extra, audit + "R", (*out, {"u": "user:", "a": "assistant:"}[after[state]] + text))
        best = step
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def rows_of(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def invented(rng, conv, size, turns=None):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "ugly", None]
    texts = ["Yes.", "No", "", " \t", "What?", "Again\n", "end!  ", None, "é\nline."]
    return [(conv, rng.choice([None, *range(turns or size)]) if rng.random() < 0.3 else k, rng.choice(roles), rng.choice(texts)) for k in range(size)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain_version(spark, partitions):
    rng = random.Random(partitions)
    rows = [r for conv in [None, *range(60)] for r in invented(rng, conv, rng.randint(1, 12))] + invented(rng, 99, 400, 60)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("name clash")).withColumn("edits", F.lit(1)).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        segments = conversation.repair(conversation.damage(frame))
        got = rows_of(conversation.report(segments))
        most = segments.agg(F.max("n_segments")).first()[0]
        listed = conversation.repaired_rows(segments).filter("conv_id = 99").orderBy("segment", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = {conv: repaired(mine) for conv, mine in damaged(rows).items()}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and set(got) == set(want)
    assert (most > 3) == (partitions > 1)  # the long conversation lies in several tasks
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in listed).encode()).hexdigest() == want[99][-1]


def test_odd_conversations(spark):
    same = [(1, 0, "user", "copy.")] * 500  # repeated rows
    rows = same + [(2, None, None, None), (3, 5, "assistant", "a" * 200_000 + "."), (4, 0, "system", "alone."), (5, 1, "user", "cut")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(conversation.report(conversation.repair(frame)))
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append((row[0], row[1] or " ", row[2] or " "))
    assert got == {conv: repaired(mine) for conv, mine in by_conv.items()}
    assert got[4][5:7] == (2, "D") and got[2][6] == "D"
    gone = frame.withColumn("dropped", F.col("conv_id") == 4)
    assert rows_of(conversation.report(conversation.repair(gone)))[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation.report(conversation.repair(frame.limit(0))).collect() == []
    assert conversation.report(conversation.repair(conversation.damage(frame.limit(0)))).collect() == []


def test_string_ids(spark):
    rows = [("x", 0, "user", "hi."), ("x", 1, "assistant", "yes."), (None, 0, "assistant", "b.")]
    got = rows_of(conversation.report(conversation.repair(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string")))))
    assert got["x"][5:7] == (0, "KK") and got[None][5:7] == (2, "D")


def test_query_against_plain_version(spark):
    from newsignal.llm import queries
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert rows_of(queries.op12_conversation(spark, "/root/testdata/sf0.01")) == {c: repaired(m) for c, m in damaged(rows).items()}
