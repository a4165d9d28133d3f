import random
import re

import pytest
from pyspark.sql import functions as F

import plain
from newsignal.llm import decontaminate, mixture, pii, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumn("items", F.lit(1)).withColumn("key", F.lit("x")).withColumn("taken", F.lit("old")) if extra else df


def some_texts(seed, many=60, vocabulary=7):
    rng = random.Random(seed)
    words = ["a", "B", "ccé", "7", "dd", "E-e", "ß", "ff"][:vocabulary]
    return [None, "", "  \n ", "..."] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(many)]


@pytest.mark.parametrize("bound", [500_000, 5])
def test_decontamination_equals_brute_force(spark, bound):
    texts = some_texts(1)
    items = [(k, t) for k, t in enumerate(some_texts(2, 12, 4))] + [(3, "A b"), (None, "ß ß ß"), (90, "A  b!"), (5, None)]
    items = [(k, " ".join((t or "").split()[:14]) if t else t) for k, t in items]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(4, texts[4], "s"), (4, "other a b", "t")], extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, decontaminate.report(docs, bench, bound=bound).collect()))
    want = sorted(plain.decontamination([(r["doc_id"], r["text"]) for r in docs.collect()], items))
    assert got == want
    left = decontaminate.remove(docs, bench, bound=bound)
    bad = {row[0:2] for row in want if row[5]}
    assert left.columns == docs.columns
    assert left.count() == sum(not row[5] for row in want)
    cut = decontaminate.remove(docs, bench, mode="span", bound=bound)
    assert cut.count() == docs.count() and bad
    clean = {r["text"] for r in docs.collect()} - {r["text"] for r in cut.collect()}
    assert clean  # texts with hits have changed
    for row in cut.collect():
        if row["text"] in texts:
            assert row["n_chars"] == len(row["text"] or "")


def test_decontamination_span_mode_cuts_only_the_hit(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(1, f"Before, {passage.title()}; after it.", "s"), (2, "Nothing here", "s")])
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench, mode="span").collect()}
    assert texts == {1: "Before, after it.", 2: "Nothing here"}


def test_empty_tables(spark):
    docs, none = frame(spark, [(1, "a b", "s"), (None, None, None)]), frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.report(docs, bench).collect()] == [0, 0]
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.remove(docs, bench).count() == 2
    assert simhash.near_duplicates(none).count() == 0
    assert pii.report(none).count() == 0
    assert mixture.mixed_sizes(none).count() == 0
    assert mixture.mixed_documents(none).count() == 0


@pytest.mark.parametrize("cell", [512, 3])
def test_simhash_equals_brute_force(spark, cell):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts = [None, "", " \t", "Same", "same"] + base + base[:5]
    for text in base[:8]:
        for _ in range(12):  # groups of near copies
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = frame(spark, [(k * 3 + 1, t, "s") for k, t in enumerate(texts)], extra=True)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, cell=cell).collect()}
    prints = [plain.simhash(t) for t in texts]
    ids = [k * 3 + 1 for k in range(len(texts))]
    named = plain.components(ids, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, named)}
    kept = simhash.keep_one(docs.unionByName(docs), cell=cell)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(named))


def test_simhash_broadcasts_no_table_of_keys_or_documents(spark):
    nodes = spark.createDataFrame([(k % 9, k) for k in range(30)], "bits long, node long")
    assert "Broadcast" not in simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    named = simhash.near_duplicates(frame(spark, [(k, f"a b c d {k}", "s") for k in range(9)]))
    assert "SortMergeJoin [bits" in named._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in named.collect()) == list(range(9))


def test_simhash_links_of_distance_four_only():
    import numpy as np
    bits = np.array([0, 0b1111, 0b11111, 1 << 63], dtype=np.uint64)
    assert simhash._trees(bits, 4).tolist() == [0, 0, 0, 0]
    assert simhash._trees(bits[[0, 2]], 4).tolist() == [0, 1]


def plain_spans(text):
    """The base patterns as they stand, without any care for time."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    pieces = ["@", ".", "a", "b-c", "1", "23", " ", "-", "+", "(", ")", "255.", "4111 1111 1111 1111", "é", "%", "_x@y.z", "..", "10.0.0.1", "@@"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        got = [s[:3] for s in pii.spans(text) if s.kind in pii.BASE]
        assert got == plain_spans(text), text


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    kinds = lambda text: [s.kind for s in pii.spans(text)]
    assert kinds("account GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("on 123-45-6789 it was") == [] and kinds("his SSN is 123-45-6789") == ["national_id"]
    assert kinds("please call (325) 555-8094 now") == ["national_phone"] and kinds("at (325) 555-8094 it") == []
    assert kinds("phone +1 (325) 555-8094") == ["phone"]
    assert pii.masked("mail a.b@c.de or +1 (325) 555-8094") == "mail <email> or <phone>"


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "A0" * 200_000, "+1" + "(" * 300_000):
        pii.spans(text)


def test_redaction_keeps_columns(spark):
    docs = frame(spark, [(1, "to x@y.org", "s"), (None, None, None), (2, "", "s"), (3, "plain", "s")], extra=True)
    out = pii.redact(docs)
    assert out.schema == docs.schema
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "to <email>", 10), (None, None, 0), (2, "", 0), (3, "plain", 5)}
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert rows[1]["spans"] == "email:3:10" and rows[1]["n_email"] == 1 and rows[3]["spans"] == ""
    assert rows[2]["base_sha256"] == rows[None]["base_sha256"]


def test_mixture_reaches_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("w" * rng.randint(1, 30)), rng.choice(["a", "b", "b", "b", "b", "ä", "Z", None, "empty"])) for k in range(3000)]
    rows = [(k, "" if s == "empty" else t, s) for k, t, s in rows] + [(None, "x y", "a"), (7, None, None)]
    docs = frame(spark, rows, extra=True)
    got = mixture.mixed_sizes(docs).collect()
    sizes, taken = {}, {}
    source_of = {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        source_of[k, len((t or "").split())] = s
    want = plain.targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        if r["doc_id"] not in (None, 7):
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.mixed_sizes(docs.repartition(7)).collect()), key=str)
    mixed = mixture.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "items", "key", "size", "source_size", "target", "taken", "copies"]
    assert mixed.agg(F.sum("taken")).first()[0] == sum(taken.values())


def test_mixture_with_one_document(spark):
    row = mixture.mixed_sizes(frame(spark, [(1, "a b c", None)])).first()
    assert (row["target"], row["taken"]) == (3.0, 3)
