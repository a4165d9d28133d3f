"""Keyed writes, files, streams, similarity and jobs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from newsignal import schemas
from newsignal.operators import keyed, models, signals, similar, vector_index
from newsignal.plans import jobs
from newsignal.sources import landing, sinks
from newsignal.streaming import ingest

D = dt.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_first_write_wins_and_reruns_add_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, n int")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_absent(batch, path, ["id"], [F.col("n")])
    assert rows(spark.read.parquet(path), "id", "n") == [("a", 1), ("b", 1)]


def test_last_write_wins_and_other_partitions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    order = [F.col("n").desc()]
    first = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, p string, n int")
    sinks.upsert_partitions(first, path, ["id", "p"], order, "p")
    untouched = {f.name for f in (tmp_path / "t" / "p=y").iterdir()}
    second = spark.createDataFrame([("a", "x", 2), ("a", "x", 3), ("c", "x", 1)], "id string, p string, n int")
    for _ in range(2):
        sinks.upsert_partitions(second, path, ["id", "p"], order, "p")
    assert rows(spark.read.parquet(path), "id", "n") == [("a", 3), ("b", 1), ("c", 1)]
    assert {f.name for f in (tmp_path / "t" / "p=y").iterdir()} == untouched


def test_merge_keeps_unchanged_rows(spark):
    old = spark.createDataFrame([("a", "h", "b"), ("c", "h", None)], "id string, headline string, body string")
    new = spark.createDataFrame([("a", "", "b"), ("c", None, "new"), ("z", "q", "q")], "id string, headline string, body string")
    got = keyed.merge_nonempty(old, new, "id", ["headline", "body"], ["headline", "body"])
    assert rows(got, "id", "headline", "body", "changed") == [("a", "h", "b", False), ("c", "h", "new", True)]


def test_conform_adds_defaults_and_keeps_extras(spark):
    df = spark.createDataFrame([(1, "x")], "id int, extra string")
    got = schemas.conform(df, schemas.PREDICTIONS, schemas.DEFAULTS["predictions"]).first()
    assert got["trade_status"] == "HOLD" and got["entry_price"] is None and got["extra"] == "x"


def test_report_files_without_a_date_are_skipped(spark, tmp_path):
    (tmp_path / "Arab Gulf 2024-01-02.txt").write_text("Key benchmarks\nDubai PCAAT00 80.5 0.5\nContents\n")
    (tmp_path / "notes.txt").write_text("Dubai PCAAT00 1 1")
    got = landing.read_report_files(spark, str(tmp_path))
    assert rows(got, "report_date", "report_type") == [(D(2024, 1, 2), "marketscan")]


def test_envelope_alternatives(spark):
    body = "x" * 101
    landed = spark.createDataFrame(
        [("1", '{"envelope": {"data": {"headline": "", "title": "T", "content": {"other": 1, "value": "%s"}}}}' % body),
         ("2", '{"title": "U", "body": "short"}'), ("3", "broken")], "id string, json string")
    got = {r["id"]: (r["headline"], len(r["body_text"])) for r in landing.normalise_envelopes(landed).collect()}
    assert got == {"1": ("T", 101), "2": ("U", 0), "3": ("", 0)}


def test_stream_is_idempotent_across_runs(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([("a", 1)], "id string, n int").schema
    for batch in ([("a", 1), ("b", 1), ("b", 1)], [("b", 1), ("c", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.file_stream(spark, source, schema)
        ingest.ingest(stream, table, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(table), "id") == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path, files):
    made, table = str(tmp_path / "made"), str(tmp_path / "docs.parquet")
    spark.range(9).selectExpr("cast(id as string) as id").repartition(files).write.parquet(made if files == 1 else table)
    if files == 1:
        next((tmp_path / "made").glob("part-*")).rename(table)
    stream = ingest.table_stream(spark, str(tmp_path), "docs")
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_streams_of_documents_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(n, "src", f"text {n}") for n in range(6)], "doc_id bigint, source string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    queries = contract.queries()
    assert rows(queries["stream_ingest"](spark, str(tmp_path)), "id") == [(str(n),) for n in range(6)]
    assert rows(queries["stream_entities"](spark, str(tmp_path)), "article_id") == [(str(n),) for n in range(6)]


def test_validation_without_usable_folds(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=n % 10) for n in range(200)]
    train = spark.createDataFrame([(str(n), day, "flat", f"word{n % 5} term{n % 7}") for n, day in enumerate(days)],
                                  "id string, aligned_date date, label string, text string")
    assert models.walk_forward(train, label_type="direction", single_split=False).collect() == []


def test_vectors_lie_in_as_many_partitions_as_a_learner_has_cores():
    assert models._parts(50_000, 12, 3) == 4 and models._parts(50_000, 12) == 12
    assert models._parts(3_000, 12) == 2 and models._parts(3_000_000, 12, 3) == 60 and models._parts(0, 12) == 1


def test_terms_are_cut_once_for_a_fit(spark, monkeypatch):
    train = spark.createDataFrame([(str(n), "HIGH" if n % 2 else "LOW", f"word{n % 5} term{n % 2}") for n in range(60)],
                                  "id string, label string, text string")
    written = []
    original = models.checkpointed
    monkeypatch.setattr(models, "checkpointed", lambda df: written.append(df.columns) or original(df))
    models.fit_text_model(train, "trees", trees=1, depth=1, top_k=5)
    assert ["id", "term", "tf"] in written


def test_similarity_matches_brute_force_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    corpus, asked = rng.normal(size=(200, 8)), rng.normal(size=(30, 8))
    text = "a long enough text"
    left = spark.createDataFrame([(i, text, [float(x) for x in v]) for i, v in enumerate(asked)]
                                 + [(99, "fourteen chars", [1.0] * 8)],
                                 "query_id bigint, text string, embedding array<double>")
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                  "vec_id bigint, embedding array<double>").repartition(5)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(asked) @ unit(corpus).T), axis=1)[:, :3]
    want = sorted((q, p + 1, int(v)) for q, line in enumerate(best) for p, v in enumerate(line))
    for block in (1024, 10):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = similar.find_similar(left, right)
        assert rows(got, "query_id", "position", "vec_id") == want


def test_index_finds_upserts_and_skips_the_odd(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    vectors = [(f"a{k:03}", [float(x) for x in centre[k % 6] + 0.2 * rng.normal(size=8)], k % 3) for k in range(300)]
    odd = [("none", None, 0), ("zero", [0.0] * 8, 0), ("nan", [float("nan")] * 8, 0), ("short", [1.0, 2.0], 0)]
    schema = "vec_id string, embedding array<double>, label int"
    path = str(tmp_path / "index")
    vector_index.build_index(spark.createDataFrame(vectors + odd, schema).repartition(3), path, lists=12, sample=200)
    asked = spark.createDataFrame([(i, v) for i, v, _ in vectors[::50]] + [("short", [2.0, 4.0]), ("zero", [0.0] * 8)], "query_id string, embedding array<double>")
    exact = vector_index.search_index(asked, path, probes=None)
    found = vector_index.search_index(asked, path, probes=4)
    assert vector_index.recall(found, exact).first()["recall"] >= 0.9

    def plain(table, q):
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        return sorted(table, key=lambda i: (-round(float(unit(table[i]) @ unit(q)), 12), i))[:3]

    table = {i: v for i, v, _ in vectors}
    want = sorted((i, p + 1, x) for i, v, _ in vectors[::50] for p, x in enumerate(plain(table, v)))
    assert rows(exact.filter("query_id not in ('short')"), "query_id", "position", "vec_id") == want
    # an id moves to another list, one is new, one is repeated within the batch; the same upsert twice changes nothing
    batch = spark.createDataFrame([("a000", [-x for x in vectors[0][1]], 7), ("new", vectors[0][1], 8), ("new", vectors[0][1], 5), (None, [1.0] * 8, 9)], schema)
    for _ in range(2):
        vector_index.upsert_index(batch, path)
        stored = {r["vec_id"]: r for r in vector_index.index_rows(spark, path).collect()}
        assert len(stored) == 305 == vector_index.index_rows(spark, path).count()
        assert stored["new"]["label"] == 8 and stored["a000"]["label"] == 7 and stored["none"]["list"] == -1
        keys = spark.read.parquet(f"{path}/keys")
        assert keys.count() == 305 and {(r["vec_id"], r["list"]) for r in keys.collect()} == {(i, r["list"]) for i, r in stored.items()}
    table |= {"a000": [-x for x in vectors[0][1]], "new": vectors[0][1]}
    first = spark.createDataFrame([("q", vectors[0][1])], "query_id string, embedding array<double>")
    assert [r[2] for r in rows(vector_index.search_index(first, path, probes=4), "query_id", "position", "vec_id")] == plain(table, vectors[0][1])
    # an upsert that empties a list, and queries of lists without rows
    alone = str(tmp_path / "alone")
    vector_index.build_index(spark.createDataFrame([("x", [1.0, 0.0], 0), ("y", [0.0, 1.0], 0)], schema), alone, lists=2)
    vector_index.upsert_index(spark.createDataFrame([("x", [0.1, 1.0], 1)], schema), alone)
    got = vector_index.search_index(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>"), alone, probes=None)
    assert rows(got, "position", "vec_id") == [(1, "x"), (2, "y")] and vector_index.index_rows(spark, alone).count() == 2
    empty = str(tmp_path / "empty")
    vector_index.build_index(spark.createDataFrame([], schema), empty)
    assert vector_index.search_index(first, empty).collect() == []


def test_upsert_reads_the_key_partitions_of_its_batch_only(spark, tmp_path):
    path = str(tmp_path / "index")
    data = [(k, [float(k % 7) + 1, float(k % 5)], 0) for k in range(500)]
    vector_index.build_index(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), path, lists=5)
    touched = vector_index.touched_lists(spark.createDataFrame([(3,), (9999,)], "vec_id long"), path)
    assert [r["vec_id"] for r in touched.collect()] == [3]
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket")


def test_hot_lists_are_cut_into_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 20)
    path = str(tmp_path / "index")
    data = [(k, [1.0, 1.0 + k / 1000], 0) for k in range(100)]
    vector_index.build_index(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), path, lists=1)
    asked = spark.createDataFrame([(1, [1.0, 1.05])], "query_id long, embedding array<double>")
    assert rows(vector_index.search_index(asked, path, probes=1), "position", "vec_id") == [(1, 50), (2, 51), (3, 49)]


def test_vote_tie_goes_to_the_first_voter(spark):
    df = spark.createDataFrame([(1, "d", "bearish"), (2, "d", "bullish"), (3, "d", None)],
                               "seq int, day string, v string")
    assert signals.majority_vote(df, ["day"], "v", "seq").first()["v"] == "bearish"


def test_folds_need_five_dates(spark):
    dates = [(D(2024, 1, d),) for d in range(1, 11)]
    df = spark.createDataFrame(dates, "aligned_date date")
    got = models.fold_bounds(df).orderBy("fold").collect()
    assert [(r["train_cutoff"].day, r["test_end"].day) for r in got] == [(3, 5), (5, 7), (7, 9), (9, 10)]
    assert models.fold_bounds(df.limit(4)).count() == 0


def test_ensemble_probabilities_sum_to_one(spark):
    data = [("a", m, c, p) for m in ("general", "wti") for c, p in (("HIGH", 0.2), ("LOW", 0.5), ("MEDIUM", 0.3))]
    scores = spark.createDataFrame(data, "article_id string, model string, class string, p double")
    weights = spark.createDataFrame([("wti", 0.7)], "model string, weight double")
    r = signals.ensemble(scores, weights).first()
    assert r["high_prob"] + r["medium_prob"] + r["low_prob"] == pytest.approx(1.0) and r["label"] == "LOW"


def desk_reports(spark, topics=("Refinery outage",)):
    """Forty days with a price report and six short articles each."""
    reports = []
    for n in range(40):
        date = dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
        price = 80 + (n * 7 % 11)
        body = f"Key benchmarks\nDubai (May) PCAAT00 {price}.5 {(n % 5) - 2}.25\nMarket commentary\nOPEC supply talk."
        reports.append((f"r{n}", f"OPEC report number {n} on supply", body, date, "Desk report"))
        reports += [(f"n{n}-{k}", f"{topics[k % len(topics)]} number {k} in the gulf", "short", date, "News") for k in range(6)]
    return spark.createDataFrame(reports, "id string, headline string, body_text string, published_at timestamp, report_name string")


def test_all_models_are_trained_stored_and_score_the_backfill(spark, tmp_path):
    desk = jobs.Desk(spark, str(tmp_path / "desk"))
    batch = desk_reports(spark, ("Refinery outage", "Brent cargo delay", "LNG terminal restart"))
    jobs.ingest_articles(desk, batch)
    jobs.price_job(desk)
    jobs.label_job(desk)
    market = spark.createDataFrame([], "date date, ticker string, price double")
    with pytest.raises(ValueError):
        jobs.score_job(desk, "2024-01-02", "2024-01-05")
    vectors = batch.select("id", F.array(F.length("headline").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    few = {"trees": 2, "depth": 2}
    view = jobs.full_training_job(desk, vectors, logistic={"max_iter": 3}, trees=few, embedding=few)
    got = {(r["model_type"], r["label_type"]): r for r in view.collect()}
    assert set(got) == {("logistic", "magnitude"), ("trees", "magnitude"), ("logistic", "direction")}
    assert all(r["n_folds"] == 4 and 0 <= r["accuracy_pct"] <= 100 for r in got.values())
    stored = {p.name for p in (tmp_path / "desk" / "models").iterdir()}
    assert {"general", "trees", "direction", "embedding"} < stored and stored & {"dubai", "brent", "lng"}
    scored = jobs.score_job(desk, "2024-01-02", "2024-01-05", vectors)
    rows_ = scored.collect()
    assert len(rows_) == 4 * 7 and {r["direction_vote"] for r in rows_} <= {"bullish", "bearish", "neutral", None}
    assert all(r["high_prob"] + r["medium_prob"] + r["low_prob"] == pytest.approx(1.0) and r["explanation"] and r["event_type"] for r in rows_)
    assert jobs.backfill_job(desk, market, "2024-01-02", "2024-01-11", vectors) > 0
    assert jobs.backfill_job(desk, market, "2024-01-02", "2024-01-11", vectors) == 0


def test_folds_with_shared_counts_equal_folds_fitted_alone(spark):
    start = D(2024, 1, 1)
    words = ["alpha", "beta", "gamma", "delta", "common"]
    data = [(f"d{k}", start + dt.timedelta(days=k // 12), ("HIGH", "LOW", "MEDIUM")[k % 3],
             f"{words[k % 3]} {words[(k * 7) % 5]} common word{k % 40} late{k // 100}", "general") for k in range(360)]
    train = spark.createDataFrame(data, "id string, aligned_date date, label string, text string, commodity_group string")
    for kind, how in (("logistic", {"max_iter": 4}), ("trees", {"trees": 2, "depth": 2, "top_k": 20})):
        together = models.walk_forward(train, kind, **how).collect()
        assert len(together) == 4
        for fold in together[1:2]:
            part = train.filter(F.col("aligned_date") <= F.lit(fold["train_cutoff"]))
            test = train.filter((F.col("aligned_date") > F.lit(fold["train_cutoff"])) & (F.col("aligned_date") <= F.lit(fold["test_end"])))
            alone = models.fit_text_model(part, kind, **{**models._VALIDATION, **how}).score(test)
            want = models.fold_metrics(alone, ["HIGH", "LOW", "MEDIUM"], "HIGH").first()
            assert [fold[c] for c in ("accuracy", "high_precision", "high_recall")] == pytest.approx([want[c] for c in want.asDict()])
    from newsignal.operators import features
    counts = features.term_counts(train, keep=["aligned_date"])
    cutoffs = [start + dt.timedelta(days=d) for d in (5, 11)]
    stats = {r["term"]: r["stats"] for r in features.stats_until(counts, "aligned_date", cutoffs).collect()}
    for k, cutoff in enumerate(cutoffs):
        alone = {r["term"]: (r["df"], r["total"]) for r in features.vocabulary(features.term_counts(train.filter(F.col("aligned_date") <= F.lit(cutoff))), 1, 1).collect()}
        assert {t: (x[k]["df"], x[k]["total"]) for t, x in stats.items() if x[k]["df"]} == alone


def test_logistic_validation_writes_no_row_per_term_and_document(spark, monkeypatch):
    start = D(2024, 1, 1)
    data = [(f"d{k}", start + dt.timedelta(days=k // 12), ("HIGH", "LOW", "MEDIUM")[k % 3], f"word{k % 3} common word{k % 40}") for k in range(360)]
    train = spark.createDataFrame(data, "id string, aligned_date date, label string, text string")
    written = []
    original = models.checkpointed
    monkeypatch.setattr(models, "checkpointed", lambda df: written.append(set(df.columns)) or original(df))
    assert len(models.walk_forward(train, max_iter=3).collect()) == 4
    assert {"id", "terms"} < set().union(*written) and not any({"id", "term"} <= columns for columns in written)


def test_vectors_made_inside_rows_equal_those_of_long_counts(spark):
    from newsignal.operators import features
    start = D(2024, 1, 1)
    texts = ["alpha beta alpha beta gamma", "beta \U0001d49c\U0001d49c zeta \uff5a\uff5a", None, "", "only once here", "alpha zeta alpha \U0001d49c\U0001d49c \uff5a\uff5a"]
    docs = spark.createDataFrame([(str(n), start + dt.timedelta(days=n), t) for n, t in enumerate(texts)], "id string, day date, text string")
    counts = features.term_counts(docs)
    vocab = features.vocabulary(counts, len(texts), max_features=6).cache()
    terms = sorted({r["term"] for r in counts.collect()})  # more than the vocabulary knows
    got = {r["id"]: r["text_vector"] for r in features.weighted_vectors(features.term_vectors(docs, terms).drop("text"), terms, vocab, 6).collect()}
    want = {r["id"]: r["text_vector"] for r in features.text_vectors(features.tfidf(counts, vocab), 6).collect()}
    assert set(got) == {str(n) for n in range(len(texts))} and {i for i, v in got.items() if v.numNonzeros()} == set(want)
    for i, vector in want.items():
        assert list(got[i].indices) == list(vector.indices) and list(got[i].values) == pytest.approx(list(vector.values))
    dated, cutoffs = features.term_counts(docs, keep=["day"]), [start, start + dt.timedelta(days=4)]
    long = {r["term"]: r["stats"] for r in features.stats_until(dated, "day", cutoffs).collect()}
    assert long == {r["term"]: r["stats"] for r in features.text_stats_until(docs, "day", cutoffs).collect() if r["term"] in long}


def test_jobs_run_end_to_end(spark, tmp_path):
    desk = jobs.Desk(spark, str(tmp_path / "desk"))
    batch = desk_reports(spark)
    reports = batch.collect()
    jobs.ingest_articles(desk, batch)
    jobs.ingest_articles(desk, batch)
    assert desk.read("articles").count() == len(reports)
    assert jobs.price_job(desk).first()["n_days"] == 40
    shares = jobs.label_job(desk)
    assert shares.agg(F.sum("n")).first()[0] == len(reports)
    assert jobs.entity_job(desk) == len(reports) and jobs.entity_job(desk) == 0
    scored = desk.read("articles").select(
        F.to_date("published_at").alias("day"), "id", F.xxhash64("id").alias("seq"), "headline",
        F.lit(0.6).alias("high_prob"), F.lit("bullish").alias("direction_vote"))
    market = spark.createDataFrame([], "date date, ticker string, price double")
    logged = jobs.signal_job(desk, scored, market, "2024-01-01", "2024-02-05")
    assert logged == 36 * 4
    assert jobs.signal_job(desk, scored, market, "2024-01-01", "2024-02-05") == 0
    result = jobs.settlement_job(desk, market, "2024-03-01").first()
    assert result["total_predictions"] == logged and result["total_trades"] > 0
    late = spark.createDataFrame([("z1", "Late", "x", dt.datetime(2024, 3, 1), "News")], batch.schema)
    assert jobs.daily_job(desk, late, market, "2024-03-01") == "ERROR"


def test_daily_counts_keep_late_and_last_days(spark, tmp_path):
    source, table, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a")], "ts timestamp, kind string").schema
    for days in ((1, 1, 9), (2, 1, 9)):  # the second run brings rows that a watermark would drop
        rows_ = [(dt.datetime(2024, 1, d, 5), "a") for d in days]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.count_daily(ingest.file_stream(spark, source, schema), table, state, "ts", "kind").awaitTermination()
    got = ingest.daily_counts(spark, table, "day date, kind string, n bigint", "kind")
    assert rows(got, "day", "n") == [(D(2024, 1, 1), 3), (D(2024, 1, 2), 1), (D(2024, 1, 9), 2)]


def test_catch_up_keeps_all_batches_and_refills(spark, tmp_path):
    desk = jobs.Desk(spark, str(tmp_path / "desk"))
    schema = "id string, title string, headline string, body_text string, published_at timestamp, report_name string"
    day = dt.datetime(2024, 1, 5)

    def batch(*items):
        return spark.createDataFrame([(i, "T", h, b, day, "News") for i, h, b in items], schema)

    prices_ = spark.createDataFrame([(D(2024, 1, d), "Dubai", 80.0 + d, 1.0) for d in range(2, 12)], "date date, symbol string, price double, pct_change_24h double")
    desk.upsert("prices", prices_, ["date", "symbol"], "symbol")
    filled = jobs.catch_up_job(desk, [
        batch(("a", "One", "body a")), batch(("b", "Two", "")), batch(("c", "Three", "body c"), ("b", "Other", "body b"), ("a", "x", "late"))])
    assert filled == 3
    stored = {r["id"]: (r["headline"], r["body_text"]) for r in desk.read("articles").collect()}
    assert stored == {"a": ("One", "body a"), "b": ("Two", "body b"), "c": ("Three", "body c")}
    assert desk.read("labelled_articles").count() == 3


def test_upsert_reads_only_the_partitions_of_the_batch(spark, tmp_path):
    from newsignal.sources import sinks
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, part string").write.partitionBy("part").parquet(path)
    batch = spark.createDataFrame([("a", 5, "x")], "id string, n int, part string")
    plan = sinks._touched(spark.read.parquet(path), batch, "part")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "x" in plan.split("PartitionFilters")[1][:60]
    sinks.upsert_partitions(batch, path, ["id", "part"], [F.lit(1)], "part")
    assert rows(spark.read.parquet(path).select("id", "n", "part"), "id", "n", "part") == [("a", 5, "x"), ("b", 2, "y")]


def test_every_document_of_a_landing_folder_is_accounted_for(spark, tmp_path):
    from newsignal.sources import landing
    folder = tmp_path / "landed"
    (folder / "deep").mkdir(parents=True)
    body = "Crude supply stays tight. " * 8
    files = {
        "ABC-1.json": '{"envelope": {"data": {"headline": " Title ", "updatedDate": "2024-02-03T04:05:06.789Z", "body": {"text": "%s"}}}, "documentUrl": "u/1"}' % body,
        "deep/two.json": '{"id": " Own-Id ", "title": ["a", "", {"value": "b"}], "publishedDate": "2024-01-01", "content": "short"}',
        "three.json": '{"envelope": {"data": "text", "package": {"title": "From package"}, "properties": {"coverDate": "2023-12-31"}}}',
        "empty.json": "  \n", "cut.json": '{"id": "x", "title": "cut', "list.json": '[{"id": "x"}]', "number.json": "17", "none.json": "{}"}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    documents = landing.read_documents(spark, str(folder))
    assert documents.count() == len(files)
    assert rows(landing.quarantine(documents), "file_name", "problem") == [
        ("cut.json", "broken"), ("empty.json", "empty"), ("list.json", "no object"), ("number.json", "no object")]
    got = {r["id"]: r for r in landing.normalise_documents(documents).collect()}
    assert set(got) == {"abc-1", "own-id", "three", "none"}
    assert (got["abc-1"]["headline"], got["abc-1"]["published"], got["abc-1"]["url"]) == ("Title", "2024-02-03T04:05:06", "u/1")
    assert got["abc-1"]["body_text"].startswith("Crude supply") and got["own-id"]["body_text"] == ""
    assert got["own-id"]["headline"] == "a\nb" and got["three"]["headline"] == "From package" and got["three"]["published"] == "2023-12-31"
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "all.jsonl").write_text('{"id": "1", "title": "t"}\n\n{"title": "no id"}\n{"id": "2"', encoding="utf-8")
    read = landing.read_documents(spark, str(lines), lines=True)
    assert {(r["id"], r["problem"]) for r in read.collect()} == {(None, "broken"), (None, "empty"), (None, "no id"), ("1", None)} and read.count() == 4


def test_unreadable_table_is_an_error(spark, tmp_path):
    from newsignal.sources import sinks
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        sinks.append_absent(spark.createDataFrame([("a",)], "id string"), str(broken), ["id"], [F.col("id")])


def test_long_rule_tables_match_like_short_ones(spark):
    from newsignal.functions import rules
    texts = spark.createDataFrame([("1", "gas and oil"), ("2", "oil"), ("3", ""), ("4", None), ("5", "ga"), ("5", "ga"), ("5", "other"), (None, "gas"),
                                   (None, "oil"), ("6", "crude 😀oil"), ("7", "a longer keyword in a text")], "id string, t string")
    listed = [(3, "oil", "c"), (1, "gas", "a"), (1, "and", "b"), (2, "ga", "g"), (9, "zz", "z"), (3, "oil", "c"), (2, "longer keyword", "l"), (0, None, "n")]
    for extra, empty in (([], "none"), ([(5, "", "e")], "e")):
        table = spark.createDataFrame(listed + extra, "rule_order int, keyword string, value string")
        want = sorted([("1", "b"), ("2", "c"), ("3", empty), ("4", "none"), ("5", "g"), ("5", "g"), ("5", empty), (None, "a"), (None, "c"), ("6", "c"), ("7", "l")], key=str)
        for most in (5000, 2):
            got = rules.match_rule_table(texts, F.col("t"), table, "none", max_rules=most)
            assert got.columns == ["id", "t", "matched"]
            assert sorted([(r["id"], r["matched"]) for r in got.collect()], key=str) == want
    assert {r["matched"] for r in rules.match_rule_table(texts, F.col("t"), table.limit(0), "none").collect()} == {"none"}


def test_appends_read_the_key_buckets_of_their_batch_only(spark, tmp_path, monkeypatch):
    from newsignal.sources import key_table, sinks
    monkeypatch.setattr(key_table, "KEYS_PER_BUCKET", 20)
    assert [key_table.buckets_for(n) for n in (0, 1, 20, 21, 40, 41, 10**6)] == [1, 1, 1, 2, 2, 4, 4096]
    path = str(tmp_path / "table")

    def batch(*pairs):
        return spark.createDataFrame(list(pairs), "id string, n int")

    def stored():
        return rows(spark.read.parquet(path), "id", "n")

    for _ in range(2):
        sinks.append_absent(batch(*[(f"k{k}", k) for k in range(1000)]), path, ["id"], [F.col("n")])
        assert spark.read.parquet(path).count() == 1000
    known = key_table.known_keys(batch(("k5", 0), ("new", 1)), path, ["id"])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    assert known.count() < 100 < 1000 == spark.read.parquet(f"{path}.keys/buckets").count()
    sinks.append_absent(batch(("k5", -1), ("new", 1), ("new", 2)), path, ["id"], [F.col("n")])
    # files of another writer, or of a run that ended before its keys were known
    batch(("foreign", 7)).write.mode("append").parquet(path)
    sinks.append_absent(batch(("foreign", 8), ("last", 9)), path, ["id"], [F.col("n")])
    assert [r for r in stored() if not r[0].startswith("k")] == [("foreign", 7), ("last", 9), ("new", 1)] and ("k5", 5) in stored()
    # a table that was rewritten
    batch(("a", 1)).write.mode("overwrite").parquet(path)
    sinks.append_absent(batch(("a", 2), ("k5", 3)), path, ["id"], [F.col("n")])
    assert stored() == [("a", 1), ("k5", 3)]
    # a table that outgrows its buckets gets more of them
    sinks.append_absent(batch(*[(f"g{k}", k) for k in range(900)]), path, ["id"], [F.col("n")])
    assert key_table.catch_up(spark, path, ["id"]) == 64
    sinks.append_absent(batch(("g7", -1), ("z", 1)), path, ["id"], [F.col("n")])
    assert spark.read.parquet(path).count() == 903 and ("g7", 7) in stored()


def test_tree_models_give_probabilities_and_survive_storage(spark, tmp_path):
    data = [(str(k), ("HIGH", "LOW", "MEDIUM")[k % 3], f"{('up', 'down', 'flat')[k % 3]} market report {k % 7}", float(k % 5)) for k in range(60)]
    train = spark.createDataFrame(data, "id string, label string, text string, n double")
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    model = models.fit_text_model(train, "trees", ["n"], top_k=10, trees=3, depth=2)
    models.save_model(model, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    a, b = (rows(m.score(train), "id", "prediction", "p_HIGH", "p_LOW", "p_MEDIUM") for m in (model, loaded))
    assert a == b and all(sum(r[2:]) == pytest.approx(1.0) for r in a)
    assert sum(r[1] == ("HIGH", "LOW", "MEDIUM")[int(r[0]) % 3] for r in a) >= 57
    scores = models.long_scores({"embedding": loaded}, train)
    weights = spark.createDataFrame([], "model string, weight double")
    asked = spark.createDataFrame([("0",), ("none",)], "id string")
    got = {r["article_id"]: r for r in signals.ensemble(scores, weights, articles=asked).collect()}
    assert got["none"]["label"] == "LOW" and got["none"]["high_prob"] == pytest.approx(0.33) and got["0"]["label"] == "HIGH"
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == cached  # fitting leaves nothing behind


def test_large_lexicons_give_the_same_sentiment(spark, monkeypatch):
    from newsignal.operators import entities
    articles = spark.createDataFrame([("1", "good good bad day"), ("2", "plain"), ("3", None)], "id string, headline string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -0.5), ("day", None)], "word string, polarity double")
    small = rows(entities.lexicon_sentiment(articles, lexicon), "id", "sentiment")
    monkeypatch.setattr(entities, "MOST_WORDS", 1)
    assert rows(entities.lexicon_sentiment(articles, lexicon), "id", "sentiment") == small == [("1", 0.5), ("2", 0.0), ("3", 0.0)]


def test_training_rows_without_text_are_those_with_text(spark):
    """The short test of an article is that of its text, and bodies are cleaned only where the headline does not decide."""
    prose = "The refinery returned from maintenance and supply of crude stays tight this week. " * 8
    heads = ["Cargo of crude leaves the port", "   ", "", None, "Daily", "short", " Refinery outage cuts supply "]
    rows = [(h, b) for h in heads for b in [prose, "brief", "", None, "12 34 56"]]
    found = spark.createDataFrame(rows, "headline string, body string").select(
        (F.size(models.usable_text(F.col("body"), F.col("headline"))) > 0).alias("full"),
        models.is_usable(F.col("body"), F.col("headline")).alias("short")).collect()
    assert all(r["full"] == r["short"] for r in found) and {r["full"] for r in found} == {True, False}


def test_narrow_training_queries_read_the_texts_once(spark, monkeypatch):
    from newsignal.plans import models as plans
    asked = []
    real = plans._training
    monkeypatch.setattr(plans, "_training", lambda *a, **k: asked.append(k) or real(*a, **k))
    for query in (plans.group_training_sets, plans.numeric_scaling):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in plan and "text" not in plan, query.__name__
    assert asked == [{"texts": False}] * 2


def test_keyed_writes_put_a_month_into_few_files(spark, tmp_path):
    """Not one file per task and folder."""
    batch = spark.range(400).selectExpr("cast(id as string) as id", "concat('m', id % 5) as month", "'x' as body").repartition(8)
    paths = [str(tmp_path / "appended"), str(tmp_path / "upserted")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            sinks.append_absent(batch, paths[0], ["id"], [F.col("body")], "month")
        sinks.upsert_partitions(batch, paths[1], ["id", "month"], [F.lit(1)], "month")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for path in paths:
        stored = spark.read.parquet(path)
        assert stored.count() == 400 and len(stored.inputFiles()) == 5


def test_price_job_parses_reports_once(spark, tmp_path, monkeypatch):
    desk = jobs.Desk(spark, str(tmp_path / "desk"))
    given = []
    real = jobs.Desk.upsert
    monkeypatch.setattr(jobs.Desk, "upsert", lambda self, name, batch, *a: given.append((name, batch.inputFiles())) or real(self, name, batch, *a))
    jobs.ingest_articles(desk, contract.queries()["clean_reports"](spark, "/root/testdata/sf0.001").selectExpr(
        "cast(id as string) as id", "date'1995-01-02' as published_at", "'Daily oil report\nKey benchmarks\nBrent (Dated) PCAAS00 71.5 0.1' as body_text"))
    jobs.price_job(desk)
    assert [name for name, _ in given] == ["prices"] and all("/cut-" in file for file in given[0][1])

def _few(spark):
    words = ["alpha", "beta", "gamma", "delta", "common"]
    data = [(f"d{k}", ("HIGH", "LOW", "MEDIUM")[k % 3], f"{words[k % 3]} {words[(k * 7) % 5]} common word{k % 40}",
             ("oil", "general", "gas")[k % 3 if k % 7 else 1], float(k % 5)) for k in range(120)]
    data += [("d3", "HIGH", "alpha again", "general", 9.0), ("d4", "LOW", "beta again", "gas", 2.0), (None, "LOW", "beta nobody", "general", 1.0)]
    return spark.createDataFrame(data, "id string, label string, text string, commodity_group string, n double")


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_models_on_counted_rows_equal_models_on_long_counts(spark, kind, monkeypatch):
    """No row per document and term is written, and every row gets its scores, whether its id repeats or is null."""
    from newsignal.operators import features
    how = {"max_iter": 5} if kind == "logistic" else {"trees": 2, "depth": 2, "top_k": 12}
    for train, unique in ((_few(spark).filter("id is not null and text not like '%again'"), True), (_few(spark), False)):
        written = []
        original = models.checkpointed
        with monkeypatch.context() as patch:
            patch.setattr(models, "checkpointed", lambda df: written.append(set(df.columns)) or original(df))
            vocab = models.numbered_vocabularies(features.term_counts(train), train.count(), [models.fv.LOGISTIC_MAX_FEATURES, 7])[0]
            counted, terms = models.counted_rows(train, [vocab])
            fitted = models.fit_text_model(counted, kind, ["n"], vocab=vocab, terms=terms, **how)
        assert not any({"id", "term"} <= columns for columns in written)
        found = sorted(map(tuple, fitted.score(counted, terms=terms).select("id", "label", "prediction", "p_HIGH", "p_LOW", "p_MEDIUM").collect()), key=str)
        assert [r[:2] for r in found] == sorted(map(tuple, train.select("id", "label").collect()), key=str)
        assert all(sum(r[3:]) == pytest.approx(1.0) for r in found)
        if unique:
            alone = models.fit_text_model(train, kind, ["n"], **how)
            a, b = ({(r["term"], r["idx"], round(r["idf"], 9)) for r in m.vocab.collect()} for m in (fitted, alone))
            assert a == b
            want = sorted(map(tuple, alone.score(train).select("id", "label", "prediction", "p_HIGH", "p_LOW", "p_MEDIUM").collect()), key=str)
            if kind == "logistic":  # the rows that a tree draws depend on their order
                assert all(x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-6) for x, y in zip(found, want))


def test_group_models_on_counted_rows(spark):
    """Vocabularies, training rows and scores of the groups are those that each group has alone."""
    from newsignal.operators import features
    train, groups = _few(spark), ["oil", "gas", "none", "general"]
    again = models.repeated(train)
    assert {r["id"] for r in again.collect()} == {"d3", "d4"}
    for group in groups:
        a, b = (sorted((r["id"] or "", r["commodity_group"]) for r in found.collect()) for found in (
            models.group_training_set(train, group, again), models.group_training_set(train, group)))
        assert a == b
    once = train.filter("id is not null and text not like '%again'")
    vocabs = models.group_vocabularies(once, groups, again)
    plain = models.group_models(once, groups, max_iter=3)
    counted, terms = models.counted_rows(once, list(vocabs.values()))
    got = models.group_models(counted, groups, vocabs=vocabs, terms=terms, again=models.repeated(once), max_iter=3)
    assert list(got) == list(plain) == [g for g in groups if g in vocabs]
    for group in got:
        a, b = ({r["term"]: (r["idx"], round(r["idf"], 9)) for r in m[group].vocab.collect()} for m in (got, plain))
        assert a == b
    a, b = (sorted(map(tuple, s.collect())) for s in (models.long_scores(got, counted, terms=terms), models.long_scores(plain, once)))
    assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b], abs=1e-6)
    twice = counted.unionByName(counted)
    means = models.long_scores(got, twice, terms=terms, again=models.repeated(twice)).groupBy("article_id", "model").agg(F.sum("p").alias("p"))
    assert all(r["p"] == pytest.approx(1.0) for r in means.collect())
