import __spark_entry__ as contract
import corpus_pipeline
import plain
from newsignal.llm import mixture, pii, quality

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).filter("score >= 0.5").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in good), key=lambda r: r["doc_id"])
    sets = [plain.shingles(r["text"]) for r in rows]
    named = plain.components([r["doc_id"] for r in rows], lambda i, j: plain.near(sets[i], sets[j]))
    originals = rows = [r for r, c in zip(rows, named) if r["doc_id"] == c]
    clean = plain.decontamination([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [(r["doc_id"], pii.masked(r["text"]), r["source"]) for r, hit in zip(rows, clean) if not hit[5]]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets = plain.targets(sizes)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {k: t for k, t, _ in rows}
    before = docs.filter(docs.doc_id.isin(sorted(good)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, before, FOLDER).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in originals}
    # what reaches the mixture is exactly what the stages before it keep; the mixture takes whole documents of it
    size_of = {r["doc_id"]: r["size"] for r in mixture.mixed_sizes(spark.createDataFrame(
        [(k, t, s) for k, t, s in rows], "doc_id long, text string, source string")).collect() if r["taken"]}
    assert set(got) == set(size_of) and len(got) > 20
    longest = max(len(t.split()) for t in texts.values())
    taken = dict.fromkeys(sizes, 0)
    for k, r in got.items():
        assert r["text"] == texts[k] and r["n_chars"] == len(r["text"]) and r["taken"] == r["copies"] * r["size"] > 0
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0 and empty.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0
    assert mixture.mixed_documents(docs).columns[:5] == docs.columns


def test_all_queries_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
