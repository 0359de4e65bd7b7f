import corpus_pipeline
from pyspark.sql import functions as F

from tsrisk.llm import decontaminate, near_dedup, secrets
from tsrisk.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, folder).cache()
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "source_mix":
            assert docs.columns == COLUMNS
    kept = near_dedup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).filter("kept")
    assert seen["near_dedup"] == {r.doc_id for r in kept.collect()}
    assert not any(secrets.all_spans(r.text) for r in docs.collect())
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.find_leaks(docs.select("doc_id", "text"), bench).filter(F.size("hits") > 0).count() == 0
    result = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.taken) for r in result.collect()) == sorted((r.doc_id, r.taken) for r in docs.collect())


def test_edges(spark, folder, docs_of):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "one good text with several words"), (4, "one good text with several words"), (5, "One good TEXT with several words")]
    rows += [(None, "an unnamed text with words of its own"), (6, "another text that stands alone here", None, None), (None, "one good text with several words")]
    full = docs_of(*rows).select(*COLUMNS)
    for start in (full, full.limit(0)):
        docs = start
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, folder)
        ids = sorted((r.doc_id or -1) for r in docs.collect())
        assert ids == ([-1, 4, 6] if start is full else [])
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert {r.doc_id or -1 for r in mixed} <= set(ids) and all(0 < r.taken <= 3 * r["size"] for r in mixed)


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
