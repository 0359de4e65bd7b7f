import numpy as np
import pytest
from pyspark.sql import functions as F

from tsrisk.llm import language_id as L
from tsrisk.llm.queries import QUERIES

EN, DE = "the house and the garden of the king", "der garten und das haus des königs"


@pytest.fixture(scope="module")
def model(docs_of):
    rows = [(i, EN, "en") for i in range(20)] + [(i, DE, "de") for i in range(20, 40)]
    rows += [(50, "кошка и собака", "ru"), (51, None, "en"), (52, "nothing", None), (53, EN, "en"), (53, EN, "en")]
    return L.fit(docs_of(*rows), F.lit(True))


def found(docs, model):
    return {r.doc_id: r for r in L.identify(docs, model).collect()}


def test_edges(docs_of, model):
    got = found(docs_of((1, EN), (2, None), (3, ""), (4, "123 ***"), (5, DE.upper()), (6, "собака"), (7, EN * 20_000)), model)
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "und", "und", "und", "de", "ru", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0 and got[3].spans == []
    assert model.langs == ["de", "en", "ru"]


def test_mixed_text_has_a_span_for_each_language(docs_of, model):
    text = f"{EN}. {EN}! {DE}, {DE}"
    spans = found(docs_of((1, text)), model)[1].spans
    assert [s.lang for s in spans] == ["en", "de"]
    assert text[spans[1].start :].startswith("der garten") and spans[1].end == len(text)


def test_columns_of_any_name_are_carried(docs_of, model):
    docs = docs_of((1, EN)).withColumn("a b.c`d", F.array(F.lit(1))).withColumn("lang_pred", F.lit("x"))
    row = L.identify(docs, model, ("doc_id", "a b.c`d", "spans")).first()
    assert tuple(row)[:3] == (1, [1], 1) and row[3] == "en"


def test_empty_tables_and_repeated_rows(docs_of, model):
    assert L.identify(docs_of((1, EN)).limit(0), model).count() == 0
    nothing = L.fit(docs_of((1, EN)).limit(0), F.lit(True))
    assert [r.lang_pred for r in L.identify(docs_of((1, EN), (1, EN)), nothing).collect()] == ["und", "und"]


def test_shortcut_equals_viterbi():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 40, 200)
    scores = rng.normal(size=(int(words.sum()), 3)) * 3
    scores[:, 0] += np.repeat(rng.random(200) < 0.5, words) * 4
    got = L.label_words(scores, words, 6.0)
    start = 0
    for n in words:
        own = scores[start : start + n]
        if n:
            best = np.full((n, 3), -np.inf)
            best[0] = own[0]
            for t in range(1, n):
                best[t] = own[t] + np.maximum(best[t - 1], best[t - 1].max() - 6.0)
            label = got[start : start + n]
            value = own[np.arange(n), label].sum() - 6.0 * (np.diff(label) != 0).sum()
            assert value == pytest.approx(best[-1].max())
        start += n


def test_query_on_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op10_language_id"](spark, folder)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count() > 0
