import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tsrisk.llm import ranked_search as rs
from tsrisk.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """Scores by the formula, without an index; rows of `item_id, rank, doc_id, score`."""
    split = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, own in split:
            m = 75 + (25 * sum(own.values()) * n) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * own[w]) // (1000 * own[w] + 12 * m))
                for w, r in asked.items() if own[w]
            )
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort()
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(found[:k])]
    return sorted(out, key=str)


def items_of(spark, *rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, score int, item int")


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ties_repeats_nulls_and_signs(spark, docs_of):
    docs = [(1, "Red fox"), (2, "red FOX"), (2, "red fox"), (3, None), (4, ""), (5, "... !"), (None, "red fox"), (6, "red"), (7, "Ä naïve fox_fox"), (8, "dog " * 50)]
    items = [(1, "red, fox? fox"), (1, "red, fox? fox"), (2, None), (3, "--"), (4, "unseen"), (5, "ä Ä naïve"), (None, "dog")]
    for k in (1, 2, 3, 20):
        found = rs.search(docs_of(*docs).repartition(3), items_of(spark, *items), k)
        assert got(found) == brute(docs, items, k)


def test_text_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 1), ("c", "z", 1)], "doc_id string, text string, n int")
    found = rs.search(docs, items_of(spark, (9, "x")), 1)
    assert [(r.item_id, r.rank, r.doc_id) for r in found.collect()] == [(9, 1, "a")]


def test_empty_tables(spark, docs_of):
    some, none = docs_of((1, "a b")), items_of(spark, (1, "a")).limit(0)
    assert got(rs.search(some, none)) == [] == got(rs.search(some.limit(0), items_of(spark, (1, "a"))))
    assert rs.search(some, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text_item_blocks_and_small_slices(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for i in range(300)]
    docs.append((400, " ".join(rng.choices(words, k=200_000))))
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)]
    monkeypatch.setattr(rs, "BLOCK_BYTES", 100)
    monkeypatch.setattr(rs, "SLICE_POSTINGS", 200)
    assert got(rs.search(docs_of(*docs).repartition(4), items_of(spark, *items), 5)) == brute(docs, items, 5)


@pytest.mark.parametrize("seed", range(5))
def test_fewer_accumulators_same_scores(seed):
    """Frequent terms come last and make no accumulators once rarer ones decide; scores equal the dense sums."""
    rng = np.random.default_rng(seed)
    rows, vocabulary = 2000, 12
    share = np.array([0.01] * 6 + [0.3, 0.5, 0.7, 0.8, 0.9, 0.95])
    tf = (rng.random((rows, vocabulary)) < share) * rng.integers(1, 5, (rows, vocabulary))
    sizes = tf.sum(axis=1) + 5
    at, term = np.nonzero(tf)
    corpus = rs.Corpus(rows, int(sizes.sum()), (tf > 0).sum(axis=0))
    lists = rs.Lists(sizes, (tf > 0).sum(axis=1), term, tf[at, term], corpus)
    item = rs.ask(list(range(vocabulary)) + [0, 1], corpus, corpus.weights())
    dense = np.zeros(rows, np.int64)
    for t, w in zip(item.terms, item.worth):
        own, gains = lists.of(t)
        dense[own] += gains * w
    found, scores = rs.accumulate(lists, item, 5)
    assert (scores == dense[found]).all()
    assert set(np.flatnonzero(dense >= np.sort(dense)[-5])) <= set(found)
    assert len(found) < rows / 4


def test_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_ranked_search"](spark, folder)) == brute(docs, items)
