"""Ranked lexical search: term at a time with a limited number of accumulators.

A first scan writes the index: for each document its length and, for each term that any item asks for, the
term's occurrences. A second step reads it in slices, turns each slice into posting lists, and runs every item
over them, rarest term first. A document gets an accumulator when a list first names it, until the bounds of
the lists still to come cannot lift a new document to the k-th best score known so far; from there on the
remaining lists only update the accumulators that exist, so their scores end exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import binary, by_bytes, kept, ship
from tsrisk.session import stage, unstage

#: Bytes of item texts that are asked at a time; more items take more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Postings that a slice of the index holds in memory; a single document is never cut.
SLICE_POSTINGS = 2_000_000
#: Fixed values of the score: saturation 1.2, length weight 0.25, weights and scores in thousandths.
SCALE, SATURATION, LENGTH_PERCENT = 1000, 12, 25

#: A-Z become a-z; every other ASCII byte that is no letter or digit becomes a blank. UTF-8 stays UTF-8.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats; null has none."""
    return text.translate(_PLAIN).split() if text else []


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and for each asked term the documents that hold it."""

    documents: int
    terms: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        n = 2 * self.documents + 2
        return np.array([math.floor(SCALE * math.log(n / (2 * int(f) + 1))) for f in self.frequency], dtype=np.int64)

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * self.documents) // max(1, self.terms)


@dataclass(frozen=True)
class Item:
    """The terms of an item, rarest first, and what one unit of each is worth: its weight times its repeats."""

    terms: np.ndarray
    worth: np.ndarray


def ask(terms: Sequence[int], corpus: Corpus, weights: np.ndarray) -> Item:
    own, repeats = np.unique(np.array(terms, dtype=np.int64), return_counts=True)
    order = np.lexsort((own, corpus.frequency[own]))
    return Item(own[order], (weights[own] * repeats)[order])


class Lists:
    """Posting lists of a slice: for each term the rows that hold it and their saturated occurrences."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, corpus: Corpus) -> None:
        self.rows = len(sizes)
        rows = np.repeat(np.arange(self.rows), counts)
        factor = corpus.length_factor(sizes.astype(np.int64))
        gains = (1_000_000 * SCALE * tf.astype(np.int64)) // (SCALE * tf.astype(np.int64) + SATURATION * factor[rows])
        order = np.argsort(terms, kind="stable")
        self._rows, self._gains = rows[order], gains[order]
        self._begin = np.searchsorted(terms[order], np.arange(len(corpus.frequency) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._begin[term], self._begin[term + 1]
        return self._rows[a:b], self._gains[a:b]


def accumulate(lists: Lists, item: Item, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the `k` best with their exact scores; every row of a better or equal score is there.

    `least` is a score that the k-th best is known to reach. A list's bound is the
    most that it adds to any row of the slice. Once the bounds of this and all later lists
    together stay below the k-th best partial score, a row without an accumulator
    has no way into the result, not even by a tie.
    """
    asked = [(*lists.of(t), w) for t, w in zip(item.terms.tolist(), item.worth.tolist()) if w > 0]
    asked = [(rows, gains * worth) for rows, gains, worth in asked if len(rows)]
    bounds = np.array([gains.max() for _, gains in asked], dtype=np.int64)
    left = np.cumsum(bounds[::-1])[::-1]
    scores = np.zeros(lists.rows, dtype=np.int64)
    exists = np.zeros(lists.rows, dtype=bool)
    creating = True
    for (rows, gains), bound in zip(asked, left.tolist()):
        if creating and bound < least:
            creating = False
        if not creating:
            own = exists[rows]
            scores[rows[own]] += gains[own]
            continue
        scores[rows] += gains
        exists[rows] = True
        if lists.rows >= k:
            least = max(least, int(np.partition(scores, lists.rows - k)[lists.rows - k]))
    found = np.flatnonzero(scores >= least)
    return found, scores[found]


def _index(docs: DataFrame, doc_id: str, number: dict[bytes, int]) -> DataFrame:
    """A staged row a document that has terms: its id, its number of terms, the asked terms it holds and how often."""
    selected, names, fields, _ = kept(docs, [doc_id])
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in by_bytes(batches, "text"):
            sizes, counts, terms, tf = [], [], [], []
            for text in binary(batch.column("text")):
                words = terms_of(text)
                own = Counter(map(get, words))
                own.pop(None, None)
                sizes.append(len(words))
                counts.append(len(own))
                terms.extend(own.keys())
                tf.extend(own.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(names[0]), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                ],
                names=[names[0], "n", "terms", "tf"],
            )

    schema = T.StructType([*fields, *T.StructType.fromDDL("n long, terms array<int>, tf array<int>")])
    rows = docs.select(*selected, F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(run, schema).filter(F.col("n") > 0), "rs-index")


def _corpus(index: DataFrame, asked: int) -> Corpus:
    documents, terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = np.zeros(asked, dtype=np.int64)
    for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[term] = count  # a row for each term that the block's items hold
    return Corpus(documents, terms or 0, frequency)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_POSTINGS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _search(batches: Iterable[pa.RecordBatch], items: Sequence[Item], corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    """The `k` best of one task for each item. Equal scores are told apart by id, null ids last."""
    best: list[list[tuple]] = [[] for _ in items]
    kind = None
    for batch in _slices(batches):
        kind = batch.schema.field(0).type
        ids = batch.column(0).to_pylist()
        by_id = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r]))
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        flat = [batch.column(c).flatten().to_numpy() for c in ("terms", "tf")]
        counts = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        lists = Lists(batch.column("n").to_numpy(), counts, *flat, corpus)
        for number, item in enumerate(items):
            held = best[number]
            rows, scores = accumulate(lists, item, k, -held[-1][0] if len(held) == k else 1)
            top = np.lexsort((place[rows], -scores))[:k]
            new = [(-int(s), ids[r] is None, ids[r]) for s, r in zip(scores[top].tolist(), rows[top].tolist())]
            if new:
                best[number] = sorted(held + new)[:k]
    if kind is not None:
        found = [(n, i, -s) for n, own in enumerate(best) for s, _, i in own]
        numbers, ids, scores = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())],
            names=["item", "keep_0", "score"],
        )


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` documents of the highest score above 0 for every row of `items`.

    Both tables need a column `text`, which is read whole; ids are of any type that has
    an order. Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z
    count as a-z. Equal scores go to the smaller document id, null ids last. Repeated
    documents count and rank as rows of their own; repeated items are answered each.
    Items without a term (null, empty, signs only), or whose terms no document holds,
    give no row, and neither do documents without a term. An empty table on either side gives an empty result.
    Other columns play no part. Items come to the driver in blocks of BLOCK_BYTES of text.
    """
    ship(docs)
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    _, _, fields, named = kept(docs, [doc_id])
    schema = T.StructType([T.StructField("item", T.LongType()), *fields, T.StructField("score", T.LongType())])
    result = T.StructType([asked.schema["item_id"], *T.StructType.fromDDL("rank int"), *fields, T.StructField("score", T.LongType())])
    results = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        words = [terms_of(r.text.encode("utf-8", "surrogatepass")) for r in rows]
        number = {w: i for i, w in enumerate(sorted(set().union(*words)))} if words else {}
        if not number:
            continue
        index = _index(docs, doc_id, number)
        corpus = _corpus(index, len(number))
        weights = corpus.weights()
        shared = spark.sparkContext.broadcast(([ask([number[w] for w in own], corpus, weights) for own in words], corpus))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, *shared.value, k)

        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("keep_0"))
        best = index.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)],
            T.StructType([T.StructField("item", T.LongType()), asked.schema["item_id"]]),
        )
        results.append(stage(best.join(names, "item").select("item_id", "rank", "keep_0", "score"), "rs-found"))
        unstage(index)
    found = reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], result)
    return found.select(F.col("item_id").alias(item_id), "rank", *named, "score")
