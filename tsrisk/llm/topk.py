"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are dealt into LISTS lists, and a score is the sum of one partial score from each.
Phase one resolves the heads of every list and gathers each task's best scores; the k-th best of those is a
cutoff that no true answer falls below. Phase two sends the cutoff out again: a row can only reach it if at
least one of its partial scores reaches a LISTS-th part. Phase three resolves those rows exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsrisk.llm.common import ship
from tsrisk.session import stage

SCALE = 256
LISTS = 4
#: Queries that are broadcast at a time; more take more passes over the rows.
QUERY_BLOCK = 2048
#: Rows that are scored at a time.
ROWS = 512

_I64 = np.iinfo(np.int64)


def _vectors(batch: pa.RecordBatch, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and scaled whole components by length; rows with null or non-finite components are left out."""
    column = batch.column(vector)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.isfinite(values)
    if flat.null_count:
        ok &= ~np.asarray(flat.is_null())
    sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    at = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    whole = np.floor(np.where(ok, values, 0.0) * SCALE)
    out = {}
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        places = at[rows][:, None] + np.arange(size)
        good = ok[places].all(axis=1)
        if good.any():
            out[size] = rows[good], whole[places[good]]
    return out


def _partials(rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Partial scores (rows, queries) of each list; exact, in floats while sums stay below 2^53 and else in integers."""
    most = (np.abs(rows).max(initial=0)) * (np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if most >= 2.0**53:
        rows, queries = (np.vectorize(int, otypes=[object])(x) if x.size else x for x in (rows, queries))
    return [
        rows[:, part] @ queries[:, part].T
        for part in np.array_split(np.arange(rows.shape[1]), LISTS)
    ]


def _at_most(score: int) -> float:
    """The largest float that is not above a score, so that no bound of floats drops the score it came from."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


class _Best:
    """The k best (score, smaller id) of each query in one task."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)  # k-th best so far; lower scores need no look

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.held[query] + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        self.held[query] = sorted(held)[: self.k]
        if len(self.held[query]) == self.k:
            self.least[query] = _at_most(-self.held[query][-1][0])

    def batch(self, numbers: np.ndarray) -> pa.RecordBatch:
        found = [(int(n), i, min(max(-s, _I64.min), _I64.max)) for n, own in zip(numbers, self.held) for s, i in own]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"])


def _task(batches: Iterable[pa.RecordBatch], block: dict, k: int, vector: str) -> Iterator[pa.RecordBatch]:
    """Phase one if the block has no cutoffs, else phases two and three."""
    best = {size: _Best(len(own["id"]), k) for size, own in block.items()}
    for batch in batches:
        ids = np.array(batch.column("vec_id").to_numpy(zero_copy_only=False))
        for size, (rows, whole) in _vectors(batch, vector).items():
            if size not in block:
                continue
            own = block[size]
            for at in range(0, len(rows), ROWS):
                part, vec_ids = whole[at : at + ROWS], ids[rows[at : at + ROWS]]
                lists = _partials(part, own["vector"])
                foreign = vec_ids[:, None] != own["id"][None, :]
                if "cutoff" in own:
                    hit = reduce(np.logical_or, [p * LISTS >= own["cutoff"][None, :] for p in lists]) & foreign
                else:
                    hit = np.zeros(foreign.shape, bool)
                    head = min(len(part), k + 1)
                    for p in lists:
                        order = np.argsort(-p, axis=0) if p.dtype == object else np.argpartition(-p, head - 1, axis=0)
                        top = order[:head]
                        np.put_along_axis(hit, top, True, axis=0)
                    hit &= foreign
                q, r = np.nonzero(hit.T)
                total = reduce(np.add, [p[r, q] for p in lists])
                keep = total >= best[size].least[q]
                if "cutoff" in own:
                    keep &= total >= own["cutoff"][q]
                q, r, total = q[keep], r[keep], total[keep]
                # Of the rows of one query only the k best matter; whole groups of ties shrink here already.
                if total.dtype == object:
                    order = np.array(sorted(range(len(q)), key=lambda x: (q[x], -total[x], vec_ids[r[x]])), np.int64)  # noqa: B023
                else:
                    order = np.lexsort((vec_ids[r], -total, q))
                q, r, total = q[order], r[order], total[order]
                begin = np.searchsorted(q, np.arange(len(own["id"]) + 1))
                for query in np.unique(q).tolist():
                    a, b = begin[query], min(begin[query + 1], begin[query] + k)
                    best[size].add(query, total[a:b], vec_ids[r[a:b]])
    for size, held in best.items():
        yield held.batch(block[size]["number"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the k highest scores of each query row against all other rows.

    Reads `vec_id` and the vector column. Components become floor(256 * x);
    scores are integer inner products between vectors of one length (beyond 64
    bits: the nearest such number); ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take
    no part. Rows that carry the query's own id are the query itself. Other
    repeated rows each count as a row; repeated query rows count once. With
    fewer than k other rows all are given; an empty table gives no rows.
    """
    ship(rows)
    spark = rows.sparkSession
    used = rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select(
        F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias(vector)
    )
    asked = stage(used.filter(is_query).distinct(), "tk-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    results = []
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", vector), F.lit(blocks)) == number).toArrow()
        if not own.num_rows:
            continue
        batch = own.combine_chunks().to_batches()[0]
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        block = {
            size: {"number": at, "id": ids[at], "vector": whole} for size, (at, whole) in _vectors(batch, vector).items()
        }
        shared = spark.sparkContext.broadcast(block)

        def first(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _task(batches, shared.value, k, vector)

        schema = "query long, vec_id long, score long"
        heads = _ranked(used.mapInArrow(first, schema), k).filter(F.col("rank") == k)
        cutoffs = dict(heads.select("query", "score").collect())  # one row for each query of the block
        for size_block in block.values():
            # Without k other rows yet there is no cutoff; the least number lets everything through.
            size_block["cutoff"] = np.array([_at_most(int(cutoffs.get(int(n), _I64.min))) for n in size_block["number"]])
            size_block["cutoff"][size_block["cutoff"] <= -(2.0**62)] = -np.inf
        shared = spark.sparkContext.broadcast(block)

        def second(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _task(batches, shared.value, k, vector)

        names = spark.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "query long, query_id long")
        found = _ranked(used.mapInArrow(second, schema), k).join(names, "query")
        results.append(stage(found.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "tk-found"))
    if not results:
        return used.limit(0).select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")
        )
    return reduce(DataFrame.unionByName, results)
