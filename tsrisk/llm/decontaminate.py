"""Benchmark passages in documents, a few edits apart.

An item with an error budget of k is split into k + 1 pieces. A passage within k edits of the item leaves at
least one piece untouched, so exact hits of pieces (one automaton for all items) give every place worth a look,
and Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import by_bytes, ship, whole_id

#: Edits allowed per character of an item.
ERROR_RATE = 0.06
#: Bytes of items that are broadcast at a time; more items take more passes.
BLOCK_BYTES = 16 << 20


class Item(NamedTuple):
    item_id: Any  # the benchmark's own id
    text: str
    budget: int


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def pieces(item: Item) -> list[tuple[int, str]]:
    """`budget + 1` consecutive pieces of nearly one length, with their offsets."""
    n, parts = len(item.text), min(item.budget + 1, len(item.text))
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distance(pattern: str, text: str, most: int) -> int | None:
    """Least edit distance of `pattern` to any part of `text`, None above `most`: Myers' bit vectors of any width."""
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    get = places.get
    for c in text:
        eq = get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(eq | plus))
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best = score
    return best if best <= most else None


class Finder:
    """All items of a block behind one automaton."""

    def __init__(self, items: Sequence[Item]) -> None:
        self.items = items
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(items):
            for at, piece in pieces(item):
                owners[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int]]:
        """`item_id, distance` of the items that the text holds, by item id."""
        if not text or not len(self.automaton):
            return []
        body = normal(text)
        places: dict[int, list[int]] = defaultdict(list)
        for end, (size, own) in self.automaton.iter(body):
            for k, at in own:
                places[k].append(end + 1 - size - at)
        found = []
        for k, starts in places.items():
            item = self.items[k]
            best = None
            for first, last in _windows(sorted(set(starts)), item):
                got = least_distance(item.text, body[max(0, first) : last], item.budget)
                if got is not None and (best is None or got < best):
                    best = got
                if best == 0:
                    break
            if best is not None:
                found.append((item.item_id, best))
        return sorted(found, key=lambda f: (f[0] is None, f[0], f[1]))


def _windows(starts: list[int], item: Item) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold every match from one of the starts, overlapping ones as one."""
    first = last = None
    for start in starts:
        a, b = start - item.budget, start + len(item.text) + item.budget
        if last is not None and a <= last:
            last = max(last, b)
            continue
        if last is not None:
            yield first, last
        first, last = a, b
    if last is not None:
        yield first, last


_finders: dict[str, Finder] = {}


def _finder(token: str, items: Sequence[tuple]) -> Finder:
    """The finder of a broadcast block, built once in each worker."""
    if token not in _finders:
        _finders.clear()
        _finders[token] = Finder([Item(*i) for i in items])
    return _finders[token]


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; empty and null ones are left out, repeated rows count once."""
    rows = benchmark.filter(F.length(F.trim("text")) > 0).select(whole_id(benchmark, "item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        held = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = [(r.item_id, normal(r.text)) for r in held]
        yield [(i, t, int(len(t) * rate)) for i, t in items if t]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, name: str = "hits") -> DataFrame:
    """`docs` with `hits`: item id and least edit distance of each benchmark item that the whole text holds.

    Texts and items are compared in lower case with single spaces. An item of n
    characters is found at up to n * rate edits, so a very short one only as it
    is. Null or empty texts hold nothing; null or blank items are held by
    nothing. Items that repeat an id are reported each; a null id is last. Item
    ids are whole numbers or of any other type that can be ordered.
    Repeated rows give repeated rows, an empty table on either side no hits,
    and a column `hits` of the input is replaced.
    """
    ship(docs)
    docs = docs.drop(name)
    kind = benchmark.select(whole_id(benchmark, "item_id")).schema[0].dataType
    hits_of = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("distance", T.IntegerType())]))
    schema = T.StructType([*docs.schema, T.StructField(name, hits_of)])
    context = docs.sparkSession.sparkContext
    found = docs.withColumn(name, F.array().cast(hits_of))
    for block in _blocks(benchmark, rate):
        if not block:
            continue
        shared = context.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(*shared.value)
            for batch in by_bytes(batches, "text"):
                hits = [
                    (old or []) + [{"item_id": i, "distance": d} for i, d in finder.find(t)]
                    for old, t in zip(batch.column(name).to_pylist(), batch.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(hits, batch.schema.field(name).type)], names=batch.schema.names
                )

        found = found.mapInArrow(run, schema)
    return found
