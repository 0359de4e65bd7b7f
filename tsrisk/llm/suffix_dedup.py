"""Removal of repeated substrings of at least 200 bytes by induced suffix sorting.

Two equal windows of LENGTH bytes share the smallest hash of their CORE-byte substrings, at the same place. Every
run of windows with one such place is a string; a string whose smallest hash occurs nowhere else has no repeated
window and goes no further, and equal strings are one string with a count. Strings that share their smallest hash are
cut in two and matched on longer cores, until groups are small whatever a line's frequency; what still differs is
brought together in shards, whole groups each, whose suffixes `induced.suffix_order` sorts. A window is repeated where a
common prefix of neighbours reaches LENGTH, or where its string has a count above one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import binary, by_bytes, kept, release, ship
from tsrisk.llm.induced import Scratch, suffix_order, text_of
from tsrisk.session import new_path, stage, unstage

LENGTH = 200
CORE = 56
#: Bytes of text whose windows are hashed at a time.
PIECE = 1 << 20
#: Bytes of strings that a task sorts at a time, in whole groups.
SHARD_BYTES = 4 << 20
#: Strings that a group may hold when it is sorted, and bytes that their windows may have beside the core; others are cut again.
GROUP_STRINGS, SLACK = 512, 36

_PLACE = np.uint64((1 << 21) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept in the worker."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 2**64)
        _powers[:] = []
        for base in (int(_BASE), inverse):
            table = np.full(n, base, np.uint64)
            table[:1] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every string: its text's number, its place and size there, its core's place in it, the core's and its own hash.

    Strings of a text overlap; each of its windows lies in exactly one as a place to start from. The core is the leftmost smallest one.
    """
    pieces = [
        (row, a, text[a : a + PIECE + LENGTH - 1])
        for row, text in enumerate(texts) for a in range(0, max(1, len(text) - LENGTH + 1), PIECE) if len(text) >= LENGTH
    ]
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for piece in [*pieces, None]:
        if part and (piece is None or size + len(piece[2]) > PIECE + LENGTH - 1):
            for column, found in zip(out, _strings(part)):
                column.append(found)
            part, size = [], 0
        if piece is not None:
            part.append(piece)
            size += len(piece[2])
    return tuple(np.concatenate(column) for column in out)


def _strings(pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    text = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    n = len(text)
    power, inverse = _power_tables(PIECE + LENGTH)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[text] * power[:n], out=sums[1:])
    cores = _mix((sums[CORE:] - sums[:-CORE]) * inverse[: n - CORE + 1])
    least = (cores & ~_PLACE) | np.arange(len(cores), dtype=np.uint64)
    width, step = LENGTH - CORE + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    place = (least & _PLACE).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(place) + 1, np.int8)  # windows that lie in one piece
    whole[begin] = 1
    whole[np.minimum(begin + sizes - LENGTH + 1, len(place))] = -1
    whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    other = place[1:] != place[:-1]
    first = (whole & np.append(True, other | ~whole[:-1])).nonzero()[0]
    last = (whole & np.append(other | ~whole[1:], True)).nonzero()[0]
    own = np.searchsorted(begin, first, side="right") - 1
    row, at = np.array([r for r, _, _ in pieces])[own], np.array([a for _, a, _ in pieces])[own]
    size = last - first + LENGTH
    content = _mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64) * _BASE)
    return [row, at + first - begin[own], size, place[first] - first, cores[place[first]].view(np.int64), content.view(np.int64)]


def halves(body: bytes, off: int, slack: int) -> list[tuple[int, int, bytes, int, int, int]]:
    """A string cut by where its windows have their core: group, content, part, first window, core's place and slack of each.

    `slack` is what a window has beside its core. A window has at least half of it on the left, or else on the right, and
    that much joins the core.
    """
    more = (slack + 1) // 2
    windows = len(body) - LENGTH + 1
    cut = min(max(off - more + 1, 0), windows)  # windows before have enough on the left
    core = LENGTH - slack
    out = []
    for side, a, b in ((0, 0, cut), (1, cut, windows)):
        if a < b:
            part = body[a : b - 1 + LENGTH]
            at = off - more if side == 0 else off - a
            key = hashlib.blake2b(part[at : at + core + more], digest_size=8, salt=bytes([side, slack]))
            content = hashlib.blake2b(part, digest_size=8)
            group, own = (int.from_bytes(d.digest(), "little", signed=True) for d in (key, content))
            out.append((group, own, part, a, at, slack - more))
    return out


_PARTS = "g long, t long, h long, s long, first int, off int, slack int, n long, body binary"


def _parts(rows: Iterable[tuple[int, int, int, int, int, bytes]]) -> pa.RecordBatch:
    """Halves of `h, s, off, slack, n, body` rows."""
    found = [
        (g, t, h, s, first, at, left, n, part)
        for h, s, off, slack, n, body in rows for g, t, part, first, at, left in halves(body, off, slack)
    ]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64(), pa.binary()]
    columns = zip(*found) if found else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _sorted_ranges(strings: list[tuple[int, int, int, bytes]], scratch: Scratch | None) -> list[np.ndarray]:
    """`g, t` and the first and last place of each run of repeated windows of `g, t, n, body` strings."""
    text, begin = text_of([body for *_, body in strings])
    order, prefix = suffix_order(text, len(strings), scratch)
    repeated = np.zeros(len(text) + 1, bool)
    near = (prefix >= LENGTH).nonzero()[0]
    repeated[order[near]] = True
    repeated[order[near - 1]] = True
    for (_, _, n, body), a in zip(strings, begin.tolist()):
        if n > 1:
            repeated[a : a + len(body) - LENGTH + 1] = True
    edge = np.diff(repeated.astype(np.int8), prepend=0)
    first, last = (edge > 0).nonzero()[0], (edge < 0).nonzero()[0] - 1
    own = np.searchsorted(begin, first, side="right") - 1
    g, t = (np.array([s[i] for s in strings], dtype=np.int64) for i in (0, 1))
    return [g[own], t[own], first - begin[own], last - begin[own]]


def _shards(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Groups come whole and one after the other; as many as fit are a shard."""
    scratch = Scratch(folder)

    def sort(strings: list[tuple]) -> pa.RecordBatch:
        columns = _sorted_ranges(strings, scratch)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "t", "a", "b"])

    try:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "t", "n", "body"))):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield sort(held)
    finally:
        scratch.close()


def _ranges(parts: DataFrame) -> DataFrame:
    """Repeated windows of the strings behind `parts`, all of which stand in groups of different strings.

    `h, s, a, b`: the string, and the first and last place of windows that occur again.
    """
    spark = parts.sparkSession
    strings = parts.groupBy("g", "t").agg(F.sum("n").alias("total"), F.min(F.struct("h", "s", "first")).alias("rep"))
    strings = stage(strings, "sd-strings")
    groups = strings.groupBy("g").agg(F.count(F.lit(1)).alias("strings"), F.sum("total").alias("count")).filter(F.col("count") > 1)
    groups = stage(groups, "sd-groups")
    alone = groups.filter(F.col("strings") == 1).select("g")
    last = F.length("body") - LENGTH
    whole = parts.join(alone, "g").select("h", "s", F.col("first").alias("a"), (F.col("first") + last).alias("b"))

    mixed = strings.join(groups.filter(F.col("strings") > 1).select("g", "strings"), "g")
    chosen = mixed.select("g", "t", "total", "strings", "rep.h", "rep.s", "rep.first")
    bodies = stage(parts.drop("n").join(chosen, ["g", "t", "h", "s", "first"]).drop("h", "s", "first"), "sd-bodies")
    large = (F.col("strings") > GROUP_STRINGS) | (F.col("slack") > SLACK)
    size, again = bodies.agg(F.sum(F.when(~large, F.length("body"))), F.count(F.when(large, 1))).first()
    found = []
    if size:
        folder = new_path(spark, "sd-scratch")
        shards = max(-(-size // SHARD_BYTES), min(2 * spark.sparkContext.defaultParallelism, size >> 18), 1)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _shards(batches, folder)

        dealt = bodies.filter(~large).select("g", "t", F.col("total").alias("n"), "body").repartition(shards, "g")
        found.append(dealt.sortWithinPartitions("g").mapInArrow(run, "g long, t long, a int, b int"))
    if again:

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _parts(zip(*(batch.column(c).to_pylist() for c in ("g", "t", "off", "slack", "total", "body"))))

        smaller = stage(bodies.filter(large).mapInArrow(cut, _PARTS), "sd-parts")
        found.append(_ranges(smaller).select(F.col("h").alias("g"), F.col("s").alias("t"), "a", "b"))
    for other in found:
        inner = parts.select("g", "t", "h", "s", "first").join(stage(other, "sd-inner"), ["g", "t"])
        whole = whole.unionByName(inner.select("h", "s", *[(F.col("first") + F.col(c)).alias(c) for c in "ab"]))
    whole = stage(whole, "sd-ranges")
    unstage(strings, groups, bodies)
    return whole


def _repeats(texts: DataFrame) -> DataFrame:
    """`k1, k2, spans`: bytes of each text that lie in a repeated window, as begins and ends that may overlap."""

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "text"):
                row, at, size, off, h, s = strings_of([t or b"" for t in binary(part.column("text"))])
                keys = [part.column(k).take(pa.array(row)) for k in ("k1", "k2")]
                small = [pa.array(c, pa.int32()) for c in (at, size, off)]
                yield pa.RecordBatch.from_arrays([*keys, *small, pa.array(h), pa.array(s)], names=["k1", "k2", "at", "size", "off", "h", "s"])

    found = texts.mapInArrow(anchors, "k1 long, k2 long, at int, size int, off int, h long, s long")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    groups = stage(counts.filter(F.col("n") > 1).select("h", (F.col("low") != F.col("high")).alias("mixed")), "sd-shared")
    shared = stage(found.join(groups, "h"), "sd-occurrences")
    del found, counts
    release(texts)
    end = F.col("at") + F.col("size")
    spans = shared.filter(~F.col("mixed")).select("k1", "k2", "at", end.alias("end"))

    distinct = shared.filter("mixed").groupBy("h", "s").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "size", "off")).alias("rep")
    )
    asked = distinct.groupBy("rep.k1", "rep.k2").agg(
        F.collect_list(F.struct("h", "s", "n", "rep.at", "rep.size", "rep.off")).alias("asked")
    )

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "text"):
                rows = zip(binary(part.column("text")), part.column("asked").to_pylist())
                yield _parts(
                    (a["h"], a["s"], a["off"], LENGTH - CORE, a["n"], text[a["at"] : a["at"] + a["size"]])
                    for text, own in rows for a in own
                )

    one = texts.dropDuplicates(["k1", "k2"])
    parts = stage(one.join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(fetch, _PARTS), "sd-parts")
    del one, asked, distinct
    release(texts)
    ranges = _ranges(parts)
    unstage(parts)
    inner = shared.filter("mixed").join(ranges, ["h", "s"])
    spans = spans.unionByName(
        inner.select("k1", "k2", (F.col("at") + F.col("a")).alias("at"), (F.col("at") + F.col("b") + LENGTH).alias("end"))
    )
    found = stage(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "end")).alias("spans")), "sd-spans")
    unstage(groups, shared, ranges)
    return found


def merged(row: np.ndarray, at: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of spans in texts of the given sizes as runs that neither overlap nor touch: row, begin, end, in order."""
    base = np.cumsum(sizes + 1) - sizes - 1  # a place between two texts keeps their runs apart
    order = np.argsort(at + base[row], kind="stable")
    begin, reach = (at + base[row])[order], np.maximum.accumulate((end + base[row])[order])
    first = np.append(True, begin[1:] > reach[:-1]) if len(begin) else np.empty(0, bool)
    last = np.append(first[1:], True) if len(begin) else first
    own = row[order][first]
    return own, begin[first] - base[own], reach[last] - base[own]


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept`, a row per row of `docs`; `kept` is what is left of the text's bytes.

    Bytes go that lie in a 200-byte string which starts anywhere else too, in the same text or
    another; all occurrences go. Strings are judged on the texts as they come and may overlap. Texts are UTF-8 bytes; a cut may
    part a character, so `kept` is binary. A null text is empty, and empty or shorter texts stay whole. Repeated rows are
    texts like others, so of long ones nothing is left. Ids may be null, repeated and of any type that can be hashed; other
    columns play no part. An empty table gives an empty result.
    """
    ship(docs)
    selected, names, fields, named = kept(docs, [key])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(*selected, text.alias("text")).withColumns({"k1": F.xxhash64(names[0]), "k2": F.xxhash64("text")})
    spans = _repeats(texts.select("k1", "k2", "text"))
    release(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "text"):
                bodies = binary(part.column("text"))
                sizes = np.array([len(b) for b in bodies], dtype=np.int64)
                counts = part.column("spans").fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
                flat = part.column("spans").flatten()
                at, end = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                runs = [x.tolist() for x in merged(np.repeat(np.arange(len(bodies)), counts), at, end, sizes)]
                removed, spans, cuts = [0] * len(bodies), [0] * len(bodies), {}
                for r, a, b in zip(*runs):
                    removed[r] += b - a
                    spans[r] += 1
                    cuts.setdefault(r, [0]).extend((a, b))
                for r, stops in cuts.items():
                    stops.append(len(bodies[r]))
                    bodies[r] = b"".join(bodies[r][a:b] for a, b in zip(stops[::2], stops[1::2]))
                columns = [pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=out.names)

    out = T.StructType([*fields, *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary")])
    joined = texts.join(spans, ["k1", "k2"], "left").select(*names, "text", "spans")
    return joined.mapInArrow(run, out).select(*named, *out.names[len(fields) :])
