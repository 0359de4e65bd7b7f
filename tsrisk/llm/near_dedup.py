"""Near duplicates by MinHash, every link confirmed on full shingle sets.

Documents with one shingle set are one node from the start, named by a 128-bit fingerprint of the set. Nodes
that agree on a band of minima meet in a bucket. Each bucket first compares all its nodes with one of them, and
the confirmed links give components. What is left are buckets whose nodes are still in several components:
there, bounded blocks of nodes are compared by signature, which gives clusters of components that look linked,
and each such cluster is compared on full sets, again in bounded blocks. What leaves a task is a forest, never all pairs
of a group, and no pair that shares a band is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import binary, by_bytes, free_name, ship, whole_id
from tsrisk.llm.components import components
from tsrisk.llm.shingles import mix, shingle_sets
from tsrisk.session import stage, unstage

THRESHOLD = 75
#: A pair at similarity 0.75 shares no band with a probability of (1 - 0.75^5)^42, about one in 90,000.
BANDS, ROWS = 42, 5
#: Likely links: agreement of minima five standard deviations below the threshold's mean, over all minima or the sketch.
SIGNATURE_SHARE, SKETCH, SKETCH_SHARE = 0.60, 64, 0.48
#: Nodes in one group of a cell that compares signatures, and of one that compares full sets.
BLOCK, SET_BLOCK = 256, 64

FEATURES = "n_shingles long, node binary, bands array<long>, signature binary"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of the universal hash functions, drawn from a fixed seed."""
    draw = np.random.default_rng(20240501)
    n = BANDS * ROWS
    return draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, which is read in bounded parts."""
    a, b = _MULTIPLY, _SHIFT
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            values = a[:, None] * x[None, at : at + 1024]
            values += b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
    return least


_MULTIPLY, _SHIFT = _functions()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    with np.errstate(over="ignore"):
        rows = least.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def features(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A row per document: set size, fingerprint of the set, band keys, and the low byte of every minimum.

    The column `row`, if it is named, comes along under that name.
    """
    own = [whole_id(docs, "doc_id"), *([F.col(row).alias("row")] if row else [])]
    fields = docs.select(*own).schema
    names = fields.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            sets = shingle_sets(binary(batch.column("text")))
            node, bands, signature = [], [], []
            for s in sets:
                least = minima(s)
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(least) if len(s) else [])
                signature.append((least & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary()),
                ],
                names=[*names, "n_shingles", "node", "bands", "signature"],
            )

    return docs.select(*own, "text").mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(FEATURES)]))


def _agreeing(pairs: DataFrame, length: int, share: float) -> DataFrame:
    """`u, v` of the rows `u, v, su, sv` whose signatures agree in at least `share` of their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, length) for c in ("su", "sv"))
            keep = (a == b).sum(axis=1) >= share * length
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "u binary, v binary")


def _by_signature(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs `u, v` whose sketches, and then whole signatures, agree well enough."""
    for length, share in ((SKETCH, SKETCH_SHARE), (BANDS * ROWS, SIGNATURE_SHARE)):
        own = F.substring("signature", 1, length)
        with_v = pairs.join(signatures.select(F.col("node").alias("v"), own.alias("sv")), "v")
        pairs = _agreeing(with_v.join(signatures.select(F.col("node").alias("u"), own.alias("su")), "u"), length, share)
    return pairs


def _sets_of(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """`node, members`: the sorted shingle hashes of the given nodes.

    Texts are fetched by the id that stands for a node. Rows without an id, and
    rows that share one, are told apart by the fingerprint.
    """
    wanted = nodes.join(reps, "node").filter(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id")).distinct()
    rows = docs.select(whole_id(docs, "doc_id"), "text")
    found = rows.join(wanted, "doc_id", "left_semi").unionByName(rows.filter(F.col("doc_id").isNull()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            members = [s.tobytes() for s in shingle_sets(binary(batch.column("text"))) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(m) for m in members], pa.binary()), pa.array(members, pa.binary())],
                names=["node", "members"],
            )

    sets = found.select("text").mapInArrow(run, "node binary, members binary")
    return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs `u, v` with 100 * intersection >= threshold * union on full sets."""
    pairs = stage(pairs, "nd-likely")
    nodes = _ends(pairs)
    sets = stage(_sets_of(docs, nodes, reps), "nd-sets")
    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("members").alias("mv")), "v")
    both = with_v.join(sets.select(F.col("node").alias("u"), F.col("members").alias("mu")), "u")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("mu"), batch.column("mv")):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = stage(both.mapInArrow(run, "u binary, v binary"), "nd-links")
    unstage(pairs, sets)
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


class _Forest:
    """Joins labels; tells which pairs of labels were new to each other."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def top(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: bytes, y: bytes) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows `key, n, node, ...` dealt into cells `key, i, j` of two groups each; `own` is the row's group.

    The n nodes of a key make n / `block` groups, and each pair of groups is a
    cell, so every two nodes of a key meet while a task holds two groups.
    """
    groups = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), groups).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
    cells = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _per_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each cell, which lead with `key, i, j`."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, cell in groupby(rows, key=lambda r: (r["key"], r["i"], r["j"])):
        yield list(cell)


def _sides(cell: list[dict]) -> tuple[list[dict], list[dict]]:
    """The cell's two groups, which are one list if it compares a group with itself."""
    i, j = cell[0]["i"], cell[0]["j"]
    left = [r for r in cell if r["own"] == i]
    return left, (left if i == j else [r for r in cell if r["own"] == j])


def _root_pairs(found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of the pairs."""
    out: list[tuple] = []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["u", "v"])

    for pair in found:
        out.append(pair)
        if len(out) >= 4096:
            yield pack()
            out.clear()
    if out:
        yield pack()


def _likely(rows: DataFrame) -> DataFrame:
    """Pairs `u, v` of roots that signatures make look linked, from rows `key, n, hub, node, root, signature`.

    Inside a cell the pairs form a forest: any two roots with a likely link
    are connected, but no more pairs leave the task than it holds roots.
    """

    def pairs(cell: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        left, right = _sides(cell)
        if len({r["root"] for r in cell}) < 2 or not left or not right:
            return
        forest = _Forest()
        other = np.frombuffer(b"".join(r["signature"] for r in right), np.uint8).reshape(len(right), -1)
        for x in left:
            # Pairs with the hub have been confirmed or refused already.
            if x["node"] == x["hub"]:
                continue
            agree = (np.frombuffer(x["signature"], np.uint8) == other).sum(axis=1)
            for k in np.flatnonzero(agree >= SIGNATURE_SHARE * BANDS * ROWS):
                y = right[k]
                if y["node"] != y["hub"] and x["root"] != y["root"] and forest.join(x["root"], y["root"]):
                    yield x["root"], y["root"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _root_pairs(p for cell in _per_cell(batches) for p in pairs(cell))

    return _cells(rows, BLOCK).mapInArrow(run, "u binary, v binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of bounded parts of their incidence."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    used = (times > 1)[where]
    owner, where = owner[used], common[where[used]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    out = np.zeros((len(left), len(right)))
    width = 4096
    for first in range(0, int(where[-1]) + 1 if len(where) else 0, width):
        a, b = np.searchsorted(where, [first, first + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], where[a:b] - first] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs `u, v` of roots with a link on full sets, from rows `key, n, node, root, members`; a forest for each cell."""

    def pairs(cell: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        left, right = _sides(cell)
        if len({r["root"] for r in cell}) < 2 or not left or not right:
            return
        a, b = ([np.frombuffer(r["members"], np.uint64) for r in side] for side in (left, right))
        shared = _shared(a, b)
        sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
        forest = _Forest()
        for x, y in zip(*np.nonzero(100 * shared >= threshold * (sizes - shared))):
            u, v = left[x]["root"], right[y]["root"]
            if u != v and forest.join(u, v):
                yield u, v

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _root_pairs(p for cell in _per_cell(batches) for p in pairs(cell))

    return _cells(rows, SET_BLOCK).mapInArrow(run, "u binary, v binary")


def _rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """`rows` with the root of `node` as `name`; a node without links is its own root."""
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(r, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", node)).drop("_n", "_r")


def links_between(docs: DataFrame, found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`node, root` of all nodes that are linked with others; `found` holds the documents' features."""
    held = found.filter(F.col("node").isNotNull())
    reps = held.groupBy("node").agg(F.min("doc_id").alias("rep"))
    rows = held.select("node", F.explode("bands").alias("key"))
    # Copies of one set have one node, so a bucket has something to compare only if its ends differ.
    ends = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top")
    buckets = stage(rows.join(ends.select("key", "hub"), "key").distinct(), "nd-buckets")
    in_buckets = buckets.select("node").distinct()
    signatures = held.select("node", "signature").join(in_buckets, "node", "left_semi")
    signatures = stage(signatures.groupBy("node").agg(F.first("signature").alias("signature")), "nd-signatures")
    first = buckets.filter("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    links = _confirm(_by_signature(first, signatures), docs, reps, threshold)
    roots = stage(components(links), "nd-roots")

    # Buckets whose nodes are still in several components: which roots look linked, by signature?
    seen = _rooted(buckets, roots, "node", "root")
    still = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    still = still.filter("n > 2 and a < b").select("key", "n")
    open_rows = seen.join(still, "key").join(signatures, "node").select("key", "n", "hub", "node", "root", "signature")
    clusters = stage(components(stage(_likely(open_rows).distinct(), "nd-likely")), "nd-clusters")
    if clusters.isEmpty():
        return roots

    # Every likely link lies inside one cluster of roots, so each cluster is compared once more, on full sets.
    rooted = _rooted(in_buckets, roots, "node", "root")
    keys = clusters.select(F.col("node").alias("root"), F.col("root").alias("key"))
    own = stage(rooted.join(keys, "root").select("key", "node", "root"), "nd-own")
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sets = stage(_sets_of(docs, own.select("node").distinct(), reps), "nd-sets")
    full = own.join(sizes, "key").join(sets, "node").select("key", "n", "node", "root", "members")
    more = stage(_linked(full, threshold), "nd-links")
    unstage(buckets, signatures, sets)
    if more.isEmpty():
        return roots
    joined = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
    return stage(components(joined), "nd-roots")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`, a row per row of `docs`.

    Reads `doc_id, text`; other columns play no part. Texts are compared as
    sets of five-word shingles, shorter ones as one whole; a null text, or one
    without words, has no shingles and is a component of its own. A component
    is named by its least id; ids that are null count last, so only a component
    without any id is named null. Rows that share an id are documents of their
    own, and each of them is kept if its id names the component. Ids are whole
    numbers or of any other type that can be ordered. An empty table gives an
    empty result.
    """
    ship(docs)
    found = stage(features(docs), "nd-features")
    roots = links_between(docs, found, threshold)
    held = found.filter(F.col("node").isNotNull())
    classes = held.groupBy("node").agg(F.min("doc_id").alias("rep"))
    rooted = stage(_rooted(classes, roots, "node", "root"), "nd-classes")
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(names, "root").select("node", "component_id")
    linked = held.select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = found.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, one of each component of near duplicates; rows without words are all different texts.

    The row with the least id stays, null ids last; among equal ids it is the
    one with the least hash of all columns. So rows without an id, and rows
    that share one, are told apart, and rows repeated in full become one. An
    empty table gives an empty result.
    """
    ship(docs)
    row = free_name(docs, "row")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    values = [x for c in columns for x in (c.isNull(), c)]
    hashes = [F.hex(F.xxhash64(F.lit(seed), *values)) for seed in (1, 2)]
    marked = docs.withColumn(row, F.concat_ws("-", *hashes))
    found = stage(features(marked, row), "nd-features")
    roots = links_between(docs, found, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = found.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(order).alias("best"))
    best = _rooted(classes, roots, "node", "root").groupBy("root").agg(F.min("best").alias("best"))
    alone = found.filter(F.col("node").isNull()).select("row").distinct()
    wanted = stage(best.select("best.row").unionByName(alone).select(F.col("row").alias(row)), "nd-kept")
    unstage(found, roots)
    return marked.join(wanted, row, "left_semi").select(*columns).dropDuplicates()
