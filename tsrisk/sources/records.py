"""Records of delimited text whose quoted fields hold line breaks, without giving a file to one task.

A line takes the reader from one of two states, outside or inside a quoted field, to one of them; two pattern matches tell
both ends of that map. A first pass composes the maps of each split and keeps the lines at its borders. From these
a step over the splits of a file finds which of them start inside a field, and joins the records that cross a border.
A second pass then cuts every split by itself, starting in the right state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsrisk.session import stage, unstage

# The helpers travel inside the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that the lines after the first of a record may have; a field that does not close by then was never opened.
MAX_FIELD = 1 << 20

_SUMMARY = (
    "file long, block long, joined long, head array<string>, closes boolean, "
    "out_lines array<string>, out_opens array<boolean>, out_stays array<boolean>, "
    "in_lines array<string>, in_opens array<boolean>, in_stays array<boolean>"
)
_STARTS = "file long, block long, skip int, given int, crossing boolean, text string"


def _states(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line that starts outside a quoted field ends inside one, and whether one that starts inside does.

    All repetitions are possessive, so a match takes linear time and no recursion. A quote opens a field only
    at its start, and a doubled one inside is text.
    """
    s = "\\" + sep
    body = '[^"]*+(?:""[^"]*+)*+'
    complete = f'(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s}'
    unclosed = f'(?:{complete})*+"{body}'
    has_quote = F.instr(line, '"') > 0
    opens = has_quote & line.rlike(rf"\A{unclosed}\z")
    stays = ~has_quote | line.rlike(rf'\A{body}(?:"[^{s}]*+{s}{unclosed})?+\z')
    return opens, stays


def cut(opens: np.ndarray, stays: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], int]:
    """First and last line of each record of several lines, reading from outside a field; and the line that is still open.

    An opening line whose field does not close within `limit` bytes is a record by itself. Without an open line the number of lines.
    """
    total = np.append(0, np.cumsum(sizes))
    opening, closing = opens.nonzero()[0], (~stays).nonzero()[0]
    joins, at = [], 0
    while True:
        k = int(opening.searchsorted(at))
        if k == len(opening):
            return joins, len(opens)
        first = int(opening[k])
        c = int(closing.searchsorted(first, side="right"))
        last = int(closing[c]) if c < len(closing) else len(opens) - 1
        if total[last + 1] - total[first + 1] > limit:
            at = first + 1
        elif c < len(closing):
            joins.append((first, last))
            at = last + 1
        else:
            return joins, first


def _sizes(lines: pa.Array) -> np.ndarray:
    return np.array([len(x) + 1 for x in lines.cast(pa.binary()).to_pylist()], dtype=np.int64)


def _joined(lines: pa.Array, joins: list[tuple[int, int]]) -> pa.Array:
    if not joins:
        return lines
    held, out, at = lines.to_pylist(), [], 0
    for first, last in joins:
        out += held[at:first]
        out.append("\n".join(held[first : last + 1]))
        at = last + 1
    return pa.array(out + held[at:], pa.string())


class Scanner:
    """Cuts lines that come in batches; holds the lines from an open one on."""

    def __init__(self, limit: int) -> None:
        self.limit, self.joined = limit, 0
        self.lines = pa.array([], pa.string())
        self.opens = self.stays = np.empty(0, bool)

    def feed(self, lines: pa.Array, opens: np.ndarray, stays: np.ndarray) -> pa.Array:
        """The records that are complete."""
        if len(self.lines):
            lines = pa.concat_arrays([self.lines, lines])
            opens, stays = np.append(self.opens, opens), np.append(self.stays, stays)
        joins, hold = cut(opens, stays, _sizes(lines), self.limit) if opens.any() else ([], len(lines))
        self.lines, self.opens, self.stays = lines.slice(hold), opens[hold:], stays[hold:]
        self.joined += len(joins)
        return _joined(lines.slice(0, hold), joins)

    def give_up(self) -> pa.Array:
        """The open line as a record of its own, and what is complete after it."""
        lines, opens, stays = self.lines, self.opens, self.stays
        self.lines, self.opens, self.stays = lines.slice(0, 0), opens[:0], stays[:0]
        return pa.concat_arrays([lines.slice(0, 1), self.feed(lines.slice(1), opens[1:], stays[1:])])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, np.ndarray, np.ndarray]]:
    """Lines of one split at a time, in order."""
    for batch in batches:
        file, block, opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block", "opens", "stays"))
        edges = ((file[1:] != file[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
            if a < b:
                yield (int(file[a]), int(block[a])), batch.column("value").slice(a, b - a), opens[a:b].astype(bool), stays[a:b].astype(bool)


class _Summary:
    """What the borders of a split need: the lines up to the first close, and the open ends from both states."""

    def __init__(self, key: tuple[int, int], limit: int) -> None:
        self.key, self.limit = key, limit
        self.head: list[str] | None = []
        self.head_bytes, self.closes = 0, False
        self.outside, self.inside = Scanner(limit), Scanner(limit)
        self.same = False  # from some line on both states cut alike

    def feed(self, lines: pa.Array, opens: np.ndarray, stays: np.ndarray) -> None:
        rest = 0
        if not self.closes and self.head is not None:
            end = (~stays).nonzero()[0]
            rest = int(end[0]) + 1 if len(end) else len(lines)
            own = lines.slice(0, rest)
            self.head_bytes += int(_sizes(own).sum())
            if self.head_bytes > self.limit:
                self.head = None
            else:
                self.head += own.to_pylist()
                self.closes = bool(len(end))
        self.outside.feed(lines, opens, stays)
        if self.closes and not self.same:
            self.inside.feed(lines.slice(rest), opens[rest:], stays[rest:])
            self.same = not len(self.inside.lines) and not len(self.outside.lines)

    def row(self) -> tuple:
        ends = [self.outside, self.outside if self.same else self.inside]
        flat = [x for s in ends for x in (s.lines.to_pylist(), s.opens.tolist(), s.stays.tolist())]
        return (*self.key, self.outside.joined + self.inside.joined, self.head, self.closes, *flat)


def _summaries(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    text, flag = pa.list_(pa.string()), pa.list_(pa.bool_())
    kinds = [pa.int64(), pa.int64(), pa.int64(), text, pa.bool_(), text, flag, flag, text, flag, flag]
    held: _Summary | None = None
    for key, *run in _runs(batches):
        if held is None or held.key != key:
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(held.row(), kinds)], names=names)
            held = _Summary(key, limit)
        held.feed(*run)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(held.row(), kinds)], names=names)


def _bytes(lines: Iterable[str]) -> int:
    return sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines)


def _starts(splits: pd.DataFrame, limit: int) -> pd.DataFrame:
    """How each split of a file is cut: lines at its head that belong to an earlier record, open lines that never close,
    and whether its last record goes on; with the text of that record. A split that lies inside one skips all (-1)."""
    rows = splits.sort_values("block").to_dict("records")
    out, at, inside = [], 0, False
    while at < len(rows):
        row = rows[at]
        side = "in" if inside else "out"
        scanner = Scanner(limit)
        scanner.lines = pa.array(list(row[f"{side}_lines"]), pa.string())
        scanner.opens, scanner.stays = (np.array(list(row[f"{side}_{x}"]), dtype=bool) for x in ("opens", "stays"))
        given, text, last = 0, None, at
        while len(scanner.lines):
            parts = scanner.lines.to_pylist()
            size, last = _bytes(parts[1:]), at + 1
            while last < len(rows) and rows[last]["head"] is not None:
                parts += list(rows[last]["head"])
                size += _bytes(rows[last]["head"])
                if rows[last]["closes"] or size > limit:
                    break
                last += 1
            if last < len(rows) and rows[last]["closes"] and size <= limit:
                text = "\n".join(parts)
                break
            given += 1
            scanner.give_up()
        skip = len(row["head"]) if inside else 0
        out.append((row["file"], row["block"], skip, given, text is not None, text))
        if text is not None:
            out += [(r["file"], r["block"], -1, 0, False, None) for r in rows[at + 1 : last]]
        at, inside = (last, True) if text is not None else (at + 1, False)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STARTS.split(", ")])


def _cut_splits(batches: Iterable[pa.RecordBatch], known: dict[str, np.ndarray], limit: int) -> Iterator[pa.RecordBatch]:
    """The records that lie in one split."""
    place = {k: i for i, k in enumerate(zip(known["file"].tolist(), known["block"].tolist()))}

    def ended(scanner: Scanner, start: int) -> Iterator[pa.Array]:
        for _ in range(known["given"][start]):
            yield scanner.give_up()
        if len(scanner.lines) and not known["crossing"][start]:
            raise RuntimeError("a split was cut in another way than before; read the files again")

    def found() -> Iterator[pa.Array]:
        key, scanner, start, skip = None, None, 0, 0
        for own, lines, opens, stays in _runs(batches):
            if own != key:
                if scanner is not None:
                    yield from ended(scanner, start)
                if own not in place:
                    raise RuntimeError("files were split in another way than before; read them again")
                key, scanner, start = own, Scanner(limit), place[own]
                skip = int(known["skip"][start])
            if skip < 0:
                continue
            drop = min(skip, len(lines))
            skip -= drop
            yield scanner.feed(lines.slice(drop), opens[drop:], stays[drop:])
        if scanner is not None:
            yield from ended(scanner, start)

    for lines in found():
        if len(lines):
            yield pa.RecordBatch.from_arrays([lines], names=["value"])


def records(spark: SparkSession, files, sep: str = ",", limit: int | None = None) -> DataFrame:
    """Column `value`: each record of the files, lines inside quoted fields joined by a line feed; headers and blank lines too.

    The files are read twice, each time by as many tasks as they have splits; text without such fields is
    passed on as it is read. A field that has not closed `limit` bytes after its first line is none: that line
    is a record and reading goes on behind it. Broadcast are 25 bytes for a split.
    """
    limit = MAX_FIELD if limit is None else limit
    text = spark.read.text(files)
    opens, stays = _states(F.col("value"), sep)
    lines = text.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        opens.alias("opens"), stays.alias("stays"),
    )

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summaries(batches, limit)

    def start(splits: pd.DataFrame) -> pd.DataFrame:
        return _starts(splits, limit)

    summaries = stage(lines.mapInArrow(summarise, _SUMMARY), "record-splits")
    if not summaries.where((F.col("joined") > 0) | (F.size("out_lines") > 0)).head(1):
        unstage(summaries)
        return text
    starts = stage(summaries.groupBy("file").applyInPandas(start, _STARTS), "record-starts")
    unstage(summaries)
    table = starts.drop("text").toPandas()
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table.columns})

    def cut_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut_splits(batches, shared.value, limit)

    crossing = starts.where(F.col("text").isNotNull()).select(F.col("text").alias("value"))
    return lines.mapInArrow(cut_splits, "value string").unionByName(crossing)
