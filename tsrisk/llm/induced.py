"""Suffix order and common prefixes of many strings by external induced sorting.

A text of whole numbers is a list of strings, each closed by an end of its own: ends are numbered 0, 1, ... and sort
below every letter. A suffix is of type L if it is larger than its follower and S if smaller; an S after an L starts a
piece. Pieces are ranked, the text of their ranks is sorted by recursion, and from the order of the
piece starts one scan upwards induces the L suffixes, one scan downwards all S suffixes. A scan takes (letter,
position, common prefix) tuples off a priority queue and puts the tuple of the suffix one place to the left
on it. The queue holds sorted runs in memory up to a bound and writes larger ones out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

#: Tuples that a queue holds in memory; runs beyond it are written to the scratch folder.
MEMORY = 8 << 20
#: Runs of like size that become one.
FAN = 8
#: Tuples that a scan first tries to take in one step when letters are many.
STEP = 1024


class Scratch:
    """Files of a folder that every executor reaches, by its address; removed with the last reference to them."""

    def __init__(self, folder: str) -> None:
        if "://" in folder or folder.startswith("file:"):
            self.system, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
        else:
            self.system, path = fs.LocalFileSystem(), folder
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.made = False

    def write(self, rows: np.ndarray) -> Stored:
        if not self.made:
            self.system.create_dir(self.path)
            self.made = True
        name = f"{self.path}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(name) as out:
            out.write(np.ascontiguousarray(rows).tobytes())
        return Stored(self, name, rows.dtype, rows.shape)

    def close(self) -> None:
        if self.made:
            self.system.delete_dir(self.path)
            self.made = False


@dataclass
class Stored:
    """Rows in a scratch file; slices are read when asked for."""

    scratch: Scratch
    name: str
    dtype: np.dtype
    shape: tuple[int, int]

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.shape[0])
        width = self.shape[1] * self.dtype.itemsize
        with self.scratch.system.open_input_file(self.name) as file:
            file.seek(a * width)
            return np.frombuffer(file.read((b - a) * width), self.dtype).reshape(b - a, self.shape[1])

    def drop(self) -> None:
        self.scratch.system.delete_file(self.name)


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order; narrow numbers are sorted by their digits."""
    if len(keys) > 64:
        low, high = int(keys.min()), int(keys.max())
        if high - low < 65536:
            keys = (keys - low).astype(np.uint16)
    return np.argsort(keys, kind="stable")


class _Run:
    """Tuples by key, those of one key in order of arrival; taken from the front."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int) -> None:
        self.keys, self.values, self.level, self.front = keys, values, level, 0
        self.first = int(keys[0])
        self.ends: np.ndarray | None = None  # once stored, `keys` are the distinct ones and this is where each ends

    def __len__(self) -> int:
        return (len(self.keys) if self.ends is None else int(self.ends[-1])) - self.front

    @property
    def stored(self) -> bool:
        return self.ends is not None

    def store(self, scratch: Scratch) -> None:
        keys, self.values, self.front = self.keys[self.front :], scratch.write(self.values[self.front :]), 0
        last = np.append(keys[1:] != keys[:-1], True).nonzero()[0]
        self.keys, self.ends = keys[last], last + 1

    def end(self, below: int) -> int:
        if self.first >= below:
            return self.front
        if self.ends is None:
            return self.front + int(self.keys[self.front :].searchsorted(below))
        place = int(self.keys.searchsorted(below))
        return max(self.front, int(self.ends[place - 1]) if place else 0)

    def upto(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values from the front on."""
        values = self.values[self.front : end]
        if self.ends is None:
            return self.keys[self.front : end], values
        return np.repeat(self.keys, np.diff(np.clip(self.ends, self.front, end), prepend=self.front)), values

    def drop(self, below: int) -> bool:
        """Whether tuples are left without those under a key."""
        if self.first >= below:
            return True
        self.front = self.end(below)
        if len(self):
            at = self.front if self.ends is None else int(self.ends.searchsorted(self.front, side="right"))
            self.first = int(self.keys[at])
            return True
        if self.stored:
            self.values.drop()
        return False


class TupleQueue:
    """A priority queue of (key, position, common prefix): by key, and by arrival within a key.

    What is pushed at a time is a sorted run. FAN neighbouring runs of one
    size become one, so there are few at any time. When the tuples held in memory pass
    the bound, the largest run goes to the scratch folder and is read back slice by slice.
    """

    def __init__(self, scratch: Scratch | None = None, memory: int | None = None) -> None:
        self.runs: list[_Run] = []
        self.scratch, self.memory = scratch, MEMORY if memory is None else memory

    def push(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Tuples already sorted by key."""
        if not len(keys):
            return
        self.runs.append(_Run(keys, np.stack([positions, prefixes], axis=1), 0))
        while len(self.runs) >= FAN and all(r.level == self.runs[-1].level for r in self.runs[-FAN:]):
            merged = self.runs[-FAN:]
            pairs = [r.upto(r.front + len(r)) for r in merged]
            keys, values = (np.concatenate(x) for x in zip(*pairs))
            for r in merged:
                if r.stored:
                    r.values.drop()
            order = _order(keys)
            self.runs[-FAN:] = [_Run(keys[order], values[order], merged[-1].level + 1)]
        held = [r for r in self.runs if not r.stored]
        if self.scratch is not None and sum(map(len, held)) > self.memory:
            max(held, key=len).store(self.scratch)

    def least(self) -> int | None:
        """The least key."""
        return min((r.first for r in self.runs), default=None)

    def peek(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and (position, prefix) pairs of all tuples under a key, in order."""
        parts = [(r, r.end(below)) for r in self.runs if r.first < below]
        if not parts:
            return np.empty(0, np.int64), np.empty((0, 2), np.int32)
        pairs = [r.upto(e) for r, e in parts]
        if len(pairs) == 1:
            return pairs[0]
        keys, values = (np.concatenate(x) for x in zip(*pairs))
        if keys[0] == keys[-1] and keys.min() == keys.max():
            return keys, values
        order = _order(keys)
        return keys[order], values[order]

    def drop(self, below: int) -> None:
        self.runs = [r for r in self.runs if r.drop(below)]


class _Since:
    """Least common prefix of all scanned suffixes from any of them up to now: a stack with its least value first."""

    _top = np.array([2**31 - 1], np.int32)

    def __init__(self) -> None:
        self.at, self.value, self.count = np.empty(0, np.int64), self._top, 0

    def least(self, after: np.ndarray) -> np.ndarray:
        """Minimum over all scanned numbers greater than each of `after`; a large number if there are none."""
        return self.value[self.at.searchsorted(after, side="right")]

    def extend(self, prefixes: np.ndarray) -> None:
        falling = np.minimum.accumulate(prefixes[::-1])[::-1]
        changes = np.empty(len(falling), bool)
        changes[-1] = True
        np.not_equal(falling[1:], falling[:-1], out=changes[:-1])
        ends = changes.nonzero()[0]  # the last place of each value bounds how far it reaches
        keep = int(self.value.searchsorted(falling[0]))  # values grow towards the end of the stack
        self.at = np.concatenate([self.at[:keep], self.count + ends])
        self.value = np.concatenate([self.value[:keep], falling[ends], self._top])
        self.count += len(prefixes)


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for pairs first <= last, by a table of powers of two."""
    out = np.empty(len(first), values.dtype)
    size = last - first + 1
    level = np.frexp(size)[1] - 1
    table, step = values, 1
    for power in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == power)
        out[at] = np.minimum(table[first[at]], table[last[at] - step + 1])
        table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


def _scan(
    keys: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray, runs: np.ndarray, scratch: Scratch | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every seed and every suffix induced from what stands before it, in order of keys.

    `keys` is the letter of each position, so chosen that the scan goes upwards; `wanted` marks the
    positions to induce, whose key is never less than that of the suffix to their right. Within a key the
    induced come first. Gives positions, the common prefix of each with the one before, and which were induced.
    """
    queue, since = TupleQueue(scratch), _Since()
    last = np.full(int(keys.max(initial=0)) + 1, -1, dtype=np.int64)  # number of the last source of each key
    seed_keys = keys[seeds]
    taken, step = 0, STEP
    out_at: list[np.ndarray] = []
    out_prefix: list[np.ndarray] = []
    out_induced: list[np.ndarray] = []

    def feed(at: np.ndarray, prefixes: np.ndarray, left: np.ndarray, ok: np.ndarray, induced: np.ndarray) -> None:
        source = ok.nonzero()[0]
        begin = since.count
        if len(source):
            target = left[source]
            own = keys[target]
            order = _order(own)
            source, target, own = source[order], target[order], own[order]
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            prefix = np.empty(len(own), np.int32)
            later = (~fresh).nonzero()[0]
            prefix[later] = _range_least(prefixes, source[later - 1] + 1, source[later])
            head = fresh.nonzero()[0]
            before = last[own[head]]
            upto = np.minimum.accumulate(prefixes)[source[head]]
            prefix[head] = np.where(before < 0, -1, np.minimum(since.least(before), upto))
            last[own] = begin + source  # of equal keys the last one stays
            queue.push(own, target, prefix + 1)
        since.extend(prefixes)
        out_at.append(at)
        out_prefix.append(prefixes)
        out_induced.append(induced)

    def lefts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = at - 1
        return left, (left >= 0) & wanted[left]

    while True:
        key = queue.least()
        if taken < len(seeds):
            key = int(seed_keys[taken]) if key is None else min(key, int(seed_keys[taken]))
        if key is None:
            break
        # As many keys as `step` seeds span, so long as nothing induced falls among them.
        ahead = min(taken + step, len(seeds)) - 1
        high = max(key, int(seed_keys[ahead]) if ahead >= taken else key) + 1
        if high > key + 1:
            queue_keys, values = queue.peek(high)
            end = taken + int(seed_keys[taken:].searchsorted(high))
            all_keys = np.concatenate([queue_keys, seed_keys[taken:end]])
            at = np.concatenate([values[:, 0], seeds[taken:end]])
            left, ok = lefts(at)
            hit = int(keys[left[ok]].min()) if ok.any() else high
            if hit < high:
                step = max(64, step // 2)
                high = max(hit, key + 1)
            else:
                step = min(step * 2, 1 << 20)
            if hit > key:
                induced = np.arange(len(at)) < len(queue_keys)
                prefixes = np.concatenate([values[:, 1], seed_prefixes[taken:end]])
                use = np.flatnonzero(all_keys < high)
                use = use[_order(2 * all_keys[use] + ~induced[use])]
                at, prefixes, left, ok, induced = at[use], prefixes[use], left[use], ok[use], induced[use]
                border = np.flatnonzero(induced[:-1] & ~induced[1:] & (keys[at[:-1]] == keys[at[1:]])) + 1
                prefixes[border] = np.minimum(runs[at[border - 1]], runs[at[border]])
                feed(at, prefixes, left, ok, induced)
                taken += int(seed_keys[taken:].searchsorted(high))
                # What was just induced has keys of at least `high`, so it stays.
                queue.drop(high)
                continue
        # One key: what it induces under itself comes right after, round by round.
        before = -1
        while True:
            queue_keys, values = queue.peek(key + 1)
            if not len(queue_keys):
                break
            queue.drop(key + 1)
            at, prefixes = values[:, 0], values[:, 1]
            before = int(at[-1])
            left, ok = lefts(at)
            feed(at, prefixes, left, ok, np.ones(len(at), bool))
        end = taken + int(seed_keys[taken:].searchsorted(key + 1))
        if end > taken:
            at, prefixes = seeds[taken:end], seed_prefixes[taken:end].copy()
            if before >= 0:
                prefixes[0] = min(int(runs[before]), int(runs[at[0]]))
            left, ok = lefts(at)
            feed(at, prefixes, left, ok, np.zeros(len(at), bool))
            taken = end
    none = np.empty(0, np.int32)
    return (
        np.concatenate(out_at) if out_at else none, np.concatenate(out_prefix) if out_prefix else none,
        np.concatenate(out_induced) if out_induced else np.empty(0, bool),
    )


def _induce(
    text: np.ndarray, ends: int, is_s: np.ndarray, runs: np.ndarray, starts: np.ndarray, prefixes: np.ndarray,
    scratch: Scratch | None,
) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes but the ends in order, with common prefixes, from the order of the piece starts."""
    at, found, induced = _scan(text, ~is_s, starts, prefixes, runs, scratch)
    own = np.flatnonzero(induced)
    larger, prefix = at[own], found[own]
    # Downwards: a common prefix belongs to the upper of two neighbours, and letters count from the top.
    downwards = int(text.max()) - text
    seed_prefix = np.append(np.int32(0), prefix[::-1][:-1]).astype(np.int32) if len(prefix) else prefix
    at, found, _ = _scan(downwards, is_s & (text >= ends), larger[::-1], seed_prefix, runs, scratch)
    order = at[::-1]
    return order, np.append(np.int32(0), found[::-1][:-1]).astype(np.int32) if len(found) else found


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at `a` and `b`, of which `known` letters agree; ends differ from all else."""
    out = known.astype(np.int32)
    active = np.flatnonzero(a != b)
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        active = active[(x < len(text)) & (y < len(text))]
        x, y = a[active] + out[active], b[active] + out[active]
        active = active[text[x] == text[y]]
        out[active] += 1
    return out


def _rank_pieces(text: np.ndarray, is_s: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pieces, and which equal the one before. With the type beside the letter none is the start of another."""
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)  # of each place in the order: the first place that ties with it
    active = np.arange(len(starts))  # places that tie and have letters left
    top, offset = 2 * (int(text.max()) + 1), 0
    while len(active):
        own = order[active]
        at = starts[own] + offset
        key = group[active] * top + (2 * text[at] + is_s[at])
        by = np.argsort(key, kind="stable")
        order[active], key = own[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        first = active[fresh.nonzero()[0]][np.cumsum(fresh) - 1]
        group[active] = first
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        tied &= length[order[active]] > offset
        active = active[tied]
        offset += 1
    same = group != np.arange(len(starts))
    return order, same


def suffix_order(text: np.ndarray, ends: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes that start with a letter, in order, and the common prefix of each with the one before.

    Letters are numbers from `ends` on; smaller numbers are ends, each at most once and in rising order, one of them last.
    """
    n = len(text)
    if not (text >= ends).any():
        return np.empty(0, np.int32), np.empty(0, np.int32)
    stops = np.append((text[1:] != text[:-1]).nonzero()[0], n - 1).astype(np.int32)
    follow = np.repeat(stops, np.diff(stops, prepend=-1))  # last place of the run
    runs = (follow - np.arange(n, dtype=np.int32) + 1).astype(np.int32)
    is_s = np.append(text[1:] > text[:-1], True)[follow]
    starts = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    number = np.full(n, -1, np.int32)
    number[starts] = np.arange(len(starts), dtype=np.int32)
    length = np.append(starts[1:], n - 1) - starts  # a piece ends with the letter that starts the next
    closing = (text[starts] < ends).nonzero()[0]
    inside = (text[starts] >= ends).nonzero()[0]
    order, same = _rank_pieces(text, is_s, starts[inside], length[inside])
    pieces = starts[inside[order]]
    names = np.empty(len(starts), np.int32)
    names[closing] = text[starts[closing]]
    names[number[pieces]] = ends + np.cumsum(~same) - 1
    closing = starts[closing]

    if same.any():
        inner, inner_prefix = suffix_order(names, ends, scratch)
        sorted_starts = starts[inner]
        # `inner_prefix` whole pieces agree; what agrees of the next one is compared letter by letter.
        upper, lower = inner[:-1], inner[1:]
        known = starts[lower + inner_prefix[1:]] - starts[lower]
        prefixes = np.append(np.int32(0), _extend(text, starts[upper], starts[lower], known)) if len(inner) else inner_prefix
    else:
        sorted_starts = pieces
        prefixes = (
            np.append(np.int32(0), _extend(text, pieces[:-1], pieces[1:], np.zeros(max(0, len(pieces) - 1), np.int32)))
            if len(pieces) else np.empty(0, np.int32)
        )
    seeds = np.concatenate([closing, sorted_starts]).astype(np.int32)
    return _induce(text, ends, is_s, runs, seeds, np.concatenate([np.zeros(len(closing), np.int32), prefixes]).astype(np.int32), scratch)


def text_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as one text of numbers, and where each begins."""
    sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.empty(int(sizes.sum()), np.int32)
    stops = begin + sizes - 1
    letters = np.ones(len(text), bool)
    letters[stops] = False
    text[letters] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int32) + len(strings)
    text[stops] = np.arange(len(strings), dtype=np.int32)
    return text, begin
