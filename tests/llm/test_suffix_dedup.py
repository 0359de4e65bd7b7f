import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tsrisk.llm import induced, suffix_dedup as sd
from tsrisk.llm.queries import QUERIES


def brute_spans(texts, length=200):
    """Runs of covered bytes of each text, by counting every window."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = [i for i in range(len(b) + 1) if (i < len(b) and covered[i]) != (i > 0 and covered[i - 1])]
        out.append((b, list(zip(runs[::2], runs[1::2]))))
    return out


def brute(docs):
    rows = []
    for (i, _), (b, runs) in zip(docs, brute_spans([t for _, t in docs])):
        stops = [0, *(p for r in runs for p in r), len(b)]
        left = b"".join(b[x:y] for x, y in zip(stops[::2], stops[1::2]))
        rows.append((i, len(b), len(b) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted([(*r[:4], hashlib.sha256(bytes(r[4])).hexdigest()) for r in rows], key=str)


def near_copies(seed, groups=4, copies=6):
    """Texts that share long passages, with edits at random places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    line = " ".join(word() for _ in range(20))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(100, 300))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            text = " ".join(own)
            at = rng.randrange(len(text))
            out.append(text[:at] + line + text[at:])
    return out


def naive_order(text, ends):
    text = list(text)
    order = sorted((i for i, c in enumerate(text) if c >= ends), key=lambda i: text[i:])
    common = lambda a, b: next(k for k in range(len(text)) if text[a + k] != text[b + k])
    return order, [0, *(common(a, b) for a, b in zip(order, order[1:]))]


@pytest.mark.parametrize("seed", range(60))
def test_induced_order_and_common_prefixes(seed, monkeypatch, tmp_path):
    """Against plain sorting; with a queue that writes nearly everything to its scratch folder."""
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3, 8, 256])
    strings = [bytes(rng.choices(range(letters), k=rng.randint(1, rng.choice([3, 10, 90])))) for _ in range(rng.randint(1, 8))]
    strings += strings[:2] * (seed % 3) + [strings[0] * 5] * (seed % 2)
    monkeypatch.setattr(induced, "STEP", rng.choice([1, 2, 64, 1024]))
    monkeypatch.setattr(induced, "MEMORY", rng.choice([0, 8, 1 << 20]))
    text, _ = induced.text_of(strings)
    scratch = induced.Scratch(f"file://{tmp_path}")
    order, prefix = induced.suffix_order(text, len(strings), scratch)
    scratch.close()
    assert (order.tolist(), prefix.tolist()) == naive_order(text.tolist(), len(strings))
    assert not list(tmp_path.iterdir())


def test_queue_keeps_arrival_order(tmp_path):
    rng = np.random.default_rng(3)
    queue, expected = induced.TupleQueue(induced.Scratch(str(tmp_path)), memory=50), []
    for step in range(60):
        keys = np.sort(rng.integers(step, step + 30, 20)).astype(np.int64)
        at = np.arange(20 * step, 20 * step + 20, dtype=np.int32)
        queue.push(keys, at, at)
        expected += list(zip(keys.tolist(), at.tolist()))
        found = queue.peek(step + 1)
        queue.drop(step + 1)
        due = sorted(e for e in expected if e[0] <= step)
        expected = [e for e in expected if e[0] > step]
        assert list(zip(found[0].tolist(), found[1][:, 0].tolist())) == due


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_every_window_stands_in_one_string(piece, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", piece)
    texts = [t.encode() for t in near_copies(1)[:5]] + [b"", b"a" * 199, b"a" * 200, b"a" * 777, b"ab" * 400]
    row, at, size, off, h, s = sd.strings_of(texts)
    windows = Counter((r, p) for r, a, z in zip(row, at, size) for p in range(a, a + z - 199))
    assert windows == Counter((r, p) for r, t in enumerate(texts) for p in range(len(t) - 199))
    by_core, by_string, group = {}, {}, {}
    for r, a, z, o, x, y in zip(row, at, size, off, h, s):
        body = texts[r][a : a + z]
        assert by_core.setdefault(x, body[o : o + sd.CORE]) == body[o : o + sd.CORE]
        assert by_string.setdefault(y, body) == body
        for p in range(z - 199):  # equal windows fall into one group
            assert group.setdefault(body[p : p + 200], x) == x


def test_halves_part_the_windows():
    body = bytes(random.Random(4).choices(range(256), k=400))
    for off in (20, 60, 120, 144):
        whole = body[: off + 200]
        todo, seen = [(whole, off, sd.LENGTH - sd.CORE, 0)], Counter()
        while todo:
            part, at, slack, first = todo.pop()
            if slack == 0:
                assert len(part) == 200
                seen[first] += 1
                continue
            for _, _, inner, a, o, left in sd.halves(part, at, slack):
                core = 200 - left
                assert all(o >= p and o + core <= p + 200 for p in range(len(inner) - 199))
                todo.append((inner, o, left, first + a))
        assert seen == Counter(range(len(whole) - 199))


def test_runs_neither_overlap_nor_touch():
    rows, at, end = np.array([2, 0, 0, 0, 2, 1]), np.array([5, 3, 0, 9, 0, 10]), np.array([9, 7, 3, 10, 2, 12])
    found = sd.merged(rows, at, end, np.array([10, 12, 9, 4]))
    assert list(zip(*(x.tolist() for x in found))) == [(0, 0, 7), (0, 9, 10), (1, 10, 12), (2, 0, 2), (2, 5, 9)]
    assert all(len(x) == 0 for x in sd.merged(rows[:0], at[:0], end[:0], np.array([3])))


@pytest.mark.parametrize("limit", [512, 3])
def test_near_copies_and_a_common_line(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(sd, "GROUP_STRINGS", limit)
    monkeypatch.setattr(sd, "SHARD_BYTES", 20_000)
    docs = list(enumerate(near_copies(limit)))
    found = sd.remove_repeats(docs_of(*docs).repartition(5))
    assert got(found) == brute(docs)
    assert sum(r[2] for r in got(found)) > 0


def test_repeats_inside_a_text_and_borders(spark, docs_of):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    a, b, c = noise(200), noise(199), noise(230)
    docs = [
        (1, a + "x" + a), (2, noise(50) + b), (3, b + noise(70)), (4, c + c[:100]), (5, "=" * 450), (6, "line of words\n" * 60),
        (7, c), (8, "é" * 150), (9, "é" * 99), (10, None), (11, ""), (None, noise(300)), (12, noise(300) + "é" + a[:199]),
    ]
    assert got(sd.remove_repeats(docs_of(*docs).repartition(3))) == brute(docs)


def test_repeated_rows_null_ids_and_empty(spark, docs_of):
    rng = random.Random(5)
    long, short = "".join(rng.choices("abc ", k=900)), "short"
    docs = [(1, long), (1, long), (None, long + "x"), (None, short), (2, short), (3, "".join(rng.choices("xyz", k=400)))]
    assert got(sd.remove_repeats(docs_of(*docs))) == brute(docs)
    assert got(sd.remove_repeats(docs_of(*docs).limit(0))) == []


def test_very_long_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1 << 14)
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh", k=60_000))
    docs = [(1, long), (2, long[20_000:21_000]), (3, long[:40_000][::-1] + long[59_000:])]
    assert got(sd.remove_repeats(docs_of(*docs))) == brute(docs)


def test_query(spark, folder, texts):
    found = [tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, folder).collect()]
    assert sorted(found, key=str) == brute(list(texts.items()))
