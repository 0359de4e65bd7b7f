import random
from collections import Counter, defaultdict

import pytest

from tsrisk.llm import near_dedup
from tsrisk.llm.components import components
from tsrisk.llm.queries import QUERIES
from tsrisk.llm.shingles import shingle_sets

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sets_of(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component and set size of each row, by comparing all pairs that share a shingle."""
    sets, up = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    owners = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in owners[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            owners[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        name = least.get(top(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "one two"), (None, "one two"), (None, None)]
    rows += [(8, "a b c d e f"), (8, "x y z w v u"), (9, "x y z w v u"), (9, "x y z w v u"), (10, "a b c d e f"), (None, "lonely words without any id here")]
    assert got(near_dedup.near_duplicates(docs_of(*rows))) == brute(rows)
    assert near_dedup.near_duplicates(docs_of((1, "a")).limit(0)).count() == 0


def test_groups_chains_and_passages_equal_brute_force(docs_of):
    """Copies with many edits form chains and leave loners; a shared passage alone links nothing."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, edited(rng, base, rng.random() * 0.12)) for i in range(260)]
    rows += [(1000 + i, " ".join(f"q{rng.randint(0, 9999)}" for _ in range(45)) + " " + passage) for i in range(60)]
    rows += [(2000 + i, " ".join(base)) for i in range(30)]
    rng.shuffle(rows)
    want = brute(rows)
    assert len({r[2] for r in want}) > 70  # the group has loners, so every stage of the search is used
    assert got(near_dedup.near_duplicates(docs_of(*rows))) == want


def test_small_blocks_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 5)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 900)}" for _ in range(90)]
    rows = [(i, edited(rng, base, rng.random() * 0.12)) for i in range(120)]
    assert got(near_dedup.near_duplicates(docs_of(*rows))) == brute(rows)


def test_ids_may_be_text(docs_of):
    rows = [("b", "one two three"), ("a", "one two  three"), ("c", "something else here"), (None, "one two three")]
    df = docs_of((1, "")).sparkSession.createDataFrame(rows, "doc_id string, text string")
    want = [("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), (None, 1, "a", False)]
    assert got(near_dedup.near_duplicates(df)) == sorted(want, key=repr)


def test_one_row_of_each_component_stays(docs_of):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(4, "one two three"), (4, "one two three"), (4, "another text of that id"), (5, "ONE two three"), (None, "one two three"), (None, near), (None, near + " x"),
            (7, "another text of that id"), (8, None), (8, None), (9, ""), (None, "")]
    df = docs_of(*rows)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    unnamed = [r for r in left if r[0] is None and r[1]]
    assert len(unnamed) == 1 and unnamed[0][1] in (near, near + " x")
    assert [r for r in left if r not in unnamed] == sorted([(4, "one two three"), (4, "another text of that id"), (8, None), (9, ""), (None, "")], key=repr)
    assert near_dedup.deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), (b"z", b"z"), (b"b", b"a")] + [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "u binary, v binary")).collect())
    got = {bytes(k): bytes(v) for k, v in got.items()}
    assert got[b"a"] == got[b"b"] == got[b"c"] == b"a" and got[b"y"] == b"x" and b"z" not in got
    assert {got[b"%03d" % i] for i in range(41)} == {b"000"}
    assert components(spark.createDataFrame([], "u binary, v binary")).count() == 0


def test_shingle_sets_of_long_text():
    text = b" ".join(b"w%d" % (i % 5000) for i in range(200_000))
    assert len(shingle_sets([text, None, b"a b c d", b"A b c D"])[0]) == 5000
    assert (shingle_sets([b"a b c d"])[0] == shingle_sets([b"A b\nc D"])[0]).all()


def test_query(spark, folder, texts):
    assert got(QUERIES["op4_near_dedup"](spark, folder)) == brute(sorted(texts.items()))


@pytest.mark.parametrize("name", ["op4_near_dedup"])
def test_reruns_agree(spark, folder, name):
    assert got(QUERIES[name](spark, folder)) == got(QUERIES[name](spark, folder))
