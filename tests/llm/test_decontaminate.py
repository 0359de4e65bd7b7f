import random

from tsrisk.llm import decontaminate as D
from tsrisk.llm.queries import QUERIES


def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + pattern[rng.randint(0, 5) :]
        assert D.least_distance(pattern, text, len(pattern)) == distance(pattern, text)


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(2)
    items = [D.Item(i, " ".join(rng.choice(["the", "of", "cat", "dog", "house"]) for _ in range(30)), 0) for i in range(6)]
    items = [D.Item(i, t, int(len(t) * D.ERROR_RATE)) for i, t, _ in items]
    finder = D.Finder(items)
    for _ in range(60):
        item = rng.choice(items)
        text = list(item.text)
        for _ in range(rng.randint(0, item.budget + 3)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        body = "before it " + "".join(text) + " and after"
        body = D.normal(body)
        want = [(i.item_id, distance(i.text, body)) for i in items if distance(i.text, body) <= i.budget]
        assert finder.find(body) == want


def test_edges(spark, docs_of):
    items = spark.createDataFrame(
        [(1, "Some Benchmark  Question about\nlife"), (2, None), (3, "  "), (None, "An item without id here"), (1, "Second text of one id"), (4, "tiny"), (4, "tiny")],
        "item_id long, text string",
    )
    rows = [(1, "x some benchmark question about LIFE y"), (2, None), (3, ""), (4, "an item without id here; second text of one id"), (5, "a tiny one"), (5, "a tiny one"), (6, "clean " * 30_000)]
    got = sorted((r.doc_id, [(h.item_id, h.distance) for h in r.hits]) for r in D.find_leaks(docs_of(*rows), items).collect())
    assert got == [(1, [(1, 0)]), (2, []), (3, []), (4, [(1, 0), (None, 0)]), (5, [(4, 0)]), (5, [(4, 0)]), (6, [])]
    assert D.find_leaks(docs_of(*rows).limit(0), items).count() == 0
    assert all(r.hits == [] for r in D.find_leaks(docs_of(*rows), items.limit(0)).collect())


def test_item_ids_may_be_text(spark, docs_of):
    items = spark.createDataFrame([("b", "benchmark item two"), ("a", "benchmark item one"), (None, "an item of no name")], "item_id string, text string")
    (row,) = D.find_leaks(docs_of((1, "benchmark item one, benchmark item two, an item of no name")), items).collect()
    assert [(h.item_id, h.distance) for h in row.hits] == [("a", 0), ("b", 0), (None, 0)]


def test_items_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([(i, f"benchmark item number {i} in full") for i in range(8)], "item_id long, text string")
    rows = [(i, f"text with benchmark item number {i} in full here") for i in range(8)]
    got = {r.doc_id: {h.item_id for h in r.hits if h.distance == 0} for r in D.find_leaks(docs_of(*rows), items).collect()}
    assert got == {i: {i} for i in range(8)}


def test_query(spark, folder, texts):
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    exact = {(d, i) for d, t in texts.items() for i, x in items if x in D.normal(t)}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op6_decontamination"](spark, folder).collect()}
    assert exact and {k for k, v in got.items() if v == 0} == exact
