import hashlib

import pytest

from tsrisk.llm import mixing
from tsrisk.llm.queries import QUERIES


def brute(rows, weights=(1, 2, 3), epochs=3):
    """Targets by plain re-sharing, and what each row is given."""
    size = {i: len((t or "").encode().split()) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), float(sum(total.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= epochs * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(epochs * total[s])
            rest -= target[s]
        open_ -= full
    taken = {}
    for s in sources:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        key = lambda i: (int(hashlib.md5(f"mix-1|{'' if rows[i][0] is None else rows[i][0]}|{rows[i][1] or ''}".encode()).hexdigest()[:15], 16))
        budget = min(int(target[s] + 0.5), epochs * total[s])
        whole, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for i in sorted(own, key=key):
            more = max(0, min(size[i], left))
            taken[i] = whole * size[i] + more
            left -= size[i]
    return sorted((-1 if rows[i][0] is None else rows[i][0], size[i], total[rows[i][2]], round(target[rows[i][2]], 6), taken[i]) for i in taken)


def got_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_nulls_repeats_and_skew_equal_the_plain_way(docs_of):
    rows = [(i, "w " * (i % 7), "big") for i in range(1, 60)]
    rows += [(i, "a b c\td\x0be", f"s{i % 4}") for i in range(60, 80)]
    rows += [(90, "x y", None), (91, None, None), (None, "p q r", "s1"), (None, "p q r", "s1"), (92, "", "void"), (93, "one", "tiny")]
    rows += [(94, "same same", "big")] * 30
    df = docs_of(*[(i, t, "en", s) for i, t, s in rows])
    got = got_of(mixing.mix_sources(df))
    assert got == brute(rows)
    assert got == got_of(mixing.mix_sources(df.repartition(7)))
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_empty_and_carried_columns(docs_of):
    assert mixing.mix_sources(docs_of((1, "a")).limit(0)).count() == 0
    row = mixing.mix_sources(docs_of((1, "a b", "fr", "s")), carry=("lang", "text", "size")).first()
    assert (row.lang, row.text, row.taken) == ("fr", "a b", 2)


def test_words_taken_come_to_the_targets(spark, folder):
    rows = QUERIES["op2_mix_sources"](spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 1 for target, taken in by.values())
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(docs)
    assert sorted((r.doc_id, r["size"], r.taken) for r in rows) == [(a, b, e) for a, b, _, _, e in want]
    assert sorted(r.target for r in rows) == pytest.approx(sorted(w[3] for w in want))
