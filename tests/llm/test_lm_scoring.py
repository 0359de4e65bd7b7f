import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsrisk.llm import lm_scoring as M
from tsrisk.llm.queries import QUERIES
from tsrisk.llm.shingles import word_hashes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def base_of(rows, trained):
    counts = Counter(t for doc, text in rows if trained(doc) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    score = lambda t: math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1)))
    return counts, total, {(doc, text): sum(map(score, tokens(text))) for doc, text in rows}


@pytest.mark.parametrize("table_words", [1 << 19, 9, 1])
def test_counts_and_base_scores(docs_of, monkeypatch, table_words):
    """With a table of a few words, nearly all counts are joined; both ways agree with plain counting."""
    monkeypatch.setattr(M, "TABLE_WORDS", table_words)
    rows = [(i, f"the cat number {i % 5} sat. And the DOG" + " far" * (i % 3)) for i in range(1, 40)]
    rows += [(50, None), (51, ""), (52, "unseen words only"), (53, "the " * 30_000), (54, "rare"), (54, "rare")]
    counts, total, base = base_of(rows, lambda i: i != 52)
    got = M.score(docs_of(*rows), F.col("doc_id") != 52, rounds=1).join(docs_of(*rows).select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(tokens(r.text)) and r.train_tokens == total
        assert r.n_known == sum(counts[t] > 0 for t in tokens(r.text))
        assert r.base_score == pytest.approx(base[r.doc_id, r.text])
        assert r.score < 0 and math.isfinite(r.score)


@pytest.mark.parametrize("table_words", [1 << 19, 9, 4, 1])
def test_scores_by_plain_recomputation(docs_of, monkeypatch, table_words):
    """The score of each token is that of its group and its place there; the words of the last group share it by their counts."""
    monkeypatch.setattr(M, "TABLE_WORDS", table_words)
    rows = [(i, f"the cat number {i % 5} sat. And the DOG" + " far" * (i % 3)) for i in range(1, 40)] + [(50, None), (51, "unseen the words")]
    trained = lambda i: i != 51
    docs = docs_of(*rows)
    table = M.frequent(M.count_words(docs, F.col("doc_id") != 51))
    model = M.Model.start(*M._shares(table))
    model.flat[:] += np.random.default_rng(3).normal(size=len(model.flat)).astype(np.float32) / 4
    monkeypatch.setattr(M, "train", lambda *_: model)
    counts, total, _ = base_of(rows, trained)
    hashes = {t: int(word_hashes([t])[0][0]) for t in counts if t is not None}
    rank = dict(zip(table.word.tolist(), table.rank.tolist()))
    assert int(M.END_HASH) in rank
    own = {t: rank[h] for t, h in hashes.items() if rank.get(h, M.NO_RANK) < M.GROUPS * M.GROUP_WORDS}
    rest = total + M.SMOOTH * (len(counts) + 1) - sum(counts[t] + M.SMOOTH for t in [*own, None])
    p = model.part

    def log_softmax(scores, at):
        return scores[at] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()

    def plain(text):
        past, score = [M.CONTEXT_WORDS + 1] * M.CONTEXT, 0.0
        for t in tokens(text):
            q = sum(p["context"][c] * p["place"][j] for j, c in enumerate(past)).astype(np.float64)
            r = own.get(t)
            group = M.END if t is None else M.REST if r is None else r // M.GROUP_WORDS
            score += log_softmax(p["group"] @ q + p["group_bias"], group) / np.log(10)
            if r is not None:
                inside = slice(group * M.GROUP_WORDS, (group + 1) * M.GROUP_WORDS)
                score += log_softmax(p["out"][inside] @ q + p["out_bias"][inside], r % M.GROUP_WORDS) / np.log(10)
            elif t is not None:
                score += math.log10((counts[t] + M.SMOOTH) / rest)
            past = [M.CONTEXT_WORDS if r is None else r, *past[:-1]]
        return score

    texts = dict(rows)
    for r in M.score(docs, F.col("doc_id") != 51).collect():
        assert r.score == pytest.approx(plain(texts[r.doc_id]), rel=1e-4), texts[r.doc_id]


def test_empty_tables(docs_of):
    assert M.score(docs_of((1, "a")).limit(0), F.lit(True)).count() == 0
    row = M.score(docs_of((1, "a b")), F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)


def test_probabilities_of_all_tokens_sum_to_one():
    words = GROUP = M.GROUPS * M.GROUP_WORDS
    table = M.Table(np.arange(1, words + 1, dtype=np.uint64), np.arange(words, 0, -1), np.arange(words), words * words, words, "true")
    model = M.Model.start(*M._shares(table))
    rng = np.random.default_rng(1)
    model.flat[:] += rng.normal(size=len(model.flat)).astype(np.float32)
    group = np.concatenate([np.repeat(np.arange(M.GROUPS), M.GROUP_WORDS), [M.REST, M.END]])
    context = np.tile(rng.integers(0, 50, (M.CONTEXT, 1)), (1, len(group)))
    logs = M.log_probabilities(model, group, np.append(np.arange(GROUP), [0, 0]), context)
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-4)


def test_training_learns_what_follows_what():
    """After `a` comes `b`, after `c` comes `d`: the model must tell them apart, which counts cannot."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a b", "c d"], 60)).encode() for _ in range(400)]
    words, n = np.unique(np.concatenate([M._tokens([t])[0] for t in texts]), return_counts=True)
    rank = np.empty(len(words), np.int64)
    end = words == M.END_HASH
    rank[np.lexsort((words, -n, end))] = np.arange(len(words))
    table = M.Table(words, n, rank, int(n.sum()), len(words), "true")
    model = M.Model.start(*M._shares(table))
    trainer = M.Trainer(model, table, M.RATE, 0)
    for _ in range(4):
        trainer.texts(texts)
    s = M._stream(table, [b"a b c d a b"])
    logs = M.log_probabilities(model, s.group, s.word, s.context)
    assert np.exp(logs[[1, 3, 5]]).min() > 0.6


def test_word_hashes():
    hashes, counts = word_hashes([b"The  cat\tthe", None, b"", b"THE", b" "])
    assert counts.tolist() == [3, 0, 0, 1, 0] and hashes[0] == hashes[2] == hashes[3] != hashes[1]


def test_query(spark, folder, texts):
    rows = sorted(texts.items())
    counts, total, base = base_of(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    got = QUERIES["op1_lm_scoring"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    for r in got:
        assert r.base_score == pytest.approx(base[r.doc_id, texts[r.doc_id]])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.train_tokens == total
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
