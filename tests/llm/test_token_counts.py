import math

from tsrisk.llm import token_counts as T
from tsrisk.llm.queries import QUERIES


def segmented(word, pieces):
    """Best score and fewest tokens of one word, without any sharing."""
    text = T.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [
            (best[a][0] + pieces.score[text[a:end]], -best[a][1] - 1) for a in range(end) if text[a:end] in pieces.score
        ]
        if text[end - 1] not in pieces.score:
            size = len(text[end - 1].encode())
            options.append((best[end - 1][0] + size * pieces.byte, -best[end - 1][1] - size))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1], best[-1][0]


def test_shared_prefixes_equal_single_words():
    pieces = T.load_pieces()
    words = sorted({"the", "then", "thenx", "theatre", "", "ä", "ände", "日本", "日本語", "日x", "a" * 300, "zzz", "zz"})
    assert [(n, round(s, 6)) for n, s in T.best_counts(words, pieces)] == [
        (n, round(s, 6)) for n, s in (segmented(w, pieces) for w in words)
    ]


def test_edges(docs_of, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "the cat"), (5, "the\ncat"), (5, "the\ncat"), (6, "word " * 20_000), (7, "  日本")]
    got = sorted(tuple(r) for r in T.count_tokens(docs_of(*rows)).collect())
    pieces = T.load_pieces()
    for doc, words, tokens, score in got:
        split = [w.decode() for w in (dict(rows)[doc] or "").encode().split()]
        found = [segmented(w, pieces) for w in split]
        assert (words, tokens) == (len(split), sum(n for n, _ in found))
        assert math.isclose(score, sum(s for _, s in found), rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == len(rows) and T.count_tokens(docs_of((1, "a")).limit(0)).count() == 0


def test_query(spark, folder, texts):
    pieces, held = T.load_pieces(), {}
    for r in QUERIES["op8_token_counts"](spark, folder).collect():
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        for w in words:
            if w not in held:
                held[w] = segmented(w, pieces)[0]
        assert (r.n_words, r.n_tokens) == (len(words), sum(held[w] for w in words))
