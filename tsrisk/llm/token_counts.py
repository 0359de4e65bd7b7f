"""Token counts of texts under a unigram model of a public vocabulary.

The distinct words of a task are sorted, which is the depth-first order of their trie: each word shares its
leading characters with the one before, and the best scores of those prefixes are kept on a stack, so a shared
prefix is scored once. The count at the end of a word is stored, and texts add up the counts of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsrisk.llm.common import binary, by_bytes, ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Leads every word, as in the vocabulary's pieces.
MARK = "▁"
#: Words whose counts a task keeps; when it holds more, it starts over.
KEPT = 200_000


class Pieces(NamedTuple):
    score: dict[str, float]
    byte: float  # score of one byte of a character without a piece


def endings(score: dict[str, float]) -> dict:
    """The pieces as a trie read from their last character; a node holds its piece's score under the empty text."""
    root: dict = {}
    for piece, own in score.items():
        node = root
        for letter in reversed(piece):
            node = node.setdefault(letter, {})
        node[""] = own
    return root


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces of a sentencepiece vocabulary.

    Its order is by usefulness, so the log probabilities follow Zipf's law over
    the rank. Byte pieces stand in for characters without a piece, below all
    others.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))
    ]
    norm = math.log(sum(1.0 / (rank + 1) for rank in range(len(names))))
    score = {name: -math.log(rank + 1) - norm for rank, name in enumerate(names)}
    return Pieces(score, -math.log(len(names) + 1) - norm - math.log(256))


def best_counts(words: list[str], pieces: Pieces, ends: dict | None = None) -> list[tuple[int, float]]:
    """Tokens and score of the best segmentation of each of the sorted words.

    Of equal scores the one with fewer tokens is best. The stack holds, for each
    prefix of the present word, its best score and token count.
    """
    ends = endings(pieces.score) if ends is None else ends
    best, tokens = [0.0], [0]
    before = ""
    out = []
    for word in words:
        text = MARK + word
        shared = 0
        for a, b in zip(before, text):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            top, count = -math.inf, 0
            start, node = end - 1, ends.get(text[end - 1])
            alone = node is not None and "" in node
            while node is not None:
                own = node.get("")
                if own is not None:
                    total = best[start] + own
                    if total > top or (total == top and tokens[start] + 1 < count):
                        top, count = total, tokens[start] + 1
                start -= 1
                node = node.get(text[start]) if start >= 0 else None
            if not alone:
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                total = best[end - 1] + size * pieces.byte
                if total > top:
                    top, count = total, tokens[end - 1] + size
            best.append(top)
            tokens.append(count)
        before = text
        out.append((tokens[-1], best[-1]))
    return out


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`doc_id, n_words, n_tokens, log_score`, a row per row of `docs`.

    Words are runs without white space (x20, x09-x0D) and are segmented one by
    one. A null or empty text has none. Characters without a piece count a token
    for each byte. Repeated rows give repeated rows, an empty table an empty
    result, and other columns play no part. `path` is read on the driver.
    """
    ship(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_pieces(path)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        ends = endings(pieces.score)
        held: dict[bytes, tuple[int, float]] = {}
        for batch in by_bytes(batches, "text", 4 << 20):
            split = [t.split() if t else [] for t in binary(batch.column("text"))]
            new = set().union(*split) - held.keys() if split else set()
            if len(held) + len(new) > KEPT:
                held.clear()
                new = set().union(*split)
            ordered = sorted((w.decode("utf-8", "replace"), w) for w in new)
            held.update(zip((w for _, w in ordered), best_counts([t for t, _ in ordered], pieces, ends)))
            found = [[held[w] for w in words] for words in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([sum(n for n, _ in f) for f in found], pa.int64()),
                    pa.array([math.fsum(s for _, s in f) for f in found], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_tokens", "log_score"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, log_score double")
