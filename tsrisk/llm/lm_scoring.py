"""Log-bilinear language model, trained by noise-contrastive estimation.

The next token's group, and the token inside its group, are scored by the inner product of an output vector
with a prediction that is linear in the vectors of the tokens before it. Frequent words have outputs of their
own; all others share one group and are told apart by their smoothed counts, so the probabilities of all
possible tokens sum to one. Training visits every training text once: in each round the tasks start from the
same parameters, follow the noise-contrastive gradient over their own texts in numpy, and the results are
averaged, weighted by tokens. Counts of all words are exact; only a table of the most frequent words is
broadcast, and the counts of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsrisk.llm.common import binary, by_bytes, ship
from tsrisk.llm.shingles import word_hashes
from tsrisk.session import stage

#: Words with outputs of their own: GROUPS groups of GROUP_WORDS, by frequency.
GROUPS, GROUP_WORDS = 16, 64
#: Words with context vectors of their own, tokens of context, and length of all vectors.
CONTEXT_WORDS, CONTEXT, DIM = 8192, 3, 12
#: Most frequent words whose counts are broadcast, at the most.
TABLE_WORDS = 1 << 19
#: Rounds of averaging; each training text is visited in one of them.
ROUNDS = 4
RATE = 0.1
#: Tokens of a step, and steps that the whole input makes at least: a small input takes more and smaller steps.
BATCH, LEAST_BATCH, STEPS = 4096, 256, 1024
NOISE_GROUPS, NOISE_WORDS = 16, 8
#: Tokens that a task should see in a round; smaller inputs are trained in fewer tasks.
TASK_TOKENS = 1_000_000
#: Added to each count, and to the count of all unseen words together.
SMOOTH = 0.1

REST, END = GROUPS, GROUPS + 1
#: Place by frequency of tokens that have none: the end, and words outside the table.
NO_RANK = 1 << 40
#: Stands for the end token among the hashes of words.
END_HASH = np.uint64(0x5E4D_0F7E_3A1C_9B27)
_CHUNK = 4096
#: Distinct words of several texts that a task merges before they leave it.
_MERGE = 500_000
_ONE_GROUP, _ONE_WORD = np.eye(GROUPS + 2, dtype=np.float32), np.eye(GROUP_WORDS, dtype=np.float32)


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and the number of tokens of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(words) + len(counts), END_HASH, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words
    return out, counts + 1


def count_words(docs: DataFrame, training: Column) -> DataFrame:
    """`word, n`: the count of every token, by 64-bit hash, over all training rows."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, where = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([n for _, n in parts]), len(word)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in by_bytes(batches, "text", 2 << 20):
            parts.append(np.unique(_tokens(binary(batch.column("text")))[0], return_counts=True))
            held += len(parts[-1][0])
            if held > _MERGE:
                yield merged(parts)
                parts, held = [], 0
        if parts:
            yield merged(parts)

    return docs.filter(training).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Table(NamedTuple):
    """The most frequent words, sorted by hash, and what is known of all others."""

    word: np.ndarray
    n: np.ndarray
    rank: np.ndarray  # place by frequency
    total: int
    distinct: int
    within: str  # SQL condition on `word, n` for the words that are in the table


def frequent(counts: DataFrame) -> Table:
    """The words down to the count at which the table is full; a histogram of a few hundred bins finds it.

    Of the last bin, which does not fit whole, the table has a share by hash. The end token is in the table
    whatever its count, as it has a group of its own.
    """
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    within, held = "false", 0
    for row in sorted(bins.collect(), key=lambda r: -r.bin):
        if held + row.words > TABLE_WORDS:
            share = -(-row.words // max(1, TABLE_WORDS - held))
            within = f"{within} or (n >= {row.least} and pmod(word, {share}) = 0)"
            break
        held += row.words
        within = f"n >= {row.least}"
    within = f"({within}) or word = {int(END_HASH)}"
    if not sums.n:
        empty = np.zeros(0, np.int64)
        return Table(empty.view(np.uint64), empty, empty, 0, 0, within)
    rows = counts.filter(within).toArrow()
    word, n = (rows.column(c).to_numpy() for c in ("word", "n"))
    word = word.view(np.uint64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    rank = np.empty(len(word), np.int64)
    is_end = word == END_HASH
    rank[np.lexsort((word, -n, is_end))] = np.arange(len(word))
    rank[is_end] = NO_RANK
    return Table(word, n, rank, int(sums.n), int(sums.v), within)


class Model:
    """Parameters, kept as one float32 array that can be averaged, and views into it."""

    SHAPES = {
        "context": (CONTEXT_WORDS + 2, DIM), "place": (CONTEXT, DIM), "group": (GROUPS + 2, DIM), "group_bias": (GROUPS + 2,),
        "out": (GROUPS * GROUP_WORDS, DIM), "out_bias": (GROUPS * GROUP_WORDS,),
    }

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.part, at = flat, {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.part[name] = flat[at : at + size].reshape(shape)
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, group_share: np.ndarray, word_share: np.ndarray) -> Model:
        """Small random vectors from a fixed seed, biases at the log frequencies."""
        draw = np.random.default_rng(7)
        model = cls((draw.standard_normal(cls.size()) * 0.1).astype(np.float32))
        model.part["place"][:] = 1.0 / CONTEXT
        model.part["group_bias"][:] = np.log(group_share)
        model.part["out_bias"][:] = np.log(word_share.ravel())
        return model


def _places(table: Table, tokens: np.ndarray) -> np.ndarray:
    """Index of each token in the table, -1 where it is not there."""
    if not len(table.word):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(table.word, tokens), len(table.word) - 1)
    return np.where(table.word[at] == tokens, at, -1)


def _shares(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed share of each group, and of each word inside its group."""
    words = np.zeros(GROUPS * GROUP_WORDS)
    own = (table.rank < len(words)) & (table.word != END_HASH)
    words[table.rank[own]] = table.n[own]
    end = float(table.n[table.word == END_HASH].sum())
    groups = np.concatenate([words.reshape(GROUPS, GROUP_WORDS).sum(axis=1), [table.total - words.sum() - end, end]]) + 1.0
    inside = words.reshape(GROUPS, GROUP_WORDS) + SMOOTH
    return groups / groups.sum(), inside / inside.sum(axis=1, keepdims=True)


class Stream(NamedTuple):
    """Tokens of several texts with their contexts."""

    group: np.ndarray
    word: np.ndarray  # output number, meaningful for the groups of words
    context: np.ndarray  # (CONTEXT, tokens) context numbers
    place: np.ndarray  # index in the table, -1 outside
    tokens: np.ndarray
    counts: np.ndarray


def _stream(table: Table, texts: list[bytes | None]) -> Stream:
    tokens, counts = _tokens(texts)
    place = _places(table, tokens)
    rank = np.where(place >= 0, table.rank[place] if len(table.rank) else 0, NO_RANK)
    is_end = tokens == END_HASH
    words = GROUPS * GROUP_WORDS
    group = np.where(is_end, END, np.where(rank < words, rank // GROUP_WORDS, REST)).astype(np.uint8)
    # Each text is led by CONTEXT start marks, so no context reaches into the text before.
    shift = np.repeat(np.arange(1, len(counts) + 1) * CONTEXT, counts)
    padded = np.full(len(tokens) + CONTEXT * len(counts), CONTEXT_WORDS + 1, np.int32)
    at = np.arange(len(tokens)) + shift
    padded[at] = np.minimum(np.where(is_end, CONTEXT_WORDS, rank), CONTEXT_WORDS)
    context = np.stack([padded[at - j - 1] for j in range(CONTEXT)]) if len(tokens) else np.zeros((CONTEXT, 0), np.int32)
    return Stream(group, np.minimum(rank, words - 1), context, place, tokens, counts)


def _predicted(part: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    q = part["context"][context[0]] * part["place"][0]
    for j in range(1, CONTEXT):
        q += part["context"][context[j]] * part["place"][j]
    return q


def _runs(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each word group in a batch with the places of its tokens."""
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if bounds[g] < bounds[g + 1]:
            yield g, order[bounds[g] : bounds[g + 1]]


def _contrast(q, own_vector, own_score, own_noise, noise_vector, noise_bias, noise_log) -> tuple:
    """Gradient of the noise-contrastive objective: for the token, for each noise sample, and for the prediction.

    All tokens of a batch share the samples, so both are matrix products.
    """
    k = np.float32(np.log(len(noise_log)))
    miss = 1.0 / (1.0 + np.exp(np.clip(own_score - own_noise - k, -30, 30)))
    hit = 1.0 / (1.0 + np.exp(-np.clip(q @ noise_vector.T + noise_bias - noise_log - k, -30, 30)))
    return miss, hit, miss[:, None] * own_vector - hit @ noise_vector


class Trainer:
    """Adaptive-gradient steps over one task's texts."""

    def __init__(self, model: Model, table: Table, rate: float, seed: int) -> None:
        self.part, self.rate, self.draw = model.part, rate, np.random.default_rng(seed)
        self.table = table
        self.seen = {name: np.full(p.shape, 1e-7, np.float32) for name, p in model.part.items()}
        self.group_share, self.word_share = _shares(table)
        self.log_group, self.log_word = (np.log(x).astype(np.float32) for x in (self.group_share, self.word_share))
        self.size = min(BATCH, max(LEAST_BATCH, table.total // STEPS))
        self.tokens = 0

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        seen = self.seen[name]
        seen[rows] += gradient * gradient
        self.part[name][rows] += self.rate * gradient / np.sqrt(seen[rows])

    def batch(self, group: np.ndarray, word: np.ndarray, context: np.ndarray) -> None:
        p, n = self.part, len(group)
        q = _predicted(p, context)
        log_group = self.log_group
        noise = self.draw.choice(GROUPS + 2, NOISE_GROUPS, p=self.group_share)
        own = p["group"][group]
        score = np.einsum("ij,ij->i", q, own) + p["group_bias"][group]
        miss, hit, dq = _contrast(q, own, score, log_group[group], p["group"][noise], p["group_bias"][noise], log_group[noise])
        one = -hit @ _ONE_GROUP[noise]
        one[np.arange(n), group] += miss
        self._step("group", one.T @ q / n)
        self._step("group_bias", one.sum(axis=0) / n)
        for g, at in _runs(group):
            first = g * GROUP_WORDS
            rows = slice(first, first + GROUP_WORDS)
            log_word = self.log_word[g]
            drawn = self.draw.choice(GROUP_WORDS, NOISE_WORDS, p=self.word_share[g])
            vectors, bias, qg, target = p["out"][rows], p["out_bias"][rows], q[at], word[at] - first
            score = np.einsum("ij,ij->i", qg, vectors[target]) + bias[target]
            miss, hit, more = _contrast(qg, vectors[target], score, log_word[target], vectors[drawn], bias[drawn], log_word[drawn])
            dq[at] += more
            one = -hit @ _ONE_WORD[drawn]
            one[np.arange(len(at)), target] += miss
            self._step("out", one.T @ qg / n, rows)
            self._step("out_bias", one.sum(axis=0) / n, rows)
        d_place = np.stack([np.einsum("ij,ij->j", dq, p["context"][context[j]]) for j in range(CONTEXT)])
        back, where = (p["place"].T[:, :, None] * dq.T[:, None]).reshape(DIM, -1), context.ravel()
        used = np.flatnonzero(np.bincount(where, minlength=CONTEXT_WORDS + 2))
        d_context = np.stack([np.bincount(where, b, CONTEXT_WORDS + 2)[used] for b in back], axis=1)
        self._step("context", (d_context / n).astype(np.float32), used)
        self._step("place", d_place / n)
        self.tokens += n

    def texts(self, texts: list[bytes | None]) -> None:
        s = _stream(self.table, texts)
        for at in range(0, len(s.group), self.size):
            part = slice(at, at + self.size)
            self.batch(s.group[part], s.word[part], s.context[:, part])


def train(docs: DataFrame, training: Column, table: Table, rounds: int = ROUNDS) -> Model:
    """A model averaged over all tasks, `rounds` times; in a round each task follows its own texts of that round."""
    spark = docs.sparkSession
    model = Model.start(*_shares(table))
    chunks = -(-len(model.flat) // _CHUNK)
    tasks = max(1, table.total // (rounds * TASK_TOKENS))  # never more than the input has
    for number in range(rounds):
        chosen = training & (F.pmod(F.xxhash64("text"), F.lit(rounds)) == number)
        shared = spark.sparkContext.broadcast((model.flat, tuple(table)))
        rate = RATE / (1 + number)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            flat, known = shared.value
            own = Model(flat.copy())
            trainer = Trainer(own, Table(*known), rate, TaskContext.get().partitionId())
            for batch in by_bytes(batches, "text", 2 << 20):
                trainer.texts(binary(batch.column("text")))
            if trainer.tokens:
                sums = (own.flat * np.float32(trainer.tokens)).astype(np.float64)
                parts = [sums[k * _CHUNK : (k + 1) * _CHUNK].astype(np.float32).tobytes() for k in range(chunks)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(chunks), pa.int32()), pa.array([trainer.tokens] * chunks, pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["chunk", "tokens", "values"],
                )

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of each chunk, row by row as they come."""
            sums: dict[int, list] = {}
            for batch in batches:
                for chunk, tokens, values in zip(*(c.to_pylist() for c in batch.columns)):
                    held = sums.setdefault(chunk, [0, 0.0])
                    held[0] += tokens
                    held[1] = held[1] + np.frombuffer(values, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sums, pa.int32()), pa.array([h[0] for h in sums.values()], pa.int64()),
                    pa.array([(h[1] / h[0]).astype(np.float32).tobytes() for h in sums.values()], pa.binary()),
                ],
                names=["chunk", "tokens", "values"],
            )

        schema = "chunk int, tokens long, values binary"
        trained = docs.filter(chosen).select("text").coalesce(tasks).mapInArrow(run, schema)
        means = trained.repartition("chunk").mapInArrow(add, schema)
        found = sorted(means.collect(), key=lambda r: r.chunk)  # one row for each chunk of the parameters
        if found:
            model = Model(np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]).copy())
    return model


def _log_softmax_at(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of one column in each row."""
    scores = scores - scores.max(axis=1, keepdims=True)
    return scores[np.arange(len(at)), at] - np.log(np.exp(scores).sum(axis=1))


def log_probabilities(model: Model, group: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log of each token's group and place in it; normalised, by products of whole batches."""
    p, out = model.part, np.zeros(len(group))
    for start in range(0, len(group), BATCH):
        part = slice(start, start + BATCH)
        g, w = group[part], word[part]
        q = _predicted(p, context[:, part])
        found = _log_softmax_at(q @ p["group"].T + p["group_bias"], g)
        for number, at in _runs(g):
            rows = slice(number * GROUP_WORDS, (number + 1) * GROUP_WORDS)
            found[at] += _log_softmax_at(q[at] @ p["out"][rows].T + p["out_bias"][rows], w[at] - rows.start)
        out[part] = found
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's tokens; every text has at least its end."""
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def score(docs: DataFrame, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, n_tokens, n_known, train_tokens, base_score, score`, a row per row of `docs`.

    Learns from the rows where `training` holds and scores every whole text.
    Scores are log10 probabilities: `base_score` by smoothed counts alone,
    `score` by the model. A null or empty text is one end token. Without any
    training row every count is 0 and the model keeps its first parameters.
    Rows that share an id are scored each; repeated rows give repeated rows, an
    empty table an empty result, and other columns play no part. Words are
    counted by 64-bit hashes.
    """
    ship(docs)
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", training.alias("training"))
    counts = stage(count_words(rows, F.col("training")), "lm-counts")
    table = frequent(counts)
    model = train(rows, F.col("training"), table, rounds)
    own = table.rank < GROUPS * GROUP_WORDS
    end = table.word == END_HASH
    # Smoothed mass of the words that share the last group, the unseen ones among them.
    all_mass = table.total + SMOOTH * (table.distinct + 1)
    rest_mass = all_mass - float((table.n[own | end] + SMOOTH).sum())
    log_base, log_rest = float(np.log10(all_mass)), float(np.log10(max(rest_mass, SMOOTH)))
    shared = spark.sparkContext.broadcast((model.flat, tuple(table)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known = shared.value
        held, lm = Table(*known), Model(flat)
        logs = np.log10(held.n + SMOOTH)
        partition, number = TaskContext.get().partitionId() << 36, 0
        for batch in by_bytes(batches, "text", 2 << 20):
            s = _stream(held, binary(batch.column("text")))
            inside = s.place >= 0
            log_count = np.where(inside, logs[s.place] if len(logs) else 0.0, 0.0)
            # A word of the table is in its own group or in the last; those outside are always in the last.
            logp = log_probabilities(lm, s.group, s.word, s.context) / np.log(10)
            whole = _sums(logp + np.where((s.group == REST) & inside, log_count - log_rest, 0.0), s.counts)
            ends = np.cumsum(_sums((~inside).astype(np.int64), s.counts))
            outside = np.split(s.tokens[~inside].view(np.int64), ends[:-1]) if len(ends) else []
            tails = [np.unique(x, return_counts=True) for x in outside]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(partition + number + np.arange(n)), batch.column("doc_id"), pa.array(s.counts.astype(np.int64)),
                    pa.array(_sums(inside.astype(np.int64), s.counts)), pa.array(_sums(log_count, s.counts) - s.counts * log_base),
                    pa.array(whole), *[pa.array([t[k] for t in tails], pa.list_(pa.int64())) for k in (0, 1)],
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "times"],
            )
            number += n

    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, word array<long>, times array<long>"
    scored = stage(rows.select("doc_id", "text").mapInArrow(run, schema), "lm-scored")
    # Words outside the table: their counts are joined, and what they add is summed for each row.
    tail = scored.select("row", F.explode(F.arrays_zip("word", "times")).alias("t")).select("row", "t.word", "t.times")
    rare = counts.filter(f"not ({table.within})")
    n = F.coalesce(F.col("n"), F.lit(0))
    added = tail.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("more"),
    )
    joined = scored.drop("word", "times").join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(table.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("score") + more - log_rest * (F.col("n_tokens") - F.col("n_known"))).alias("score"),
    )
