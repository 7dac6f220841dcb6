"""Language-model scoring with a hidden Markov model over words.

Observations are words (A-Z lower-cased, [^\\x20\\x09-\\x0D]+) and one end. The ``OWN`` most frequent words are symbols of
their own; any other word is one of ``CLASSES`` symbols, by a hash of its ending, times its share of the class,
(c + 1) / (N_class + V_class + 1), with c its count in the training documents. So the model gives every text a
probability, and unseen words have some.

Training: word counts over all training documents (combined before the shuffle); then Baum-Welch over all of them:
each task runs scaled forward-backward on its documents and sends its expected counts as dense blocks, which are summed
as streams; what the driver gets is one number per state and symbol, a size fixed by parameters. Start values come from
a few rounds of the same kind on a sample of whole documents of every length. Scoring: the scaled forward recursion
gives the exact likelihood of each whole symbol sequence.

The ``FREQUENT`` most frequent words are looked up in a table sent to every task (a fixed size); all other words meet
their counts in a shuffled join, however many there are.

Defined cases: a null, empty or blank text is the end alone; rows that repeat a doc_id are trained on and scored each;
a null doc_id is trained on (no remainder); without training documents N = V = 0 and start values are used; of a very
long text the recursions hold a stretch at a time and a state vector for each stretch; words of equal count rank by code
point; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import array_blocks, as_bytes, crc_mod, drop_written, summed, text_slices, words, written

STATES, OWN, CLASSES, FREQUENT = 8, 8192, 256, 65536
SAMPLE, SAMPLE_ROUNDS, ROUNDS = 400, 8, 2
SYMBOLS = OWN + CLASSES + 1
END = SYMBOLS - 1
PRIOR = 50.0
#: State vectors that the recursions hold at once.
CELLS = 400_000


def _count(most_held: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                held[b""] += batch.num_rows  # the end; no word is empty
                for text in as_bytes(batch.column("text")):
                    held.update(words(text))
                if len(held) > most_held:
                    yield out()
                    held.clear()
        yield out()

    return run


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Vocabulary:
    """The frequent words in falling order of count, and the totals of each class."""

    def __init__(self, words_: list[bytes], counts: list[int], total: int, distinct: int, ends: int):
        self.words, self.counts = words_, np.array(counts, np.float64)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)

    def tables(self):
        index = {w: i for i, w in enumerate(self.words)}
        symbol = np.array([i if i < OWN else OWN + ending_class(w) for i, w in enumerate(self.words)], np.int64)
        return index, symbol, np.log10(self.counts + 1), np.log10(self.class_n + self.class_v + 1)


_TABLES: dict = {}


def _tables(vocabulary: Vocabulary, mark: str):
    """Built once in each worker process for each fit."""
    if mark not in _TABLES:
        _TABLES.clear()
        _TABLES[mark] = vocabulary.tables()
    return _TABLES[mark]


def _class_totals(vocabulary: Vocabulary):
    own = set(vocabulary.words[:OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for word, count in zip(as_bytes(batch.column("word")), batch.column("n").to_pylist()):
                if word not in own:
                    c = ending_class(word)
                    n[c] += count
                    v[c] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["class", "n", "v"])

    return run


CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_counts double, log_class double, symbols binary, rare array<string>"


def _code(vocabulary: Vocabulary, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, symbol, log_count, log_size = _tables(vocabulary, mark)
        task, row = TaskContext.get().partitionId() << 40, 0
        end_log = float(np.log10(vocabulary.ends + 1))
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                n, known, logs, classes, coded, rare = [], [], [], [], [], []
                for text in as_bytes(batch.column("text")):
                    tokens = words(text)
                    at = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
                    seen = at >= 0
                    frequent = at[seen]
                    new = [tokens[i] for i in np.flatnonzero(~seen).tolist()]
                    s = np.empty(len(tokens) + 1, np.int64)
                    s[:-1][seen] = symbol[frequent]
                    s[:-1][~seen] = [OWN + ending_class(w) for w in new]
                    s[-1] = END
                    in_class = (s >= OWN) & (s < END)
                    n.append(len(s))
                    known.append(len(frequent) + (vocabulary.ends > 0))
                    logs.append(float(log_count[frequent].sum()) + end_log)
                    classes.append(float(log_count[frequent[symbol[frequent] >= OWN]].sum() - log_size[s[in_class] - OWN].sum()))
                    coded.append(s.astype("<u2").tobytes())
                    rare.append(new)
                rows = np.arange(row, row + batch.num_rows) + task
                row += batch.num_rows
                at = np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32)
                flat = pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(classes), pa.array(coded, pa.binary()), pa.ListArray.from_arrays(pa.array(at), flat)],
                    names=[x.split()[0] for x in CODED.split(", ")],
                )

    return run


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        noise = np.random.default_rng(seed).gamma(2.0, 0.5, (states, len(shares)))
        emit = shares * noise
        move = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def refit(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        emit = emit + PRIOR * shares
        move, start = move + 0.1, start + 0.1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _groups(sequences: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Indices by falling length, in groups whose padded size is bounded (one longer sequence is a group of its own)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        size = int(np.clip(most // max(1, len(sequences[order[at]])), 1, 1024))
        yield order[at : at + size]
        at += size


def _advance(model: Model, emit_of: np.ndarray, symbols: np.ndarray, live: list[int], begin: int, end: int, a: np.ndarray | None, total=None, alphas=None, scales=None) -> np.ndarray:
    """Scaled forward steps from begin to end; a is the state vector before begin (none at the start)."""
    for t in range(begin, end):
        n = live[t]
        a = (np.broadcast_to(model.start, (n, len(model.start))) if a is None else a[:n] @ model.move) * emit_of[symbols[t, :n]]
        c = a.sum(axis=1)
        a /= c[:, None]
        if total is not None:
            total[:n] += np.log(c)
        if alphas is not None:
            alphas[t - begin, :n], scales[t - begin, :n] = a, c
    return a


def forward(model: Model, sequences: list[np.ndarray], counts: bool = False, most: int = CELLS):
    """Natural-log likelihood of each sequence; with counts also the expected (start, move, emit) counts.

    For counts the forward pass keeps the state vectors at the begin of each stretch; the backward pass goes from stretch
    to stretch and runs the forward steps of one again, so about `most` vectors are held besides those.
    """
    k = len(model.start)
    out = np.zeros(len(sequences))
    emit_of = np.ascontiguousarray(model.emit.T)
    start_n, move_n, emit_n = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    back_move = model.move.T.copy()
    for group in _groups(sequences, most):
        lens = np.array([len(sequences[i]) for i in group])
        longest, g = int(lens[0]), len(group)
        symbols = np.full((longest, g), END, np.int32)
        for j, i in enumerate(group):
            symbols[: lens[j], j] = sequences[i]
        live = np.searchsorted(-lens, -np.arange(longest), side="left").tolist()  # sequences longer than t
        total, a, enter, span = np.zeros(g), None, {}, max(1, most // g)
        for t0 in range(0, longest, span):
            enter[t0] = a
            a = _advance(model, emit_of, symbols, live, t0, min(t0 + span, longest), a, total)
        out[group] = total
        if not counts:
            continue
        b = np.ones((g, k))
        for t0 in reversed(enter):
            t1 = min(t0 + span, longest)
            alphas, scales = np.empty((t1 - t0, g, k)), np.ones((t1 - t0, g))
            _advance(model, emit_of, symbols, live, t0, t1, enter[t0], None, alphas, scales)
            for t in range(t1 - 1, t0 - 1, -1):
                n = live[t]
                if t:
                    w = emit_of[symbols[t, :n]] * b[:n] / scales[t - t0, :n, None]
                    move_n += (alphas[t - t0 - 1, :n] if t > t0 else enter[t0][:n]).T @ w
                alphas[t - t0, :n] *= b[:n]
                if t:
                    b[:n] = w @ back_move
            if t0 == 0:
                start_n += alphas[0].sum(axis=0)
            valid = np.arange(t0, t1)[:, None] < lens
            flat, weight = symbols[t0:t1][valid], alphas[valid]
            for s in range(k):
                emit_n[s] += np.bincount(flat, weights=weight[:, s], minlength=emit_n.shape[1])
    return (out, start_n, move_n * model.move, emit_n) if counts else out


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _expect(model: Model):
    """Expected counts of a task as blocks of one array: start, move, emit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                _, *parts = forward(model, _sequences(batch.column("symbols")), counts=True)
                total = total + np.concatenate([p.ravel() for p in parts])
        if not np.isscalar(total):
            yield from array_blocks(total)

    return run


def _loglik(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = forward(model, _sequences(batch.column("symbols"))) / np.log(10) if batch.num_rows else np.zeros(0)
            rest = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(ll)], names=[*rest, "hmm"])

    return run


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) over whole texts; the end is the empty word."""
    return training.select("text").mapInArrow(_count(), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch on the rows of coded that are not held out."""
    shares = np.ones(SYMBOLS)
    top = vocabulary.counts[:OWN]
    shares[: len(top)] += top
    shares[OWN:END] += vocabulary.class_n
    shares[END] += vocabulary.ends
    shares /= shares.sum()
    model = Model.initial(shares, states)
    training = coded.where("not held_out")
    few = training.select("row", F.xxhash64("doc_id", "symbols").alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not few:
        return model
    sample = written(training.where(F.col("row").isin([r["row"] for r in few])).select("symbols"), "start-sample")
    for documents in [sample] * SAMPLE_ROUNDS + [training.select("symbols")] * rounds:
        flat = summed(documents.mapInArrow(_expect(model), "block int, values binary"), states + states**2 + states * SYMBOLS)
        a, b = states, states + states**2
        model = model.refit(flat[:a], flat[a:b].reshape(states, states), flat[b:].reshape(states, SYMBOLS), shares)
    drop_written(sample)
    return model


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"))
    counts = written(count_words(own.where("not held_out")), "word-counts")
    size = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max(F.when(F.col("word") == "", F.col("n"))).alias("ends")).first()
    top = counts.where("word <> ''").orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    vocabulary = Vocabulary([w.encode() for w in top.column("word").to_pylist()], top.column("n").to_pylist(), size["total"] or 0, size["distinct"], size["ends"] or 0)
    for r in counts.where("word <> ''").mapInArrow(_class_totals(vocabulary), "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        vocabulary.class_n[r["class"]], vocabulary.class_v[r["class"]] = r["n"], r["v"]
    from uuid import uuid4

    coded = written(own.mapInArrow(_code(vocabulary, uuid4().hex), CODED), "symbols")
    model = train(coded, vocabulary, states, rounds)
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "log_class", "symbols").mapInArrow(_loglik(model), CODED.replace(", symbols binary, rare array<string>", ", hmm double"))
    unit = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + log - F.col("n_tokens") * unit).alias("base_score"), (F.col("hmm") + F.col("log_class") + log).alias("score"),
    )
