"""Hidden Markov language model over words, with an exact smoothed unigram base.

Tokens are the words of a text (A-Z lower-cased) and one end token.  A latent state emits a *class* of tokens, the
class its token: ``P(text) = sum over state paths of prod a(s, s') e(s', class) * prod P(token | class)``.
Classes are ``CLASSES`` hash classes, so the model's size does not grow with the vocabulary; within a class
``P(token | class) = (c + 1) / (C + V + 1)`` from exact corpus counts (``C`` tokens, ``V`` distinct, one unseen).

* **Baum-Welch.**  Expected counts are computed slice by slice and summed over partitions by Spark (one row per
  state and class).  ``rounds`` passes over all training texts follow a start from a bounded sample
  (the ``sample_docs`` texts of smallest hash of id and text), which only breaks the symmetry of the states.  For the
  expected counts a text is cut into chains of ``CHAIN`` tokens; scores use whole texts.  State counts of a token are rounded
  to multiples of ``GRAIN`` before they are added, so their sums are exact in doubles (up to 2**33); the few transition sums
  are rounded to multiples of ``MOVE_GRAIN`` after.  The model is the same however the rows are dealt to tasks, unless a value
  lies within the last bits of a rounding edge.
* **Scores.**  The forward recursion, rescaled at each token, runs over all texts of a chunk at once and is exact.
* **Counts.**  The corpus is written once as chunks of packed rows.  Each chunk sends its distinct tokens with
  their training counts to groups by hash and gets back the corpus totals: a join of distinct tokens per chunk,
  whose volume grows with the corpus, never a table of all words in one place.

Cases: a null or empty text is the end token alone; a null doc_id belongs to the training fold as the id ''; repeated rows
each count; without training texts all counts are 0 and the states uniform; an empty table gives an empty result; extra
columns are carried in ``row``; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.llm.exchange import pack_batch, runs, unpack_batch
from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import mix, slices, words_of
from ferrule.session import cut_lineage

STATES = 8
CLASSES = 8192
CHAIN = 1024
GRAIN = 2.0 ** -20
MOVE_GRAIN = 2.0 ** -10
END = np.uint64(0x2545F4914F6CDD1D)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts of a slice, and the first token of each text."""
    words = words_of(column, lower=True)
    texts = len(words.first) - 1
    tokens = np.insert(words.hash, words.first[1:], END) if texts else words.hash
    return tokens, words.first + np.arange(texts + 1)


def class_of(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0x94D049BB133111EB)) % np.uint64(CLASSES)).astype(np.int64)


class Model:
    """Start, transition and emission probabilities; ``emit`` is (classes, states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        base = emit.sum(axis=1) + 0.05
        emit = emit + 20.0 * (base / base.sum())[:, None]  # towards the unigram of classes
        return Model((start + 0.5) / (start + 0.5).sum(), (move + 0.5) / (move + 0.5).sum(axis=1, keepdims=True),
                     emit / emit.sum(axis=0))

    @staticmethod
    def initial(class_counts: np.ndarray, seed: int = 7) -> Model:
        """Sticky states around the class unigram, symmetry broken by fixed noise."""
        noise = np.random.default_rng(seed).uniform(0.5, 1.5, (CLASSES, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return Model.from_counts(np.ones(STATES), move * 100, (class_counts[:, None] + 0.05) * noise)


def _by_length(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by descending length: (order, first tokens, number still running at each step)."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    running = np.searchsorted(-length[order], -np.arange(steps), "left")
    return order, first[:-1][order], running


def log_likelihood(classes: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Natural-log probability of every class sequence by the scaled forward recursion."""
    order, begin, running = _by_length(first)
    out = np.zeros(len(order))
    alpha = np.repeat(model.start[None, :], len(order), axis=0)
    for t, n in enumerate(running.tolist()):
        a = alpha[:n] @ model.move if t else alpha[:n]
        a = a * model.emit[classes[begin[:n] + t]]
        scale = a.sum(axis=1)
        alpha = a / scale[:, None]
        out[:n] += np.log(scale)
    result = np.empty(len(order))
    result[order] = out
    return result


def expected(classes: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of the class sequences, cut into chains."""
    cuts = [np.arange(a, b, CHAIN) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    first = np.append(np.concatenate(cuts) if cuts else np.zeros(0, np.int64), first[-1]).astype(np.int64)
    order, begin, running = _by_length(first)
    n_tokens = len(classes)
    forward = np.zeros((n_tokens, STATES), np.float32)
    scales = np.ones(n_tokens, np.float32)
    start, move = np.zeros(STATES), np.zeros((STATES, STATES))
    alpha = np.repeat(model.start[None, :], len(order), axis=0)
    for t, n in enumerate(running.tolist()):
        at = begin[:n] + t
        a = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[classes[at]]
        scale = a.sum(axis=1)
        alpha = a / scale[:, None]
        forward[at], scales[at] = alpha, scale
    beta = np.ones((len(order), STATES))
    done = 0
    posterior = forward  # overwritten from the end
    for t in range(len(running) - 1, -1, -1):
        n = int(running[t])
        at = begin[:n] + t
        if n > done:
            beta[done:n] = 1.0  # chains that end here
            done = n
        here = forward[at] * beta[:n]
        here /= here.sum(axis=1, keepdims=True)
        if t:
            ahead = beta[:n] * model.emit[classes[at]] / scales[at][:, None]
            move += (forward[at - 1].T @ ahead) * model.move
            beta[:n] = ahead @ model.move.T
        else:
            start += (np.rint(here / GRAIN) * GRAIN).sum(axis=0)
        posterior[at] = np.rint(here / GRAIN) * GRAIN
    emit = np.stack([np.bincount(classes, weights=posterior[:, k], minlength=CLASSES) for k in range(STATES)], axis=1)
    return start, move, emit


def train(training: DataFrame, rounds: int = 2, sample_docs: int = 400, sample_rounds: int = 15) -> Model:
    """Baum-Welch over ``training(doc_id, text)``."""
    sample = (training.select(F.xxhash64("doc_id", "text", F.lit("hmm sample")).alias("h"), "text")
              .orderBy("h", "text").limit(sample_docs))
    tokens, first = token_hashes(sample.toArrow().column("text").combine_chunks().cast(pa.string()))
    classes = class_of(tokens)
    model = Model.initial(np.bincount(classes, minlength=CLASSES).astype(float))
    for _ in range(sample_rounds if len(classes) else 0):
        model = Model.from_counts(*expected(classes, first, model))

    for _ in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
            for part in slices(batches):
                tokens, first = token_hashes(part.column("text"))
                for total, more in zip(sums, expected(class_of(tokens), first, shared.value), strict=True):
                    total += more
            flat = np.concatenate([s.ravel() for s in sums])
            cell = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(flat[cell])], ["cell", "n"])

        flat = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
        summed = training.select("text").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        for batch in summed.toArrow().to_batches():  # at most as many rows as the model has cells
            flat[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
        shared.unpersist()
        move = np.rint(flat[STATES:STATES + STATES * STATES] / MOVE_GRAIN) * MOVE_GRAIN
        model = Model.from_counts(flat[:STATES], move.reshape(STATES, STATES),
                                  flat[STATES + STATES * STATES:].reshape(CLASSES, STATES))
    return model


def _distinct_by_group(tokens: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens ordered by (group, hash), their groups, and each token's place among them."""
    distinct, inverse = np.unique(tokens, return_inverse=True)
    group = (mix(distinct) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], group[order], place[inverse]


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", carry: Column | None = None,
                rounds: int = 2) -> DataFrame:
    """Scores of all texts by a model of the rows where ``learn`` holds.

    Returns ``row`` (``carry``, by default a struct of all columns), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10 of the unigram base and of the model)."""
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), learn.alias("learn"),
                         carry.alias("row"))
    model = train(source.where("learn").select("doc_id", "text"), rounds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, piece in enumerate(slices(batches, size=8 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()),
                                              pa.array([pack_batch(piece)], pa.binary())], ["chunk", "payload"])

    chunks = cut_lineage(source.select("text", "learn", "row").mapInArrow(pack, "chunk bigint, payload binary"))
    groups = max(1, chunks.count() // 4)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                table = unpack_batch(blob.as_py()).combine_chunks()
                tokens, first = token_hashes(table.column("text").combine_chunks())
                words, group, place = _distinct_by_group(tokens, groups)
                learned = np.repeat(table.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
                counts = np.bincount(place[learned], minlength=len(words))
                out = [(g, chunk, words[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for g, a, b in runs(group)]
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
                     pa.array(columns[3], pa.binary())], ["grp", "chunk", "words", "counts"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        known, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
        back = np.split(total[inverse].astype("<i8"), np.cumsum([len(w) for w in words])[:-1])
        seen = total > 0
        kind = class_of(known[seen])
        at = np.unique(kind)
        stats = np.stack((at, np.bincount(kind, weights=total[seen], minlength=CLASSES)[at],
                          np.bincount(kind, minlength=CLASSES)[at])).astype("<i8")
        return pa.table({"chunk": pa.array(table.column("chunk").to_pylist() + [-1], pa.int64()),
                         "grp": pa.array([int(key[0].as_py())] * (len(back) + 1), pa.int32()),
                         "totals": pa.array([b.tobytes() for b in back] + [stats.tobytes()], pa.binary())})

    sent = chunks.mapInArrow(distinct, "grp int, chunk bigint, words binary, counts binary")
    totals = cut_lineage(sent.groupBy("grp").applyInArrow(count, "chunk bigint, grp int, totals binary"))

    def stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("totals").to_pylist():
                kind, tokens, distinct_tokens = np.frombuffer(blob, "<i8").reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(tokens), pa.array(distinct_tokens)], ["kind", "c", "v"])

    sums = np.zeros((2, CLASSES), dtype=np.int64)
    for row in (totals.where("chunk = -1").select("totals").mapInArrow(stats_rows, "kind bigint, c bigint, v bigint")
                .groupBy("kind").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()):  # at most CLASSES rows
        sums[:, row["kind"]] = row["c"], row["v"]
    n_train, n_distinct = (int(x) for x in sums.sum(axis=1))
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(sums.sum(axis=0) + 1.0)))
    row_type = to_arrow_type(source.schema["row"].dataType)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model, class_size = shared.value
        rows, columns = [], [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for blob in left.column("payload").to_pylist():
            table = unpack_batch(blob).combine_chunks()
            tokens, first = token_hashes(table.column("text").combine_chunks())
            words, _, place = _distinct_by_group(tokens, groups)
            back = sorted(zip(right.column("grp").to_pylist(), right.column("totals").to_pylist(), strict=True))
            c = np.concatenate([np.frombuffer(x, "<i8") for _, x in back])[place]
            classes = class_of(words)[place]
            gain = np.log10(c + 1.0)
            sums_of = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731 -- every text has its end token
            n = np.diff(first)
            rows += table.column("row").chunks
            columns[0].append(n)
            columns[1].append(sums_of((c > 0).astype(np.int64)))
            columns[2].append(sums_of(gain) - n * np.log10(n_train + n_distinct + 1.0))
            columns[3].append(log_likelihood(classes, first, model) / np.log(10.0) + sums_of(gain - class_size[classes]))
        n, known, base, full = (np.concatenate(x) for x in columns)
        return pa.table({"row": pa.chunked_array(rows, row_type), "n_tokens": n, "n_known": known,
                         "train_tokens": np.full(len(n), n_train, np.int64), "base_score": base, "score": full})

    return chunks.groupBy("chunk").cogroup(totals.where("chunk >= 0").groupBy("chunk")).applyInArrow(
        score, with_fields([source.schema["row"]], "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
