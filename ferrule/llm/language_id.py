"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (the tokens of at most ``PIECE_BYTES``
bytes; all single bytes are among them, so every text can be segmented).  The probability of a *unit* (a word with
a leading space; longer words are several units of ``UNIT_BYTES`` bytes) is the sum over all its
segmentations into pieces of the product of their probabilities, by the forward algorithm.  A text's
log-probability is the sum over its units, its language the one of largest posterior, and its score that posterior.

Training is expectation-maximisation: each round Spark runs forward-backward over the distinct units of a sample of
the labelled documents (about ``sample_docs`` per language, chosen by a hash of the id) and sums the expected
piece counts; the driver sees one count per language and piece of the fixed vocabulary.

Scoring is one narrow pass.  In a slice each distinct unit is scored once; a bounded per-worker cache keeps the latest
units' scores.

Cases: a null text or one without a letter is ``und`` with score 0; documents with null ``lang`` are not learned from; without
any labelled document every text is ``und``; ties go to the language that sorts first; long texts are scored whole;
repeated rows give repeated results; an empty table gives an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import Words, slices, words_of
from ferrule.session import cut_lineage

PIECE_BYTES = 7
UNIT_BYTES = 32
UNKNOWN = "und"
CACHE_UNITS = 400_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> np.ndarray:
    """Sorted keys of the pieces: a leading 1 and then the bytes, as one integer."""
    keys = {(1 << 8) | b for b in range(256)}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token = base64.b64decode(line.split()[0])
                if len(token) <= PIECE_BYTES:
                    keys.add(int.from_bytes(b"\x01" + token, "big"))
    return np.array(sorted(keys), dtype=np.uint64)


def unit_matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the units of words ``data[start:end]``: (matrix, lengths, index of the word).  The first
    unit of a word has a space before it."""
    count = -(-(end - start) // UNIT_BYTES)
    word = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[word] + nth * UNIT_BYTES
    size = np.minimum(end[word] - begin, UNIT_BYTES)
    lead = (nth == 0).astype(np.int64)
    columns = np.arange(UNIT_BYTES + 1)[None, :int((size + lead).max(initial=1))]
    at = begin[:, None] + columns - lead[:, None]
    matrix = data[np.clip(at, 0, len(data) - 1)]
    matrix[(lead == 1), 0] = 32
    return matrix, size + lead, word


def piece_index(matrix: np.ndarray, length: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """For piece length k (list index k - 1): the vocabulary index of the piece that starts at each
    place, or -1."""
    rows, width = matrix.shape
    key = np.ones((rows, width), dtype=np.uint64)
    out = []
    place = np.arange(width)[None, :]
    for k in range(1, min(PIECE_BYTES, width) + 1):
        key = (key[:, :width - k + 1] << np.uint64(8)) | matrix[:, k - 1:].astype(np.uint64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out.append(np.where((keys[at] == key) & (place[:, :width - k + 1] + k <= length[:, None]), at, -1).astype(np.int32))
    return out


def forward(index: list[np.ndarray], width: int, probability: np.ndarray) -> np.ndarray:
    """``alpha[unit, place, language]``: total probability of the segmentations of each beginning.
    ``probability`` has a last row of zeros for index -1."""
    rows = len(index[0])
    alpha = np.zeros((rows, width + 1, probability.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, width + 1):
        for k in range(1, min(j, len(index)) + 1):
            alpha[:, j] += alpha[:, j - k] * probability[index[k - 1][:, j - k]]
    return alpha


def log_scores(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray,
               probability: np.ndarray) -> np.ndarray:
    """Natural-log probability of each word in each language."""
    out = np.zeros((len(start), probability.shape[1]))
    order = np.argsort(end - start, kind="stable")  # like lengths together: narrow matrices
    for at in range(0, len(order), 4096):
        chosen = order[at:at + 4096]
        matrix, length, word = unit_matrix(data, start[chosen], end[chosen])
        index = piece_index(matrix, length, keys)
        alpha = forward(index, matrix.shape[1], probability)
        np.add.at(out, chosen[word], np.log(alpha[np.arange(len(word)), length]))
    return out


def expected_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, keys: np.ndarray,
                    probability: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over the words (forward-backward) under one language's
    probabilities (``probability`` is a column with a last zero row)."""
    total = np.zeros(len(keys) + 1)
    order = np.argsort(end - start, kind="stable")
    for at in range(0, len(order), 4096):
        chosen = order[at:at + 4096]
        matrix, length, word = unit_matrix(data, start[chosen], end[chosen])
        rows, width = matrix.shape
        index = piece_index(matrix, length, keys)
        alpha = forward(index, width, probability)[:, :, 0]
        beta = np.zeros((rows, width + 1))
        beta[np.arange(rows), length] = 1
        p = probability[:, 0]
        for j in range(width - 1, -1, -1):
            for k in range(1, min(width - j, len(index)) + 1):
                beta[:, j] += p[index[k - 1][:, j]] * beta[:, j + k]
        scale = weight[chosen][word] / alpha[np.arange(rows), length]
        for k, pieces in enumerate(index, start=1):
            use = alpha[:, :width - k + 1] * p[pieces] * beta[:, k:width + 1] * scale[:, None]
            total += np.bincount(pieces.ravel() % len(total), weights=use.ravel(), minlength=len(total))
    return total[:-1]


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def train(labelled: DataFrame, path: str, sample_docs: int = 1000, rounds: int = 4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, piece probabilities with a last zero row) from ``labelled(doc_id, text, lang)``."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    keys = vocabulary(path)
    if not languages:
        return [], np.zeros(0), np.zeros((len(keys) + 1, 0))
    share = spark.createDataFrame([(x, min(1.0, sample_docs / sizes[x])) for x in languages], "lang string, share double")
    chosen = labelled.join(F.broadcast(share), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            words = words_of(part.column("text"))
            doc = words.doc
            for lang in sorted(set(langs.tolist())):
                mine = np.flatnonzero(langs[doc] == lang)
                _, first, count = np.unique(words.hash[mine], return_index=True, return_counts=True)
                raw = words.data.tobytes()
                at = mine[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()),
                     pa.array([raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)], pa.binary()),
                     pa.array(count, pa.int64())], ["lang", "word", "n"])

    counts = cut_lineage(chosen.select("lang", "text").mapInArrow(units, "lang string, word binary, n bigint")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    probability = np.full((len(keys) + 1, len(languages)), 1.0 / len(keys))
    probability[-1] = 0
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(probability)

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            mine = vocabulary(path)
            total = np.zeros((len(mine), len(languages)))
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                for at, lang in enumerate(languages):
                    part = batch.filter(pa.array(langs == lang))
                    words = part.column("word").to_pylist()
                    if words:
                        end = np.cumsum([len(w) for w in words])
                        start = np.concatenate(([0], end[:-1]))
                        data = np.frombuffer(b"".join(words), np.uint8)
                        total[:, at] += expected_counts(data, start, end, part.column("n").to_numpy().astype(float),
                                                        mine, model.value[:, at:at + 1])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()),
                                              pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = counts.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.full((len(keys), len(languages)), 0.01)
        for batch in sums.toArrow().to_batches():  # one row per piece and language at most
            total[batch.column(0).to_numpy(), batch.column(1).to_numpy()] += batch.column(2).to_numpy()
        probability[:-1] = total / total.sum(axis=0)
        model.unpersist()
    n = np.array([sizes[x] for x in languages], dtype=float)
    return languages, np.log(n / n.sum()), probability


class _Scorer:
    """Scores distinct words, with a bounded cache of the latest."""

    def __init__(self, keys: np.ndarray, probability: np.ndarray):
        self.keys, self.probability = keys, probability
        self.hash = np.zeros(0, np.uint64)
        self.score = np.zeros((0, probability.shape[1]), np.float32)

    def totals(self, words: Words) -> np.ndarray:
        """Log-probability of every text in every language."""
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        score = np.zeros((len(distinct), self.probability.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        known = self.hash[at] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
        score[known] = self.score[at[known]]
        new = first[~known]
        score[~known] = log_scores(words.data, words.start[new], words.end[new], self.keys, self.probability)
        if len(self.hash) + len(new) > CACHE_UNITS:
            self.hash, self.score = distinct, score
        else:
            merged = np.concatenate((self.hash, distinct[~known]))
            order = np.argsort(merged)
            self.hash, self.score = merged[order], np.concatenate((self.score, score[~known]))[order]
        running = np.zeros((len(words.hash) + 1, score.shape[1]))
        np.cumsum(score[inverse], axis=0, dtype=np.float64, out=running[1:])
        return running[words.first[1:]] - running[words.first[:-1]]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str, text: str = "text",
             carry: Column | None = None) -> DataFrame:
    """``row`` (``carry``, by default a struct of all columns), ``lang_pred`` and ``score`` of every text."""
    languages, prior, probability = model
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(carry.alias("row"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(probability)  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(vocabulary(path), shared.value)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
            names, best = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if languages and lettered.any():
                total = scorer.totals(words_of(part.column("text"))) + prior
                total -= total.max(axis=1, keepdims=True)
                total = np.exp(total)
                posterior = total / total.sum(axis=1, keepdims=True)
                pick = posterior.argmax(axis=1)
                names[lettered] = np.array(languages, dtype=object)[pick[lettered]]
                best[lettered] = posterior[np.arange(len(pick)), pick][lettered]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names.tolist(), pa.string()), pa.array(best)],
                                             ["row", "lang_pred", "score"])

    return source.mapInArrow(run, with_fields([source.schema["row"]], "lang_pred string, score double"))
