"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (``FEATURES``): densities of a fixed insult lexicon and of a learned one, nearness of their hits to
second-person words, capitals, punctuation and obfuscated spellings.  The labelled sample (about
``sample_rows`` rows by a hash of the id) is split in three: one part finds the learned lexicon (words whose smoothed log-odds
of the label are highest), one trains the trees, one fits the calibration, so no part judges what it was fitted on.
With so few labels that a part would lack rows or a label, all three steps use all of them.
Features of all texts come from one narrow pass over whole texts; Spark's tree and isotonic models score the rows.

Cases: a null or empty text has zero features and gets the score the trees give those; labels other than 0 and 1 and null labels or
ids are not learned from; repeated label rows of an id count once (the largest); with no example of one of the labels
the score is the share of label 1 (0 without labels); an empty table gives an empty result; extra columns are
carried in ``row``; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import slices, words_of
from ferrule.session import cut_lineage

#: Fixed word lists.
INSULTS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting",
           "clown", "dumb", "ugly", "fool", "jerk", "garbage", "vermin", "filth", "imbecile", "coward", "freak", "hate")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te",
                 "toi", "ton", "ta", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
#: Digits and signs that stand for letters in disguised spellings.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FEATURES = ("log_words", "fixed_hits", "fixed_density", "learned_hits", "learned_density", "learned_mean", "learned_best",
            "nearness", "second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation",
            "obfuscated", "disguised_hits", "repeated_letters")
LEXICON_SIZE = 4000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_INNER_SIGN = _PUNCTUATION.copy()
_INNER_SIGN[[ord("'"), ord("-"), ord("."), ord(","), ord("/"), ord(":")]] = False
_INNER_SIGN[48:58] = True
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in DISGUISE.items():
    _PLAIN[ord(_sign)] = ord(_letter)


def lexicon_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of(pa.array(list(words), pa.string()), fold=True).hash)


def _member(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return sorted_hashes[at] == h


def features_of(column: pa.Array, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(texts, features) of a slice; ``learned`` are sorted word hashes with their log-odds ``weights``."""
    words = words_of(column, fold=True)
    first, data = words.first, words.data
    n_texts = len(first) - 1
    n_words = np.diff(first)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[first])

    def bytes_per_text(chosen: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(chosen, out=total[1:])
        return np.diff(total[words.offsets])

    def bytes_per_word(chosen: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(chosen, out=total[1:])
        return total[words.end] - total[words.start]

    h = words.hash
    fixed = _member(_FIXED, h)
    place = np.minimum(np.searchsorted(learned, h), max(0, len(learned) - 1))
    in_learned = learned[place] == h if len(learned) else np.zeros(len(h), bool)
    weight = np.where(in_learned, weights[place], 0.0) if len(learned) else np.zeros(len(h))
    you = _member(_YOU, h)
    hit = fixed | in_learned
    doc = words.doc
    near = np.zeros(n_texts)
    at_hit, at_you = np.flatnonzero(hit), np.flatnonzero(you)
    if len(at_hit) and len(at_you):
        right = np.searchsorted(at_you, at_hit)
        for side in (np.minimum(right, len(at_you) - 1), np.maximum(right - 1, 0)):
            same = doc[at_you[side]] == doc[at_hit]
            np.maximum.at(near, doc[at_hit][same], 1.0 / (1.0 + np.abs(at_you[side] - at_hit)[same]))
    best = np.zeros(n_texts)
    np.maximum.at(best, doc[in_learned], weight[in_learned])

    letters = bytes_per_text(_LETTER[data])
    upper = _UPPER[data]
    size = words.end - words.start
    ends_with_letters = _LETTER[data[words.start]] & _LETTER[data[words.end - 1]] if len(size) else np.zeros(0, bool)
    obfuscated = ends_with_letters & (bytes_per_word(_INNER_SIGN[data]) > 0)
    disguised = np.zeros(len(h), bool)
    if obfuscated.any():
        chosen = np.flatnonzero(obfuscated)
        raw = [_PLAIN[data[a:b]].tobytes() for a, b in zip(words.start[chosen].tolist(), words.end[chosen].tolist(), strict=True)]
        plain = words_of(pa.array(raw, pa.binary()), fold=True)
        whole = np.diff(plain.first) == 1
        ok = np.zeros(len(chosen), bool)
        ok[whole] = _member(_FIXED, plain.hash[plain.first[:-1][whole]]) | _member(learned, plain.hash[plain.first[:-1][whole]])
        disguised[chosen] = ok
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    w, c = np.maximum(n_words, 1), np.maximum(np.diff(words.offsets), 1)
    fixed_n, learned_n = per_text(fixed), per_text(in_learned)
    return np.column_stack((
        np.log1p(n_words), fixed_n, fixed_n / w, learned_n, learned_n / w, per_text(weight) / np.maximum(learned_n, 1), best,
        near, per_text(you) / w, bytes_per_text(upper) / np.maximum(letters, 1),
        per_text((bytes_per_word(upper) == size) & (size > 1)) / w, bytes_per_text(data == 33) / c, bytes_per_text(data == 63) / c,
        bytes_per_text(_PUNCTUATION[data]) / c, per_text(obfuscated) / w, per_text(disguised), bytes_per_text(run) / c))


_FIXED, _YOU = lexicon_hashes(INSULTS), lexicon_hashes(SECOND_PERSON)


def with_features(source: DataFrame, learned: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``source`` without ``text``, with ``features array<double>``."""
    kept = [f for f in source.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = features_of(part.column("text"), learned, weights)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [flat], [f.name for f in kept] + ["features"])

    return source.mapInArrow(run, with_fields(kept, "features array<double>"))


def learned_lexicon(labelled: DataFrame, size: int = LEXICON_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of the words most typical of label 1, from ``labelled(text, label)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"), fold=True)
            label = part.column("label").to_numpy()
            pairs = np.unique(np.column_stack((words.doc.astype(np.uint64), words.hash)), axis=0)
            kinds = label[pairs[:, 0].astype(np.int64)]
            word, inverse = np.unique(pairs[:, 1], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(np.bincount(inverse, weights=kinds, minlength=len(word))),
                 pa.array(np.bincount(inverse, minlength=len(word)).astype(float))], ["word", "toxic", "n"])

    total = labelled.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = float(total["toxic"] or 0), float(total["n"])
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1.0))
    rows = (labelled.select("text", "label").mapInArrow(run, "word bigint, toxic double, n double").groupBy("word")
            .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("toxic >= 4").withColumn("odds", odds)
            .where("odds >= 1.5").orderBy(F.desc("odds"), "word").limit(size).collect())
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["odds"] for r in rows], float)[order]


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
                   label: str = "toxic", carry: Column | None = None, sample_rows: int = 20_000,
                   trees: int = 20, depth: int = 4) -> DataFrame:
    """``row`` (``carry``, by default a struct of all columns) and ``score`` of every text, learned from the labelled rows
    where ``learn`` (a condition on the documents) holds."""
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         learn.alias("learn"), carry.alias("row"))
    marks = (labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))
    total = marks.count()
    share = min(1.0, sample_rows / max(1, total))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 20))
    chosen = marks.where(spread < share * (1 << 20))  # about sample_rows rows, hence the broadcast
    labelled = cut_lineage(source.where("learn").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit("toxicity part")), F.lit(5))))
    groups = {(r["part"], r["label"]) for r in labelled.select("part", "label").distinct().collect()}
    seen = {label for _, label in groups}
    if len(seen) < 2:
        return source.select("row", F.lit(float(1 in seen)).alias("score"))
    if {label for part, label in groups if part in (2, 3)} == {0, 1} and any(part == 4 for part, _ in groups):
        lexicon, fitting, calibrating = "part < 2", "part < 4", "part = 4"
        rows = labelled.where("part >= 2")
    else:
        lexicon = fitting = calibrating = "true"  # too few labels for parts of their own
        rows = labelled
    learned, weights = learned_lexicon(labelled.where(lexicon))
    table = cut_lineage(with_features(rows.select("part", "label", "text"), learned, weights).repartition(4))
    vectors = table.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    boosted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, seed=11, maxMemoryInMB=128)
    boosted = boosted.setRawPredictionCol("raw").setProbabilityCol("chance").setPredictionCol("guess")
    model = boosted.fit(vectors.where(fitting))
    judged = model.transform(vectors.where(calibrating)).withColumn("chance", vector_to_array("chance")[1])
    steps = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(judged.select("chance", "label"))

    found = model.transform(with_features(source.select("row", "text"), learned, weights).withColumn(
        "vector", array_to_vector("features"))).select("row", vector_to_array("chance")[1].alias("chance"))
    # the calibrated step function, with a small share of the raw order inside its flat steps
    return steps.transform(found).select("row", (F.col("score") * 0.998 + F.col("chance") * 0.002).alias("score"))
