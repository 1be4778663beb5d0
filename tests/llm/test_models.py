import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import hmm, language_id, queries, toxicity
from tests.llm import brute
from tests.llm.conftest import SF_MID

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def test_forward_equals_sum_over_paths():
    r = np.random.default_rng(1)
    model = hmm.Model(r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES),
                      r.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    classes, first = r.integers(0, hmm.CLASSES, 8), np.array([0, 3, 4, 8])
    for k, got in enumerate(hmm.log_likelihood(classes, first, model)):
        x = classes[first[k]:first[k + 1]]
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(x)):
            p = model.start[path[0]] * model.emit[x[0], path[0]]
            for a, b, c in zip(path, path[1:], x[1:], strict=False):
                p *= model.move[a, b] * model.emit[c, b]
            total += p
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_expected_counts_equal_forward_backward_by_hand():
    r = np.random.default_rng(2)
    model = hmm.Model(r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES),
                      r.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    x = r.integers(0, 5, 3)
    start, move, emit = hmm.expected(x, np.array([0, 3]), model)
    weight = np.zeros((hmm.STATES,) * 3)
    for a, b, c in itertools.product(range(hmm.STATES), repeat=3):
        weight[a, b, c] = (model.start[a] * model.emit[x[0], a] * model.move[a, b] * model.emit[x[1], b]
                           * model.move[b, c] * model.emit[x[2], c])
    weight /= weight.sum()
    assert np.allclose(start, weight.sum((1, 2)), atol=1e-5)
    assert np.allclose(move, weight.sum(2) + weight.sum(0), atol=1e-5)
    want = np.zeros((hmm.CLASSES, hmm.STATES))
    for k, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        want[x[k]] += weight.sum(axes)
    assert np.allclose(emit, want, atol=1e-5)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(0, 50, 400) + 1000 * (k % 2) for k in range(10)])
    first = np.arange(0, len(text) + 1, 400)
    model = hmm.Model.initial(np.bincount(text, minlength=hmm.CLASSES).astype(float))
    before = hmm.log_likelihood(text, first, model).sum()
    for _ in range(8):
        model = hmm.Model.from_counts(*hmm.expected(text, first, model))
    assert hmm.log_likelihood(text, first, model).sum() > before + 200
    assert np.allclose(model.move.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=0), 1)


def base_by_hand(rows, learned):
    tokens = [brute.lower(t) + [None] for _, t in rows]
    counts = Counter(w for (d, _), x in zip(rows, tokens, strict=True) if learned(d) for w in x)
    n, v = sum(counts.values()), len(counts)
    return [(len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for x in tokens]


def test_lm_scores(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_MID).collect()]
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, SF_MID).collect()}
    rest = lambda d: zlib.crc32(str(d).encode()) % 7
    for (d, _), (n, known, total, base) in zip(rows, base_by_hand(rows, lambda d: rest(d) != 2), strict=True):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, rest(d) == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_lm_model_does_not_depend_on_partitions(docs_of):
    r = np.random.default_rng(5)
    docs = docs_of([(d, " ".join(f"w{x}" for x in r.integers(0, 60, r.integers(1, 90)) + 40 * (d % 2))) for d in range(120)])
    learn = F.col("doc_id") % 5 != 0
    one, two = ({x.row.doc_id: x.score for x in hmm.score_texts(docs.repartition(n, "text"), learn).collect()} for n in (1, 7))
    assert one.keys() == two.keys() and all(math.isclose(one[d], two[d], rel_tol=1e-12) for d in one)


def test_lm_odd_rows(docs_of, odd_rows):
    learn = F.coalesce(F.col("doc_id") != 4, F.lit(True))
    got = hmm.score_texts(docs_of(odd_rows), learn, rounds=1).collect()
    want = base_by_hand(odd_rows, lambda d: d != 4)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got) == sorted(key(w) for w in want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_texts(docs_of([]), F.lit(True), rounds=1).collect() == []
    alone = hmm.score_texts(docs_of([(1, "a b")]), F.lit(False), rounds=1).collect()[0]
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)


def test_segmentation_forward_equals_enumeration():
    keys = language_id.vocabulary(MULTI)
    r = np.random.default_rng(4)
    probability = np.vstack((r.dirichlet(np.ones(len(keys)), 2).T, np.zeros(2)))
    for word in ("the", "été", "a", "x" * 70, "Straße"):
        raw = word.encode()
        data = np.frombuffer(raw, np.uint8)
        got = language_id.log_scores(data, np.array([0]), np.array([len(raw)]), keys, probability)[0]
        want = 0.0
        for at in range(0, len(raw), language_id.UNIT_BYTES):
            unit = (b" " if at == 0 else b"") + raw[at:at + language_id.UNIT_BYTES]
            alpha = [np.ones(2)]
            for j in range(1, len(unit) + 1):
                total = np.zeros(2)
                for i in range(max(0, j - language_id.PIECE_BYTES), j):
                    k = np.searchsorted(keys, np.uint64(int.from_bytes(b"\x01" + unit[i:j], "big")))
                    if k < len(keys) and keys[k] == int.from_bytes(b"\x01" + unit[i:j], "big"):
                        total += alpha[i] * probability[k]
                alpha.append(total)
            want += np.log(alpha[-1])
        assert np.allclose(got, want)


def test_expected_pieces_cover_the_text():
    keys = language_id.vocabulary(MULTI)
    p = np.append(np.full(len(keys), 1 / len(keys)), 0)[:, None]
    data = np.frombuffer(b"thethere", np.uint8)
    counts = language_id.expected_counts(data, np.array([0, 3]), np.array([3, 8]), np.array([2.0, 1.0]), keys, p)
    sizes = np.array([len(int(k).to_bytes(8, "big").lstrip(b"\0")) - 1 for k in keys])
    assert math.isclose((counts * sizes).sum(), 2 * 4 + 6)


def test_language_accuracy(spark):
    truth = {r.doc_id: r for r in queries.documents(spark, SF_MID).collect()}
    got = queries.op9_language_id(spark, SF_MID).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 100 < len(held) < 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.98


def test_language_odd_rows(docs_of, odd_rows):
    train = docs_of([(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, None), (4, "x")],
                    lang=lambda d: {1: "en", 2: "de", 3: "fr"}.get(d))
    model = language_id.train(train.select("doc_id", "text", "lang"), MULTI)
    assert model[0] == ["de", "en"]
    rows = odd_rows + [(20, "the dog"), (21, "und der")]
    got = language_id.identify(docs_of(rows), model, MULTI).collect()
    for r in got:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert {r.row.doc_id: r.lang_pred for r in got if r.row.doc_id in (20, 21)} == {20: "en", 21: "de"}
    none = language_id.train(docs_of([]).select("doc_id", "text", "lang"), MULTI)
    assert {r.lang_pred for r in language_id.identify(docs_of(rows), none, MULTI).collect()} == {"und"}
    assert language_id.identify(docs_of([]), model, MULTI).collect() == []


def test_toxicity_features_by_hand():
    learned = np.sort(toxicity.lexicon_hashes(("zorg",)))
    rows = toxicity.features_of(pa.array(["You STUPID zorg! 1d1ot nooo?", "", "fine text"]), learned, np.array([2.5]))
    f = dict(zip(toxicity.FEATURES, rows[0], strict=True))
    assert f["fixed_hits"] == 1 and f["learned_hits"] == 1 and f["learned_best"] == 2.5
    assert f["nearness"] == 0.5 and f["second_person"] == 0.2 and f["capital_words"] == 0.2
    assert f["exclamations"] > 0 and f["questions"] > 0 and f["repeated_letters"] > 0
    assert not rows[1].any() and dict(zip(toxicity.FEATURES, rows[2], strict=True))["fixed_hits"] == 0
    disguised = toxicity.features_of(pa.array(["st0pid idi0t l0ser"]), learned, np.array([2.5]))[0]
    assert disguised[toxicity.FEATURES.index("disguised_hits")] == 2


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    docs, labels = [], []
    for d in range(900):
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["you idiot", "grumbel", "vile1", "STUPID"]))
        docs.append((d, " ".join(text)))
        labels.append((d, 1, toxic))
    return docs, labels


def test_toxicity_separates_held_out_rows(spark, docs_of, toxic_corpus):
    docs, labels = toxic_corpus
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (3000, 1, None)], "doc_id bigint, quality int, toxic int")
    learn = language_id.remainder("doc_id", 5) != 0
    got = toxicity.score_toxicity(docs_of(docs + [(9000, None), (9001, "")]), marks, learn).collect()
    score = {r.row.doc_id: r.score for r in got}
    assert len(got) == len(docs) + 2 and all(0 <= s <= 1 for s in score.values()) and score[9000] == score[9001] < 0.5
    held = [(score[d], t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    good = np.mean([a > b for a, x in held if x for b, y in held if not y])
    assert good > 0.95


def test_toxicity_without_examples(spark, docs_of, odd_rows):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs_of(odd_rows), empty, F.lit(True)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs_of([]), empty, F.lit(True)).collect() == []


@pytest.mark.parametrize("n", [2, 5, 11, 20])
def test_toxicity_of_few_labels(spark, docs_of, n):
    """Two to twenty labelled rows give scores for every text."""
    docs = [(k, ("you stupid idiot " if k % 2 else "a calm and friendly note ") * 3) for k in range(n)] + [(100, None), (101, "you idiot")]
    marks = spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id bigint, toxic int")
    got = {r.row.doc_id: r.score for r in toxicity.score_toxicity(docs_of(docs), marks, F.lit(True)).collect()}
    assert len(got) == n + 2 and all(0 <= s <= 1 for s in got.values())
