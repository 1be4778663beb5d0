import public_tokenizers as P
import pytest

import corpus_pipeline
from ferrule.llm import bpe, queries
from tests.llm import brute
from tests.llm.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage kept, written and read again."""
    docs, out = queries.documents(spark, SF_SMALL), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    source = queries.documents(spark, SF_SMALL)
    for kept in stages[:4]:
        assert kept.columns == source.columns and kept.dtypes == source.dtypes
    rows = [{r.doc_id: r.text for r in x.collect()} for x in [source, *stages[:4]]]
    assert set(rows[1]) == {d for d, t in rows[0].items() if any(c.isalpha() for c in t or "")}
    component = brute.jaccard_components(list(rows[1].items()))
    assert set(rows[2]) == {d for d, (_, c) in component.items() if c == d}
    want = {d: rows[2][d] if not gone else kept for d, n, gone, kept in brute.without_repeats(list(rows[2].items()), 13)
            if not gone or gone < n}
    assert rows[3] == want
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaking = {d for d, t in rows[3].items() for i in items
               if b" " + b" ".join(brute.lower(i)) + b" " in b" " + b" ".join(brute.lower(t)) + b" "}
    assert set(rows[4]) <= set(rows[3]) - leaking and len(rows[4]) >= len(rows[3]) - len(leaking) - 5
    last = stages[4].collect()
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    import numpy as np

    assert {r.doc_id for r in last} == set(rows[4]) and all(r.round_trip for r in last)
    for r in last:
        data, _ = codec.decode(np.frombuffer(r.ids, "<u4"))
        assert data.tobytes().decode() == rows[4][r.doc_id] and len(r.ids) == 4 * r.n_tokens


def test_run_equals_the_stages(spark, stages):
    got = {(r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == {(r.doc_id, bytes(r.ids)) for r in stages[4].collect()}


def test_stages_take_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows, lang=lambda d: "en" if d != 7 else None)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF_SMALL)
        if name != "byte_bpe":
            assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert docs.count() > 0


def test_stages_decide_by_row(spark, docs_of):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id").first().text
    clean = ["the quick brown fox jumps over the lazy dog today", "a wholly different line of words about rivers and hills",
             "some third text that tells of boats in a harbour", "four small birds sat upon a very old garden wall"]
    rows = [(None, item), (None, clean[0]), (7, item), (7, clean[1]), (8, clean[2])]
    kept = corpus_pipeline.drop_leaks(spark, docs_of(rows), SF_SMALL)
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == sorted([(clean[0], None), (clean[1], 7), (clean[2], 8)])

    rows = [(1, clean[0]), (5, clean[0]), (5, clean[1]), (6, clean[2]), (6, clean[2]), (6, clean[2]),
            (None, clean[2]), (None, clean[3]), (None, clean[3]), (9, ""), (None, None)]
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(rows), SF_SMALL)
    want = [(1, clean[0]), (5, clean[1]), (6, clean[2]), (None, clean[3]), (9, ""), (None, None)]
    assert kept.columns == docs_of(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
