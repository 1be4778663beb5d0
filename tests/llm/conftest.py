import random

import pytest

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "`row` string, bucket int, digest string, component int, score string, `a.b` int")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text) rows, with extra columns whose names clash with internal ones."""

    def make(rows, lang=None):
        full = [(d, t, lang(d) if lang else "en", "src", None if t is None else len(t), "x", 1, None, 2, "s", 3) for d, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, ties, repeated rows, and one long text."""
    r = random.Random(5)
    long = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30_000))
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return [(1, None), (2, ""), (3, " \t\n "), (4, same), (5, same), (5, same), (6, "Uno"), (None, same), (None, None),
            (7, "ÄÖ ß é — “quoted”   x"), (8, long), (9, "a" * 5000), (10, "???!!! 123"), (-3, same + " sixteen")]
