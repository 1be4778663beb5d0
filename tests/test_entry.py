"""Driver contract: entry / queries / oracle_sql are consistent."""

import re

import __spark_entry__ as E


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
    # only parsing-bound operators run without an SQL oracle
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(o) == {"icon_audit"}
