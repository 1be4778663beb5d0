"""Access joins whose keys have few values, and the number of lines a task of them holds."""

import datetime as dt

from ferrule.operators import access as AC
from ferrule.sources import adapters as A

UPA = "user_id bigint, plant_id int, is_active boolean, global_role_id int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_shuffled_by_role_or_permission(spark):
    upa = spark.createDataFrame([(1, 1, True, 1), (1, 1, True, 1), (1, 1, True, 2), (1, 2, True, 2), (2, 1, False, 1),
                                 (3, 1, True, None), (None, 1, True, 1), (4, None, True, 2)], UPA)
    granted = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (2, 9), (None, 1), (2, 3)], "role_id int, permission_id int")
    permissions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "d")], "id int, name string")
    out = AC.effective_permissions(upa, granted, permissions)
    assert "hashpartitioning(permission_id" not in plan(out) and "hashpartitioning(role_id" not in plan(out)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(
        [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (None, 1, "a"), (None, 1, "b"), (4, None, "a")], key=key)
    out = AC.effective_permissions(upa, granted, permissions, per_plant=False)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(
        [(1, "a"), (1, "b"), (None, "a"), (None, "b"), (4, "a")], key=key)


def test_the_access_join_has_tasks_by_lines(spark, scratch, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    tables = {
        "customer": ([(k, 1, 1.0, "BUILDING") for k in range(1, 5)], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "X", 0), (2, "Y", 4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, 1), (2, 2)], "s_suppkey bigint, s_nationkey int"),
        "orders": ([(k, k % 5, "O" if k % 2 else "F", "1-URGENT", day) for k in range(20)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz"),
        "lineitem": ([(k % 21, k % 3, 1 + k % 2, "N") for k in range(90)],
                     "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{scratch}/{name}.parquet")
    monkeypatch.setattr(A, "ROWS_PER_TASK", 10, raising=False)
    upa = A.access_tables(spark, scratch)["upa"]
    assert ", 9), REPARTITION_BY_NUM" in plan(upa)
    lines, orders = tables["lineitem"][0], {o[0]: o for o in tables["orders"][0]}
    want = {}
    for order, _, supplier, _ in lines:
        if order in orders and orders[order][1] in range(1, 5):
            key = (orders[order][1], supplier)
            want[key] = want.get(key, False) or orders[order][2] == "O"
    assert sorted(tuple(r) for r in upa.select("user_id", "plant_id", "is_active", "global_role_id").collect()) == sorted(
        (u, p, active, 1) for (u, p), active in want.items())
