"""Driver tables -> the engine's data model.

The engine's native inputs are the sensor model (``time_series``, ``tags``,
hierarchy, access tables).  The test corpus is TPC-H-like, so these adapters
derive model tables from it with plain DataFrame expressions; every adapter
reads whole tables and its output grows with them.  The same derivations are
written as SQL in ``ferrule.plans.oracle`` for the DuckDB cross-check.

Mappings
* series by event type: tag = ``event_type`` (ids dense by name from 1),
  ``timestamp = ts``, ``value`` = the reading as text; readings whose
  ``props.k`` is 13 / 42 / 77 are stored as ``BAD`` / negative / ``NaN`` text
  so the strict numeric rule has real work.
* series by user: tag id = ``user_id``, tag name ``user_<id>``.
* series by supplier: tag id = ``l_suppkey``, ``timestamp = l_shipdate``,
  value = ``l_quantity`` -- seven years, for month/quarter buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.tables import read_table

# Props.k codes that turn a reading into non-numeric text.
BAD_TEXT_K = 13
NEGATIVE_K = 42
NAN_TEXT_K = 77


def reading_text(value: Column, props: Column) -> Column:
    k = F.get_json_object(props, "$.k").try_cast("int")
    text = value.cast("string")
    return (F.when(k == BAD_TEXT_K, F.lit("BAD"))
            .when(k == NEGATIVE_K, F.concat(F.lit("-"), text))
            .when(k == NAN_TEXT_K, F.lit("NaN"))
            .otherwise(text))


def type_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag dimension for event-type series: id dense by name starting at 1."""
    from ferrule.operators.ordinal import with_global_ordinal

    from ferrule.session import cut_lineage

    names = read_table(spark, sf_dir, "events", ["event_type"]).distinct()
    # written once: the ids come from a non-deterministic expression, so every plan
    # branch would otherwise recompute the ordinal instead of reusing it
    tags = cut_lineage(with_global_ordinal(names, ["event_type"], name="id", start=1))
    return tags.select(
        F.col("id").cast("int").alias("id"),
        F.col("event_type").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("unit_of_measure"),
        F.lit(1).alias("plant_id"),
        F.lit(True).alias("is_active"),
        F.lit(1).alias("data_source_id"),
    )


def series_by_type(spark: SparkSession, sf_dir: str, tags: DataFrame | None = None) -> DataFrame:
    """``time_series(tag_id, timestamp, value, quality)`` keyed by event type."""
    tags = tags if tags is not None else type_tags(spark, sf_dir)
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value", "props"])
    joined = ev.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("event_type")),
                     "event_type")
    return joined.select(
        "tag_id",
        F.col("ts").alias("timestamp"),
        reading_text(F.col("value"), F.col("props")).alias("value"),
        F.lit("GOOD").alias("quality"),
    )


def user_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read_table(spark, sf_dir, "events", ["user_id"]).distinct()
    return users.select(
        F.col("user_id").cast("int").alias("id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("unit_of_measure"),
        F.lit(1).alias("plant_id"),
        F.lit(True).alias("is_active"),
        F.lit(1).alias("data_source_id"),
    )


def series_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value", "props"])
    return ev.select(
        F.col("user_id").cast("int").alias("tag_id"),
        F.col("ts").alias("timestamp"),
        reading_text(F.col("value"), F.col("props")).alias("value"),
        F.lit("GOOD").alias("quality"),
        "event_id",
    )


def series_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    return li.select(
        F.col("l_suppkey").cast("int").alias("tag_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").cast("string").alias("value"),
        F.lit("GOOD").alias("quality"),
    )


def with_frequency(series: DataFrame) -> DataFrame:
    """Attach the per-tag detected frequency as the stored ``frequency`` column."""
    from ferrule.operators.frequency import frequency_by_key

    freq = frequency_by_key(series, ["tag_id"], "timestamp").select("tag_id", "frequency")
    return series.join(freq, "tag_id", "left")


# ---------------------------------------------------------------------------
# Hierarchy inputs
# ---------------------------------------------------------------------------

def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path list ``region:nation:segment`` per customer (source row = customer key).
    The same segment label sits under every nation: one label, many paths."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    j = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.select(F.col("c_custkey").alias("src_row"),
                    F.concat_ws(":", "r_name", "n_name", "c_mktsegment").alias("path"))


# Parent mapping of the supplier hierarchy (a functional graph, so it has
# cycles, chains into cycles, self-parents and parents that do not exist).
SUPPLIER_PARENT_MULT = 37
SUPPLIER_PARENT_ADD = 11
SUPPLIER_PARENT_MOD = 113
SUPPLIER_PATH_MOD = 40


def supplier_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``hierarchy_config`` with defects: label = supplier name, parent = the supplier
    ``pmod(key*37+11, 113)+1`` (missing keys make orphans), inactive when the account
    balance is negative, path = ``nation:pmod(key, 40)`` (repeats make duplicate paths)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    parent_key = F.pmod(F.col("s_suppkey") * SUPPLIER_PARENT_MULT + SUPPLIER_PARENT_ADD,
                        F.lit(SUPPLIER_PARENT_MOD)) + 1
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select(
        F.col("s_name").alias("label"),
        F.concat(F.col("n_name"), F.lit(":"), F.pmod(F.col("s_suppkey"), F.lit(SUPPLIER_PATH_MOD)).cast("string"))
        .alias("path"),
        F.format_string("Supplier#%09d", parent_key).alias("parent_label"),
        F.col("s_suppkey").cast("int").alias("display_order"),
        F.col("s_name").alias("display_name"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.lit(None).cast("string").alias("icon"),
    )


# ---------------------------------------------------------------------------
# Access inputs: customers are users, nations are plants, orders give access,
# workspaces are (nation, order priority) groups with the ordering customers as members,
# line items are cards.
# ---------------------------------------------------------------------------

# Permissions granted to each role (roles are market segments).
ROLE_GRANTS = {
    "AUTOMOBILE": ("view_plant_data",),
    "BUILDING": ("view_plant_data", "edit_plant_data"),
    "FURNITURE": ("view_plant_data", "view_any_user_cards"),
    "HOUSEHOLD": ("view_plant_data", "manage_workspaces"),
    "MACHINERY": ("admin_access", "view_plant_data", "edit_plant_data", "view_any_user_cards", "manage_users"),
}
INACTIVE_REGION = 4
INACTIVE_PRIORITY = "5-LOW"
URGENT_PRIORITY = "1-URGENT"


def _ws_id(nation: Column, priority: Column) -> Column:
    return (nation * 10 + F.substring(priority, 1, 1).cast("int")).cast("int")


# Fixed value: line items that one task of the access join holds, about.
ROWS_PER_TASK = 500_000


def access_tables(spark: SparkSession, sf_dir: str) -> dict:
    from ferrule.operators.access import PERMISSION_NAMES
    from ferrule.operators.ordinal import with_global_ordinal

    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"])
    supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])

    users = cust.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("is_active"))
    plants = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                           (F.col("n_regionkey") != INACTIVE_REGION).alias("is_active"))
    from ferrule.session import cut_lineage

    roles = cut_lineage(with_global_ordinal(cust.select(F.col("c_mktsegment").alias("name")).distinct(), ["name"],
                                            name="id", start=1).select(F.col("id").cast("int").alias("id"), "name"))
    permissions = spark.createDataFrame([(i + 1, n) for i, n in enumerate(PERMISSION_NAMES)], "id int, name string")
    grants = spark.createDataFrame([(r, p) for r, ps in ROLE_GRANTS.items() for p in ps], "role string, perm string")
    role_permissions = (grants.join(roles.select(F.col("name").alias("role"), F.col("id").alias("role_id")), "role")
                        .join(permissions.select(F.col("name").alias("perm"), F.col("id").alias("permission_id")),
                              "perm")
                        .select("role_id", "permission_id"))
    cust_role = cust.join(roles.select(F.col("name").alias("c_mktsegment"), F.col("id").alias("global_role_id")),
                          "c_mktsegment").select("c_custkey", "c_nationkey", "global_role_id")
    # so many tasks that each joins a bounded number of lines, however many lines there are
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // ROWS_PER_TASK))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus").repartition(tasks, "o_orderkey")
    ln = li.select("l_orderkey", "l_suppkey").repartition(tasks, "l_orderkey")
    upa = (o.join(ln, o.o_orderkey == ln.l_orderkey).join(supp, ln.l_suppkey == supp.s_suppkey)
           .groupBy(F.col("o_custkey").alias("user_id"), F.col("s_nationkey").alias("plant_id"))
           .agg(F.bool_or(F.col("o_orderstatus") == "O").alias("is_active")).repartition(tasks, "user_id")
           .join(cust_role.select(F.col("c_custkey").alias("user_id"), "global_role_id").repartition(tasks, "user_id"), "user_id"))
    oc = orders.join(cust_role, orders.o_custkey == cust_role.c_custkey)
    workspaces = (oc.groupBy("c_nationkey", "o_orderpriority").agg(F.min("o_custkey").alias("owner_id"))
                  .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                  .select(_ws_id(F.col("c_nationkey"), F.col("o_orderpriority")).alias("id"),
                          F.concat_ws(" / ", "n_name", "o_orderpriority").alias("name"),
                          "owner_id", F.col("c_nationkey").alias("plant_id"),
                          (F.col("o_orderpriority") != INACTIVE_PRIORITY).alias("is_active")))
    members = oc.select(_ws_id(F.col("c_nationkey"), F.col("o_orderpriority")).alias("workspace_id"),
                        F.col("o_custkey").alias("user_id")).distinct().withColumn("is_active", F.lit(True))
    # (order, line number) is not unique in the line items: a card is one such pair,
    # active unless any of its lines was returned
    lines = (li.groupBy("l_orderkey", "l_linenumber")
             .agg(F.bool_and(F.col("l_returnflag") != "R").alias("is_active")))
    cards = (lines.join(oc, lines.l_orderkey == oc.o_orderkey)
             .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                     _ws_id(F.col("c_nationkey"), F.col("o_orderpriority")).alias("workspace_id"),
                     F.col("o_custkey").alias("user_id"), "is_active"))
    card_requests = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("card_id"),
                              F.col("l_suppkey").alias("user_id"))
    ws_requests = (oc.select(F.col("o_custkey").alias("user_id"),
                             _ws_id(F.col("c_nationkey"), F.lit(URGENT_PRIORITY)).alias("workspace_id"),
                             F.col("c_nationkey").alias("plant_id")).distinct())
    legacy_users = cust_role.select(F.col("c_custkey").alias("id"), F.col("global_role_id").alias("role_id"))
    return dict(users=users, plants=plants, roles=roles, permissions=permissions, legacy_users=legacy_users,
                role_permissions=role_permissions, upa=upa, workspaces=workspaces, members=members,
                cards=cards, card_requests=card_requests, ws_requests=ws_requests)


# Allowed reading range per event-type tag (range-check fixture).
TYPE_LIMITS = (
    ("click", 0.0, 400.0),
    ("error", 10.0, 450.0),
    ("purchase", 0.0, 500.0),
    ("signup", 5.0, 480.0),
    ("view", 0.0, 300.0),
)


def type_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPE_LIMITS), "tag_name string, min double, max double")


# Timestamp text layouts per props.k quarter (normalisation fixture).
TEXT_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "d/M/yyyy HH:mm:ss", "M/d/yyyy", "yyyy-MM-dd")


def timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event time rendered as text in one of four layouts chosen by ``props.k``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "props"])
    q = F.floor(F.get_json_object("props", "$.k").try_cast("int") / 25)
    text = (F.when(q == 0, F.date_format("ts", TEXT_LAYOUTS[0]))
            .when(q == 1, F.date_format("ts", TEXT_LAYOUTS[1]))
            .when(q == 2, F.date_format("ts", TEXT_LAYOUTS[2]))
            .otherwise(F.date_format("ts", TEXT_LAYOUTS[3])))
    return ev.select("event_id", text.alias("text"))


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``data_sources``: one per supplier in its nation (plant); inactive when the balance
    is negative; created at 2020-01-01 plus a per-supplier number of minutes."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return s.select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_nationkey").cast("int").alias("plant_id"),
                    (F.col("s_acctbal") >= 0).alias("is_active"),
                    F.timestamp_add("MINUTE", F.pmod(F.col("s_suppkey") * 7919, F.lit(1000)),
                                    F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"))
