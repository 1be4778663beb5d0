"""Equipment hierarchy: path lists -> adjacency table, lookups, tree, integrity.

A hierarchy row is ``(label, path, parent_label, display_order, display_name,
is_active, icon)``; paths are ``:``-separated.  Everything is set-based:

* parsing is a per-row ``posexplode`` of the cleaned path parts, first-seen
  order is a global ordinal (no single-partition window);
* descendants come from path doubling towards the roots (two joins per round, as many
  rounds as the depth has binary digits);
* cycle detection uses pointer doubling on the ``label -> parent`` map:
  ``log2(#labels)`` joins decide for every label at once whether walking up
  ever ends -- no per-node walk, no recursion depth limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import default_icon, display_name, strip_ws
from ferrule.operators.ordinal import with_global_ordinal
from ferrule.session import cut_lineage, cut_lineage_counting

def path_parts(path) -> Column:
    """Cleaned components: split on ``:``, trim each, drop blanks."""
    col = F.col(path) if isinstance(path, str) else path
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ":"), lambda x: strip_ws(x)),
                    lambda x: x != "")


def parse_paths(paths: DataFrame, path_col: str = "path", row_col: str = "src_row",
                with_icon: bool = False) -> DataFrame:
    """Path list -> unique nodes.

    Every prefix of every path is a node; the first occurrence (by source row, then
    level) defines ``display_order`` (0-based, dense, in first-seen order)."""
    parts = paths.select(F.col(row_col).alias("_row"), path_parts(path_col).alias("_parts"))
    nodes = parts.select("_row", "_parts", F.posexplode("_parts").alias("_lvl", "label"))
    nodes = nodes.select(
        "_row", "_lvl", "label",
        F.array_join(F.slice("_parts", 1, F.col("_lvl") + 1), ":").alias("path"),
        F.when(F.col("_lvl") > 0, F.element_at("_parts", F.col("_lvl"))).alias("parent_label"),
    )
    first = (nodes.groupBy("path")
             .agg(F.min(F.struct("_row", "_lvl", "label", "parent_label")).alias("_f"))
             .select("path", "_f._row", "_f._lvl", "_f.label", "_f.parent_label"))
    ordered = with_global_ordinal(first, ["_row", "_lvl"], name="display_order", start=0)
    out = ordered.select(
        "label", "path", "parent_label", F.col("display_order").cast("int").alias("display_order"),
        display_name(F.col("label")).alias("display_name"),
        (default_icon(F.col("label")) if with_icon else F.lit(None).cast("string")).alias("icon"),
    )
    return out.withColumn("is_active", F.lit(True))


def path_summary(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Upload summary (A15): total rows, rows with a usable path, rows without."""
    ok = F.size(path_parts(path_col)) > 0
    return paths.agg(F.count(F.lit(1)).alias("total_rows"),
                     F.count_if(ok).alias("valid_paths"),
                     F.count_if(~ok).alias("invalid_paths"))


def parent_path(path) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.when(col.contains(":"), F.regexp_replace(col, r":[^:]*$", ""))


# ---------------------------------------------------------------------------
# Lookups (H4-H8)
# ---------------------------------------------------------------------------

def active_nodes(cfg: DataFrame) -> DataFrame:
    """H4: active rows ordered by (display_order, path)."""
    return cfg.filter("is_active").orderBy("display_order", "path")


def all_nodes(cfg: DataFrame) -> DataFrame:
    """H5: every row, inactive included, ordered by (display_order, label)."""
    return cfg.orderBy("display_order", "label")


def nodes_by_label(cfg: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """H6 / H7: active rows with a label (and path), ordered by path."""
    out = cfg.filter(F.col("is_active") & (F.col("label") == label))
    if path is not None:
        out = out.filter(F.col("path") == path)
    return out.orderBy("path")


def children_of(cfg: DataFrame, parent_label: str) -> DataFrame:
    """H8: active direct children of one parent, ordered by (display_order, label)."""
    return (cfg.filter(F.col("is_active") & (F.col("parent_label") == parent_label))
            .orderBy("display_order", "label"))


def children_all(cfg: DataFrame) -> DataFrame:
    """H8 bulk: one row per (parent, active child) -- flat, so a parent with a huge
    number of children is spread over partitions instead of collected into one list."""
    return (cfg.filter(F.col("is_active") & F.col("parent_label").isNotNull())
            .select("parent_label", F.col("label").alias("child_label"), F.col("path").alias("child_path"),
                    F.col("display_order").alias("child_order")))


def child_counts(cfg: DataFrame) -> DataFrame:
    return children_all(cfg).groupBy("parent_label").agg(F.count(F.lit(1)).alias("child_count"))


def tree(cfg: DataFrame) -> DataFrame:
    """One entry per root or parent node with its direct children (flat rows;
    roots without children keep one row with NULL child).  Keyed by path."""
    act = cfg.filter("is_active").select("label", "path", "parent_label", "display_order")
    kids = act.select(parent_path("path").alias("node_path"), F.col("label").alias("child_label"),
                      F.col("path").alias("child_path"), F.col("display_order").alias("child_order")) \
        .filter(F.col("node_path").isNotNull())
    nodes = act.select(F.col("label").alias("node_label"), F.col("path").alias("node_path"),
                       F.col("parent_label").isNull().alias("is_root"))
    with_kids = nodes.join(kids, "node_path", "left")
    return with_kids.filter(F.col("is_root") | F.col("child_path").isNotNull())


# ---------------------------------------------------------------------------
# Descendants (H9) and cascade delete (M6)
# ---------------------------------------------------------------------------

def descendants(cfg: DataFrame, roots: DataFrame) -> DataFrame:
    """All records reachable from each root label through ``parent_label = label`` links
    among active rows: ``root_label, label, path, depth`` (minimum depth per record).

    Path doubling upwards: ``up`` links a label to the labels exactly ``2**k`` steps above it and ``found`` holds
    the roots fewer than ``2**k`` steps above.  A round is two joins, and rounds grow with the logarithm of
    the depth.  The rounds end when no walk goes on, or, with cycles, when ``2**k`` passes the number of
    labels: no shortest walk is longer.  ``roots`` is a DataFrame with a ``label`` column."""
    act = cfg.filter("is_active").select("label", "path", "parent_label")
    edges = act.filter(F.col("parent_label").isNotNull())
    root = roots.select("label").distinct()
    links = F.count(F.lit(1))
    up, seen = cut_lineage_counting(edges.select("label", F.col("parent_label").alias("above")).distinct(), links=links)
    found = cut_lineage(root.select("label", F.col("label").alias("root_label"), F.lit(0).alias("depth")))
    labels = up.select("label").distinct().count() + 1
    step = 1
    while step <= labels and seen["links"]:
        further = up.join(found.withColumnRenamed("label", "above"), "above").select(
            "label", "root_label", (F.col("depth") + step).alias("depth"))
        found = cut_lineage(found.unionByName(further).groupBy("label", "root_label").agg(F.min("depth").alias("depth")))
        up, seen = cut_lineage_counting(up.join(up.select(F.col("label").alias("above"), F.col("above").alias("top")), "above")
                                        .select("label", F.col("top").alias("above")).distinct(), links=links)
        step *= 2
    return (edges.join(found.withColumnRenamed("label", "parent_label"), "parent_label")
            .groupBy("root_label", "label", "path").agg((F.min("depth") + 1).cast("int").alias("depth")))


def delete_by_label(cfg: DataFrame, labels: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """M6: remove rows by label; with ``cascade`` their descendants go too.
    Returns ``(remaining, deleted)``."""
    by_label = cfg.join(labels.select("label").distinct(), "label", "left_semi")
    deleted = by_label
    if cascade:
        d = descendants(cfg, labels.select("label").distinct()).select("path").distinct()
        deleted = by_label.unionByName(cfg.join(d, "path", "left_semi")).dropDuplicates(["label", "path"])
    remaining = cfg.join(deleted.select("label", "path"), ["label", "path"], "left_anti")
    return remaining, deleted


# ---------------------------------------------------------------------------
# Integrity
# ---------------------------------------------------------------------------

def orphans(cfg: DataFrame) -> DataFrame:
    """Rows whose parent label matches no row (inactive rows count as existing)."""
    labels = cfg.select(F.col("label").alias("parent_label")).distinct()
    return cfg.filter(F.col("parent_label").isNotNull()).join(labels, "parent_label", "left_anti")


def duplicate_paths(cfg: DataFrame) -> DataFrame:
    """Paths held by more than one row."""
    return cfg.groupBy("path").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def _next_map(cfg: DataFrame) -> DataFrame:
    """label -> parent label of its first active record (by path)."""
    act = cfg.filter("is_active")
    return (act.groupBy("label").agg(F.min_by("parent_label", "path").alias("nxt")))


def _jumps(cfg: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer doubling on the ``label -> parent`` map of first active records.

    Returns the written tables ``(label, j)`` of jumps of 1, 2, 4, ... steps, and the last one with the number of steps
    walked, ``(label, j, steps)``: where ``j`` is NULL the walk ended after ``steps`` steps, elsewhere it never ends.
    A walk that ends does so within #labels steps; and finite walk lengths are contiguous (a label at
    depth d has a parent at d - 1), so a round in which no walk ends is the last."""
    nxt = _next_map(cfg)
    # a parent label with no active record ends the walk
    walking = F.count_if(F.col("j").isNotNull())
    jump, seen = cut_lineage_counting(nxt.join(nxt.select(F.col("label").alias("nxt"), F.lit(True).alias("_known")), "nxt", "left")
                       .select("label", F.when(F.col("_known"), F.col("nxt")).alias("j"))
                       .withColumn("steps", F.when(F.col("j").isNotNull(), 1).otherwise(0).cast("bigint")), alive=walking)
    tables, alive = [jump], seen["alive"]
    while alive:
        ahead = jump.select(F.col("label").alias("j"), F.col("j").alias("jj"), F.col("steps").alias("more"))
        jump, seen = cut_lineage_counting(jump.join(ahead, "j", "left").select(
            "label", F.col("jj").alias("j"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), alive=walking)
        tables.append(jump)
        if seen["alive"] == alive:
            break
        alive = seen["alive"]
    return tables, jump


def endless_labels(cfg: DataFrame) -> DataFrame:
    """Labels whose upward walk never ends (they sit on, or lead into, a cycle)."""
    return _jumps(cfg)[1].filter("j IS NOT NULL").select("label")


def circular_records(cfg: DataFrame) -> DataFrame:
    """Active records whose walk up the parents returns to their own label or
    revisits a label (so records leading into a cycle are flagged too)."""
    act = cfg.filter("is_active")
    tables, last = _jumps(cfg)
    ends = last.select("label", F.col("j").isNotNull().alias("_endless"), "steps")
    starts = act.filter(F.col("parent_label").isNotNull()).select("label", "path", "parent_label")
    starts = starts.join(ends.select(F.col("label").alias("parent_label"), "_endless", F.col("steps").alias("_from")),
                         "parent_label", "left")
    flagged = starts.filter(F.col("_endless") | (F.col("parent_label") == F.col("label"))).select(
        "label", "path", "parent_label")
    # A finite walk can only come back to the start label when the record is not the first active record
    # of its label.  The label, if met, lies ``steps(parent) - steps(label)`` above the parent: go there bit by bit.
    firsts = act.groupBy("label").agg(F.min("path").alias("_first_path"))
    own = ends.filter(~F.col("_endless")).select("label", F.col("steps").alias("_to"))
    walking, seen = cut_lineage_counting(starts.filter(~F.coalesce("_endless", F.lit(True)) & (F.col("parent_label") != F.col("label")))
                          .join(firsts, "label").filter(F.col("path") != F.col("_first_path")).join(own, "label")
                          .withColumn("_far", F.col("_from") - F.col("_to")).filter("_far > 0")
                          .select("label", "path", "parent_label", "_far", F.col("parent_label").alias("cur")), rows=F.count(F.lit(1)))
    if not seen["rows"]:
        return flagged
    for k, table in enumerate(tables):
        hop = table.select(F.col("label").alias("cur"), F.col("j").alias("_hop"))
        walking = walking.join(hop, "cur", "left").withColumn(
            "cur", F.when(F.shiftright("_far", k) % 2 == 1, F.col("_hop")).otherwise(F.col("cur"))).drop("_hop")
    back = walking.filter(F.col("cur") == F.col("label")).select("label", "path", "parent_label")
    return flagged.unionByName(back).distinct()


def integrity_report(cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issue rows ``(issue_type, label, parent_label, path, count)`` and a one-row
    summary ``(is_valid, total_records, orphaned, circular, duplicate_paths)``."""
    # per-record issues concern one row each; duplicate paths carry their row count
    o = orphans(cfg).select(F.lit("orphaned_records").alias("issue_type"), "label", "parent_label", "path",
                            F.lit(1).cast("bigint").alias("count"))
    c = circular_records(cfg).select(F.lit("circular_reference").alias("issue_type"), "label",
                                     "parent_label", "path", F.lit(1).cast("bigint").alias("count"))
    d = duplicate_paths(cfg).select(F.lit("duplicate_paths").alias("issue_type"),
                                    F.lit(None).cast("string").alias("label"),
                                    F.lit(None).cast("string").alias("parent_label"), "path",
                                    F.col("count").cast("bigint"))
    issues = o.unionByName(c).unionByName(d)
    counts = issues.groupBy().agg(
        F.count_if(F.col("issue_type") == "orphaned_records").alias("orphaned"),
        F.count_if(F.col("issue_type") == "circular_reference").alias("circular"),
        F.count_if(F.col("issue_type") == "duplicate_paths").alias("duplicate_paths"))
    total = cfg.filter("is_active").agg(F.count(F.lit(1)).alias("total_records"))
    summary = one_row_join(total, counts)
    summary = summary.withColumn(
        "is_valid", (F.col("orphaned") + F.col("circular") + F.col("duplicate_paths")) == 0)
    return issues, summary


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side of two one-row aggregates (joined on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


# ---------------------------------------------------------------------------
# Replace (H13), icon resolution
# ---------------------------------------------------------------------------

def replace_hierarchy(existing: DataFrame, new_nodes: DataFrame, plant_id=None,
                      plant_col: str = "plant_id") -> tuple[DataFrame, DataFrame]:
    """Validate-then-replace: the plant's rows are swapped for ``new_nodes`` only when the
    new set has no duplicate path, no orphan and no circular reference (the last two where it has parent
    labels).  Rows of other plants and of none stay.  Returns ``(table_after, summary(deleted, created))``."""
    if not duplicate_paths(new_nodes).isEmpty():
        raise ValueError("new hierarchy has duplicate paths")
    if "parent_label" in new_nodes.columns:
        if not orphans(new_nodes).isEmpty():
            raise ValueError("new hierarchy has rows whose parent does not exist")
        active = new_nodes if "is_active" in new_nodes.columns else new_nodes.withColumn("is_active", F.lit(True))
        if not circular_records(active).isEmpty():
            raise ValueError("new hierarchy has circular references")
    if plant_id is not None and plant_col in existing.columns:
        mine = F.col(plant_col).eqNullSafe(F.lit(plant_id))
        keep, gone = existing.filter(~mine), existing.filter(mine)
        new_nodes = new_nodes.withColumn(plant_col, F.lit(plant_id))
    else:
        keep, gone = existing.limit(0), existing
    after = keep.unionByName(new_nodes, allowMissingColumns=True)
    summary = one_row_join(gone.agg(F.count(F.lit(1)).alias("deleted")),
                            new_nodes.agg(F.count(F.lit(1)).alias("created")))
    return after, summary


def resolve_icons(cfg: DataFrame, icon_files: DataFrame, name_col: str = "file_name",
                  path_col: str = "file_path") -> DataFrame:
    """Icon short name -> stored file path; names with no file stay as given."""
    from ferrule.functions.text import icon_short_name

    files = (icon_files.select(icon_short_name(F.col(name_col)).alias("_short"), F.col(path_col).alias("_fp"))
             .groupBy("_short").agg(F.min("_fp").alias("_fp")))
    is_name = F.col("icon").isNotNull() & ~F.col("icon").startswith("/") & ~F.col("icon").startswith("http")
    out = cfg.join(files, is_name & (F.col("icon") == F.col("_short")), "left")
    return out.withColumn("icon", F.coalesce(F.col("_fp"), F.col("icon"))).drop("_short", "_fp")
