"""Role / plant / workspace access as bulk relations.

The per-request checks of a web service become joins over whole tables: the
output is the set of (user, object) pairs that pass, or -- for request
streams -- one verdict per request.  Nothing emits every (user, object) pair of
a group: card access is evaluated for a requests table, so its size is the
number of requests, not cards x members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut_lineage

# Permission names.
VIEW_ANY_USER_CARDS = "view_any_user_cards"
PERMISSION_NAMES = (
    "view_any_user_cards",
    "create_any_user_cards",
    "delete_any_user_cards",
    "edit_any_user_cards",
    "admin_access",
    "view_plant_data",
    "edit_plant_data",
    "manage_users",
    "manage_workspaces",
)


def effective_permissions(upa: DataFrame, role_permissions: DataFrame, permissions: DataFrame,
                          per_plant: bool = True) -> DataFrame:
    """Distinct ``(user_id, plant_id, permission)`` over active access rows
    (or ``(user_id, permission)`` for the any-plant form).

    Few roles and names match very many access rows, so a shuffle by role or by permission would put most rows into a
    few tasks.  The names of each role are therefore joined first and written: of measured size, they are broadcast
    unless they are large, which takes many roles."""
    names = cut_lineage(role_permissions.select("role_id", "permission_id")
                        .join(permissions.select(F.col("id").alias("permission_id"), F.col("name").alias("permission")),
                              "permission_id")
                        .select("role_id", "permission").distinct())
    grants = (upa.filter("is_active").select("user_id", "plant_id", F.col("global_role_id").alias("role_id"))
              .join(names, "role_id"))
    keys = ["user_id", "plant_id", "permission"] if per_plant else ["user_id", "permission"]
    return grants.select(*keys).distinct()


def plant_access(upa: DataFrame, plants: DataFrame) -> DataFrame:
    """``(user_id, plant_id)`` where the access row and the plant are both active."""
    return (upa.filter("is_active").select("user_id", "plant_id")
            .join(plants.filter("is_active").select(F.col("id").alias("plant_id")), "plant_id")
            .distinct())


def active_plants(plants: DataFrame) -> DataFrame:
    """Active plants ordered by name."""
    return plants.filter("is_active").select("id", "name").orderBy("name", "id")


def workspace_roles(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    """``(user_id, workspace_id, is_owner, is_member)`` for active workspaces;
    owner pairs and member pairs are unioned then folded per pair (no fan-out)."""
    ws = workspaces.filter("is_active")
    owners = ws.select(F.col("owner_id").alias("user_id"), F.col("id").alias("workspace_id"),
                       F.lit(True).alias("o"), F.lit(False).alias("m"))
    mems = (members.select("user_id", "workspace_id")
            .join(ws.select(F.col("id").alias("workspace_id")), "workspace_id")
            .select("user_id", "workspace_id", F.lit(False).alias("o"), F.lit(True).alias("m")))
    return (owners.unionByName(mems).groupBy("user_id", "workspace_id")
            .agg(F.bool_or("o").alias("is_owner"), F.bool_or("m").alias("is_member")))


def accessible_workspaces(users: DataFrame, upa: DataFrame, plants: DataFrame, workspaces: DataFrame,
                          members: DataFrame) -> DataFrame:
    """Every ``(user, workspace)`` a user may open: active user, active workspace,
    owner or member, and active access to the workspace's plant.
    Output: ``user_id, plant_id, workspace_id, name, owner_id, user_role``."""
    roles = workspace_roles(workspaces, members)
    ws = workspaces.filter("is_active").select(F.col("id").alias("workspace_id"), "name", "owner_id", "plant_id")
    pa = plant_access(upa, plants)
    act_users = users.filter("is_active").select(F.col("id").alias("user_id"))
    return (roles.join(ws, "workspace_id").join(pa, ["user_id", "plant_id"], "left_semi")
            .join(act_users, "user_id", "left_semi")
            .select("user_id", "plant_id", "workspace_id", "name", "owner_id",
                    F.when(F.col("is_owner"), F.lit("owner")).otherwise(F.lit("member")).alias("user_role")))


def workspace_access_with_fallback(requests: DataFrame, accessible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per request ``(user_id, workspace_id, plant_id)`` the verdict and, when denied,
    the workspaces the user may open in that plant instead.

    Returns two relations, with no per-user list ever collected:
    ``verdicts`` -- one row per request with ``has_access`` and ``alternatives`` (count);
    ``alternatives`` -- one row per (denied request, available workspace)."""
    acc = accessible.select("user_id", "plant_id", "workspace_id").withColumn("_ok", F.lit(True))
    req = requests.select("user_id", "workspace_id", "plant_id").distinct()
    judged = req.join(acc, ["user_id", "plant_id", "workspace_id"], "left").withColumn(
        "has_access", F.coalesce("_ok", F.lit(False))).drop("_ok")
    options = accessible.select("user_id", "plant_id", F.col("workspace_id").alias("available_workspace_id"))
    alternatives = judged.filter(~F.col("has_access")).drop("has_access").join(options, ["user_id", "plant_id"])
    counts = options.groupBy("user_id", "plant_id").agg(F.count(F.lit(1)).alias("_n"))
    verdicts = (judged.join(counts, ["user_id", "plant_id"], "left")
                .withColumn("alternatives", F.when(F.col("has_access"), F.lit(0))
                            .otherwise(F.coalesce("_n", F.lit(0))).cast("bigint"))
                .drop("_n"))
    return verdicts, alternatives


def card_access(requests: DataFrame, cards: DataFrame, workspaces: DataFrame, members: DataFrame,
                any_permissions: DataFrame, admins: DataFrame | None = None) -> DataFrame:
    """Per request ``(card_id, user_id)``: allowed when the user holds the admin role (``admins(user_id)``),
    owns the card, or owns / belongs to the card's workspace (card and workspace active), or holds
    ``view_any_user_cards``.  ``reason`` is the first rule that grants it."""
    req = requests.select("card_id", "user_id").distinct()
    c = cards.select(F.col("id").alias("card_id"), F.col("user_id").alias("card_owner"), "workspace_id",
                     F.col("is_active").alias("card_active"))
    r = req.join(c, "card_id", "left")
    roles = workspace_roles(workspaces, members).select("user_id", "workspace_id", F.lit(True).alias("_ws"))
    r = r.join(roles, ["user_id", "workspace_id"], "left")
    perm = (any_permissions.filter(F.col("permission") == VIEW_ANY_USER_CARDS)
            .select("user_id").distinct().withColumn("_perm", F.lit(True)))
    r = r.join(perm, "user_id", "left")
    if admins is not None:
        r = r.join(admins.select("user_id").distinct().withColumn("_admin", F.lit(True)), "user_id", "left")
    else:
        r = r.withColumn("_admin", F.lit(False))
    reason = (F.when(F.col("_admin"), F.lit("admin"))
              .when(F.col("card_owner") == F.col("user_id"), F.lit("owner"))
              .when(F.col("_ws") & F.col("card_active"), F.lit("workspace"))
              .when(F.col("_perm"), F.lit("permission")))
    return r.select("card_id", "user_id", reason.isNotNull().alias("allowed"), reason.alias("reason"))


def legacy_permissions(users: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Single-role schema -- ``(user_id, permission)`` through the user's ``role_id``
    (no DISTINCT: a permission granted twice to the role is listed twice)."""
    return (users.select(F.col("id").alias("user_id"), "role_id")
            .join(role_permissions.select("role_id", "permission_id"), "role_id")
            .join(permissions.select(F.col("id").alias("permission_id"), F.col("name").alias("permission")),
                  "permission_id")
            .select("user_id", "permission"))


def user_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """The role of each user in the single-role schema."""
    return (users.select(F.col("id").alias("user_id"), "role_id")
            .join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name")), "role_id")
            .select("user_id", "role_id", "role_name"))


def permission_checks(requests: DataFrame, permissions_by_plant: DataFrame, users: DataFrame) -> DataFrame:
    """X1 membership test per request ``(user_id, plant_id, permission)``: allowed when the
    user holds it in that plant (a NULL plant means any plant); while the system has no
    users at all, every request is allowed (first-time setup)."""
    first_time = users.isEmpty()  # one-row probe, not a scan of the table
    req = requests.select("user_id", "plant_id", "permission")
    held = permissions_by_plant.select("user_id", "plant_id", "permission").withColumn("_hit", F.lit(True))
    any_plant = held.select("user_id", "permission", F.col("_hit").alias("_any")).distinct()
    out = (req.join(held, ["user_id", "plant_id", "permission"], "left")
           .join(any_plant, ["user_id", "permission"], "left"))
    granted = F.when(F.col("plant_id").isNull(), F.coalesce("_any", F.lit(False))) \
        .otherwise(F.coalesce("_hit", F.lit(False)))
    allowed = F.lit(True) if first_time else granted
    return out.select("user_id", "plant_id", "permission", allowed.alias("allowed"))
