"""Who may see and do what: tenants, roles and their actions, fields that may be edited, and lists of users."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import page_after

#: What each role may do.
PERMISSIONS = {"admin": ("users.manage", "audit.read", "review.decide", "documents.read"), "editor": ("review.decide", "documents.edit", "documents.read"), "reader": ("documents.read",)}
#: Fields of documents that may be edited by hand; what kind of task is looked at first.
EDITABLE = ("title", "number", "series", "doc_date", "in_force_date", "subject", "court_code")
PRIORITIES = {"parse_failure": 1, "amendment": 2, "miss_report": 3, "metadata": 4, "treatment": 5}


def of_tenant(tenant: Column, mine: Column) -> Column:
    """Rows of a tenant, and those of none, which all share."""
    return tenant.isNull() | tenant.eqNullSafe(mine)


def with_roles(users: DataFrame, user_roles: DataFrame, roles: list[str]) -> DataFrame:
    """Users that have any of the roles."""
    return users.join(user_roles.where(F.col("role").isin(roles)), "user_id", "left_semi")


def role_lists(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Each user with its roles, sorted; an empty list where it has none."""
    own = user_roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return users.join(own, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def allowed(users: DataFrame, user_roles: DataFrame, action: str) -> DataFrame:
    """users with `allowed`: whether any of their roles grants the action."""
    granting = [role for role, actions in PERMISSIONS.items() if action in actions]
    hit = user_roles.where(F.col("role").isin(granting)).select("user_id").distinct().withColumn("allowed", F.lit(True))
    return users.join(hit, "user_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def unknown_fields(edits: DataFrame, fields: str = "fields", known: tuple[str, ...] = EDITABLE) -> DataFrame:
    """edits with `unknown`: the names in a map of fields that may not be edited, sorted."""
    return edits.withColumn("unknown", F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))))


def priority(kind: Column, least: int = 9) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), kind), F.lit(least))


def cursor(*values: Column) -> Column:
    """An opaque mark of the last row of a page."""
    return F.base64(F.encode(F.to_json(F.array(*[v.cast("string") for v in values])), "UTF-8"))


def seen(mark: str | None, *names: str) -> dict[str, object]:
    """The keys of the last row of a page by its mark; none of them without a mark. Refused where the mark is none."""
    if mark is None:
        return dict.fromkeys(names)
    try:
        values = json.loads(base64.b64decode(mark, validate=True))
    except ValueError as broken:
        raise ValueError("no mark of a page") from broken
    if not isinstance(values, list) or len(values) != len(names):
        raise ValueError("no mark of a page")
    return dict(zip(names, values, strict=True))


def page(df: DataFrame, keys: list[str], limit: int, mark: str | None = None, descending: bool = False) -> DataFrame:
    """A page of df beyond a mark, with the exact number of all rows (`total`) and the mark of the next page (null at the end).

    Rows are only sorted as far as the page goes: the page and one row more are all that is numbered.
    """
    rows = page_after(df, seen(mark, *keys), limit, descending)
    total = df.select(F.count("*")).scalar()
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    rows = rows.withColumn("nth__", F.row_number().over(Window.orderBy(*order))).withColumn("more__", F.count("*").over(Window.partitionBy()) > limit)
    following = F.max(F.when(F.col("more__") & (F.col("nth__") == limit), cursor(*[F.col(k) for k in keys]))).over(Window.partitionBy())
    return rows.withColumn("next", following).withColumn("total", total).where(F.col("nth__") <= limit).drop("nth__", "more__")
