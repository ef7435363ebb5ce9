"""Tenant row filter and membership operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .filters import at_least


def visible_orgs(members: DataFrame, user_id: int | None = None, min_role: str = "viewer") -> DataFrame:
    """(user_id, organization_id) pairs a user may see, or all pairs without ``user_id``."""
    rows = members.filter(at_least(F.col("role"), min_role))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.select("user_id", "organization_id").distinct()


def tenant_view(
    df: DataFrame, level: str, members: DataFrame, user_id: int, projects: DataFrame | None = None,
    pages: DataFrame | None = None, min_role: str = "viewer",
) -> DataFrame:
    """Rows of ``df`` the user may see.

    ``level`` names the key the table hangs on: organization, project (projects, runs, pages)
    or page (snapshots, scores, embeddings). Semi joins only, so no row is ever multiplied.
    """
    orgs = visible_orgs(members, user_id, min_role).select("organization_id")
    if level == "organization":
        return df.join(orgs, "organization_id", "left_semi")
    allowed = projects.join(orgs, "organization_id", "left_semi").select("project_id")
    if level == "project":
        return df.join(allowed, "project_id", "left_semi")
    if level == "page":
        return df.join(pages.join(allowed, "project_id", "left_semi").select("page_id"), "page_id", "left_semi")
    raise ValueError(f"unknown level: {level}")


def members_with_users(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with the user nested as a struct."""
    nested = users.select("user_id", F.struct("user_id", "email", "name").alias("user"))
    return members.join(nested, "user_id")


def orgs_of_users(members: DataFrame, organizations: DataFrame) -> DataFrame:
    return members.join(organizations, "organization_id").select("user_id", "organization_id", "name", "role")


def removable(members: DataFrame) -> DataFrame:
    """Flag members who may be removed or downgraded: everybody but a sole admin."""
    admins = members.groupBy("organization_id").agg(F.count_if(F.col("role") == "admin").alias("admin_count"))
    return members.join(admins, "organization_id").withColumn(
        "can_remove", (F.col("role") != "admin") | (F.col("admin_count") > 1)
    )


def with_organization(projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Projects with the organisation name flattened in; 'Unknown' where there is none."""
    names = organizations.select("organization_id", F.col("name").alias("organization_name"))
    return projects.join(names, "organization_id", "left").withColumn(
        "organization_name", F.coalesce("organization_name", F.lit("Unknown"))
    )
