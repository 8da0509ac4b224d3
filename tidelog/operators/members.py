"""Members: look-ups, sign-in of new ones, and changes, as transforms of the member table (see sources.schemas)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import display_name, display_nickname, grantable_role, if_blank, is_placeholder

#: What a new member gets.
NEW_POSITION, NEW_STATUS = "JUNIOR", "ACTIVE"
KEY = ["provider", "provider_id"]


def find_member(members: DataFrame, provider: str, provider_id: str) -> DataFrame:
    return members.where((F.col("provider") == provider) & (F.col("provider_id") == provider_id))


def with_company(members: DataFrame, companies: DataFrame) -> DataFrame:
    """Members with their company's columns; null for members without one."""
    return members.join(companies, "company_id", "left")


def same_email_elsewhere(members: DataFrame, email: str, provider: str) -> DataFrame:
    """Members of another provider with this address that are not deleted; none for a placeholder address."""
    return members.where((F.col("email") == email) & (F.col("provider") != provider) & (F.col("status") != "DELETED") & ~is_placeholder(F.col("email")))


def email_conflicts(signing_in: DataFrame, members: DataFrame) -> DataFrame:
    """signing_in (email, provider) that another provider's member has already: email, provider, conflicting (the least name)."""
    real = signing_in.where(F.col("email").isNotNull() & ~is_placeholder(F.col("email")))
    others = members.where(F.col("status") != "DELETED").select("email", F.col("provider").alias("_other")).distinct()
    met = real.join(others, "email").where(F.col("_other") != F.col("provider"))
    return met.groupBy("email", "provider").agg(F.min("_other").alias("conflicting"))


def sign_in(requests: DataFrame, members: DataFrame) -> DataFrame:
    """New members to append. requests: seq, provider, provider_id, email, name, nickname, role; the first request of a key counts."""
    row = F.struct(*(c for c in requests.columns if c not in KEY))
    once = requests.groupBy(*KEY).agg(F.min_by(row, "seq").alias("row")).select(*KEY, "row.*")  # partial minima: a key that signs in very often is no single task's work
    new = once.join(members.select(*KEY), KEY, "left_anti")
    return new.select(
        *KEY,
        "email",
        display_name(F.col("name")).alias("name"),
        display_nickname(F.col("nickname"), F.col("name")).alias("nickname"),
        grantable_role(F.col("role")).alias("role"),
        F.lit(NEW_POSITION).alias("position"),
        F.lit(NEW_STATUS).alias("status"),
    )


def change_members(members: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Members after changes: member_id (once), action (suspend, activate, delete or profile), new_nickname, new_profile_key, new_position. A blank nickname and null fields change nothing."""
    rows = members.join(changes, "member_id", "left")
    action = F.coalesce("action", F.lit(""))
    of_profile = lambda c, new: F.when(action == "profile", F.coalesce(new, F.col(c))).otherwise(F.col(c))
    values = {
        "status": F.when(action == "suspend", "SUSPENDED").when(action == "activate", "ACTIVE").when(action == "delete", "DELETED").otherwise(F.col("status")),
        "deleted_at": F.when(action == "delete", now).otherwise(F.col("deleted_at")),
        "nickname": of_profile("nickname", if_blank(F.col("new_nickname"), F.lit(None))),
        "profile_key": of_profile("profile_key", F.col("new_profile_key")),
        "position": of_profile("position", F.col("new_position")),
    }
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in members.columns))


def resolve_projects(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """requests (public_id) with project_id; null where there is no such project."""
    return requests.join(projects.select("public_id", "project_id"), "public_id", "left")
