"""Member profiles: names, roles, placeholder addresses and provider attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

#: The name of a member without one, the domain of placeholder addresses, and by provider the JSON path of each profile field.
NO_NAME, PLACEHOLDER = "사용자", "@oauth.placeholder"
PROFILE_PATHS = {
    "GOOGLE": {"id": "$.sub", "name": "$.name", "nickname": "$.name", "email": "$.email", "image_url": "$.picture"},
    "GITHUB": {"id": "$.id", "name": "$.name", "nickname": "$.login", "email": "$.email", "image_url": "$.avatar_url"},
}
EMAILS_SCHEMA = "array<struct<email:string,primary:boolean,verified:boolean>>"


def if_blank(c: Column, other: Column) -> Column:
    return F.when(is_blank(c), other).otherwise(c)


def display_name(name: Column) -> Column:
    return if_blank(name, F.lit(NO_NAME))


def display_nickname(nickname: Column, name: Column) -> Column:
    return if_blank(nickname, display_name(name))


def grantable_role(c: Column) -> Column:
    """CEO or EMPLOYEE; anything else, ADMIN included: EMPLOYEE."""
    return F.when(F.upper(c).isin("CEO", "EMPLOYEE"), F.upper(c)).otherwise("EMPLOYEE")


def email_or_placeholder(email: Column, provider: Column, provider_id: Column) -> Column:
    return if_blank(email, F.concat(F.lower(provider), F.lit("_"), provider_id, F.lit(PLACEHOLDER)))


def is_placeholder(email: Column) -> Column:
    return F.coalesce(F.endswith(email, F.lit(PLACEHOLDER)), F.lit(False))


def primary_email(emails: Column) -> Column:
    """Of an array of (email, primary, verified): the first that is primary and verified, else the first verified, else null."""
    both = F.filter(emails, lambda e: e["primary"] & e["verified"])
    verified = F.filter(emails, lambda e: e["verified"])
    return F.coalesce(F.try_element_at(both, F.lit(1))["email"], F.try_element_at(verified, F.lit(1))["email"])


def primary_email_of_json(c: Column) -> Column:
    return primary_email(F.from_json(c, EMAILS_SCHEMA))


def profile_field(provider: Column, attributes: Column, field: str) -> Column:
    """A field of a provider's profile, from its JSON attributes; a GitHub profile without a name is called by its login."""
    google, github = (F.get_json_object(attributes, PROFILE_PATHS[p][field]) for p in ("GOOGLE", "GITHUB"))
    if field == "name":
        github = if_blank(github, F.get_json_object(attributes, PROFILE_PATHS["GITHUB"]["nickname"]))
    name = F.upper(provider)
    return F.when(name == "GOOGLE", google).when(name == "GITHUB", github)


def profile(provider: Column, attributes: Column) -> Column:
    """struct(id, name, nickname, email, image_url)."""
    return F.struct(*(profile_field(provider, attributes, f).alias(f) for f in PROFILE_PATHS["GOOGLE"]))
