"""Accounts and e-mail addresses looked up without regard to case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A collation under which strings that differ in case are equal.
CASELESS = "UTF8_LCASE"


def caseless(accounts: DataFrame, *columns: str) -> DataFrame:
    """The columns under a collation without case."""
    return accounts.withColumns({c: F.collate(F.col(c), CASELESS) for c in columns})


def public_info(accounts: DataFrame, username: str) -> DataFrame:
    """The public columns of the account of that name in any case."""
    own = caseless(accounts, "username").where(F.col("username") == F.lit(username))
    return own.select(*[F.col(c).cast("string").alias(c) for c in ("username", "firstname", "lastname", "institution", "self_bio") if c in accounts.columns])


def email_addresses(accounts: DataFrame, emails: DataFrame, usernames: DataFrame) -> DataFrame:
    """(username, email, is_primary) for names (username) typed in any case; unknown names have no rows."""
    left = caseless(accounts.select("account_id", "username"), "username")
    right = caseless(usernames.select(F.col("username").alias("typed")).distinct(), "typed")
    found = left.join(right, F.col("username") == F.col("typed")).select("account_id", F.col("username").cast("string").alias("username")).distinct()
    return emails.join(found, "account_id").select("username", "email", "is_primary")


def put_email(emails: DataFrame, accounts: DataFrame, username: str, email: str, is_primary: bool = False) -> DataFrame:
    """``emails`` with an address of the account of that name added; an unknown name adds nothing."""
    own = caseless(accounts, "username").where(F.col("username") == F.lit(username)).select("account_id", F.lit(email).alias("email"), F.lit(is_primary).alias("is_primary"))
    return emails.select("account_id", "email", "is_primary").unionByName(own)


def delete_email(emails: DataFrame, accounts: DataFrame, username: str, email: str) -> DataFrame:
    """``emails`` without that address of the account of that name, both in any case."""
    own = caseless(accounts, "username").where(F.col("username") == F.lit(username)).select("account_id")
    gone = caseless(emails, "email").join(own, "account_id", "left_semi").where(F.col("email") == F.lit(email)).select("account_id", F.col("email").cast("string").alias("email"))
    return emails.join(gone.distinct(), ["account_id", "email"], "left_anti")
