"""Login sessions and their users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that end after ``now``; without an end they are not valid."""
    return sessions.filter(F.col("expires_at") > now)


def cleaned(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions without those that have ended by ``now``."""
    return sessions.filter(~F.coalesce(F.col("expires_at") <= now, F.lit(False)))


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """(id, username) of the sessions whose user is there."""
    return sessions.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select("id", "username")


def guard(users: DataFrame) -> DataFrame:
    """(users, may_register): only the first user may register."""
    return users.agg(F.count(F.lit(1)).alias("users")).withColumn("may_register", F.col("users") == 0)


def connections(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """(total, authenticated): all open connections, and those of a known user."""
    known = users.select(F.col("id").alias("user_id"), F.lit(1).alias("known"))
    return sessions.join(known, "user_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("known").alias("authenticated"))
