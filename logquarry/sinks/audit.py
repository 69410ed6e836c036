"""Append-only audit trail in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import fixed_values as V

AUDIT_SCHEMA = ("ts string, seq bigint, action string, user string, ip string,"
                " details map<string,string>")


def append_audit(entries: DataFrame, path: str) -> None:
    """Entries: ts, seq, action and, optionally, user, ip, details."""
    have = set(entries.columns)
    user = F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit("local")) if "user" in have else F.lit("local")
    (entries.select(
        "ts", "seq", "action", user.alias("user"),
        (F.nullif(F.col("ip"), F.lit("")) if "ip" in have else F.lit(None).cast("string")).alias("ip"),
        (F.col("details") if "details" in have
         else F.lit(None).cast("map<string,string>")).alias("details"))
     .write.mode("append").json(path))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_for(trail: DataFrame, user: str | None = None, limit: int = V.AUDIT_KEPT) -> DataFrame:
    """Newest entries first, `limit` of them; of one user when given."""
    own = trail if user is None else trail.filter(F.col("user") == user)
    return own.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
