"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, most: int = 1000) -> DataFrame:
    """Inner join on ``keys``. The rows ``right`` has of one key are spread by the hash of ``by`` over as many tasks as it
    takes for ``most`` rows each, and the rows of ``left`` with such a key go to all of them."""
    many = right.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).filter("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(many, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    b = right.join(many, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    return a.join(b, [*keys, "_salt"]).drop("_salt")
