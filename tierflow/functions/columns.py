"""Column to column functions: codes, personal fields, digests, money, time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def std_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def hash_id(c: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased value; null stays null."""
    return F.sha2(F.lower(F.trim(c)), 256)


def mask_tail(c: Column, keep: int = 4) -> Column:
    """Stars for all but the last characters; null stays null."""
    stars = F.expr("repeat('*', 1)") if keep < 0 else F.repeat(F.lit("*"), F.greatest(F.length(c) - keep, F.lit(0)))
    return F.when(c.isNotNull(), F.concat(stars, F.right(c, F.lit(keep))))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the values as text, null as a tilde, joined by two bars."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns; maps, which can't be hashed, as their JSON."""
    made = (F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields)
    return F.xxhash64(*made)


def to_base(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate.cast("decimal(18,6)"), 2).cast("decimal(18,2)")


def epoch_s(ts: Column) -> Column:
    """Whole seconds, rounded down, before 1970 too."""
    return ts.cast("timestamp").cast("long")


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and upper-case the named columns that df has; the order of columns stays."""
    return df.withColumns({c: std_code(F.col(c)) for c in columns if c in df.columns})


def protect(df: DataFrame, policy: Mapping[str, Sequence[str]]) -> DataFrame:
    """Hash, mask and drop personal fields; the originals go."""
    hashed, masked = policy.get("hash", ()), policy.get("mask", ())
    made = {f"{c}_hash": hash_id(F.col(c)) for c in hashed} | {f"{c}_masked": mask_tail(F.col(c)) for c in masked}
    return df.withColumns(made).drop(*hashed, *masked, *policy.get("drop", ()))


def convert(df: DataFrame, rates: Mapping[str, float], *, amount: str = "amount", currency: str = "currency", out: str = "amount_gbp") -> DataFrame:
    """Amount in the base currency; null for an unknown or null currency.

    The rates are a literal map of the plan (a handful of configured values): no join, no shuffle.
    """
    table = F.create_map(*(F.lit(x) for code, rate in rates.items() for x in (code, float(rate)))) if rates else F.create_map().cast("map<string,double>")
    rate = F.when(F.col(currency).isNotNull(), F.try_element_at(table, F.col(currency)))
    return df.withColumn(out, to_base(F.col(amount), rate))
