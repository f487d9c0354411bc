"""Joins that hold up when one key, or no key at all, has a great share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOTH, OLD_ONLY, NEW_ONLY = "both", "old_only", "new_only"


def presence_join(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both sides by key, with ``presence`` saying where a key occurs.

    Apart from the keys the two frames must not share column names. Adaptive
    execution can split a crowded key of an inner or an anti join but not of a
    full outer join, so the one is written as three of the others. The key sets
    that the anti joins look at are made distinct before they are shuffled.
    Null keys match nothing.
    """
    old_columns = [c for c in old.columns if c not in keys]
    new_columns = [c for c in new.columns if c not in keys]
    types = {**dict(new.dtypes), **dict(old.dtypes)}

    def shaped(df: DataFrame, presence: str) -> DataFrame:
        return df.select(
            *keys,
            *[
                F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                for c in (*old_columns, *new_columns)
            ],
            F.lit(presence).alias("presence"),
        )

    on = list(keys)
    both = old.join(new, on, "inner")
    only_old = old.join(new.select(*on).distinct(), on, "left_anti")
    only_new = new.join(old.select(*on).distinct(), on, "left_anti")
    return (
        shaped(both, BOTH)
        .unionByName(shaped(only_old, OLD_ONLY))
        .unionByName(shaped(only_new, NEW_ONLY))
    )


def lookup_join(df: DataFrame, lookups: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """Left join on the keys to each lookup in turn, with rows of a null key spread out.

    Such rows match nothing, yet a left join gathers them all in one task. An
    extra key, 0 on every row that can match, scatters them by their other values.
    """
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    spread = F.when(keyless, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).otherwise(F.lit(0).cast("long"))
    rows = df.withColumn("null_spread", spread)
    for lookup in lookups:
        right = lookup.withColumn("null_spread", F.lit(0).cast("long"))
        rows = rows.join(right, [*keys, "null_spread"], "left")
    return rows.drop("null_spread")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by the order; null keys are a key like any other.

    Spark keeps the first row of each key in every task before the shuffle, so a busy key
    never fills a task. Rows that are equal in the whole order are interchangeable.
    """
    place = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def repeated(df: DataFrame, times: str, at_once: int = 1 << 16) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column.

    Copies are dealt out in blocks of ``at_once``, so no array grows with the count.
    """
    n = F.col(times)
    blocks = F.expr(f"sequence(0L, ({times} - 1) div {at_once})")
    df = df.where(n > 0).withColumn("__block", F.explode(blocks))
    inside = F.least(F.lit(at_once).cast("long"), n - F.col("__block") * at_once)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), inside))).drop(times, "__block", "__copy")


def few_valued_join(df: DataFrame, lookup: DataFrame, keys: tuple[str, ...], salts: int = 32) -> DataFrame:
    """Left join to a lookup whose key takes few values, each of which may fill a task.

    Each row draws one of ``salts`` numbers by a hash of its values, and the lookup holds its
    rows once for each number, so any one key, or no key, is dealt out over that many tasks.
    A lookup that Spark finds small enough is broadcast as ever.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", salt).join(copies, [*keys, "__salt"], "left").drop("__salt")
