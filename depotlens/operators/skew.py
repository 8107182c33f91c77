"""Helpers that keep a hot key from landing whole in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is heavy when it holds at least 1/HEAVY_SHARE of all rows, so there are never
# more than HEAVY_SHARE heavy keys: small enough to broadcast at any data size.
HEAVY_SHARE = 1000


def mark_repeated_keys(df: DataFrame, key: str, row_id: str, flag: str) -> DataFrame:
    """Add ``flag``: does another row share this row's ``key``? Rows without a key get FALSE.

    Keys are counted with a map-side combine. Heavy keys are flagged through a
    broadcast of at most HEAVY_SHARE keys; in the shuffled join that serves the rest,
    rows of heavy keys and rows without a key get a private key, so they spread evenly.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where("_n > 1")
    total = counts.agg(F.sum("_n")).scalar()
    heavy = repeated.where(F.col("_n") * HEAVY_SHARE >= total).select(key, F.lit(True).alias("_heavy"))
    private = F.concat(F.lit("\u0000row:"), F.col(row_id).cast("string"))
    spread = F.when(F.col("_heavy") | F.col(key).isNull(), private).otherwise(F.col(key))
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn("_spread", spread)
        .join(repeated.select(F.col(key).alias("_spread"), F.lit(True).alias("_repeated")), "_spread", "left")
        .withColumn(flag, F.coalesce("_heavy", "_repeated", F.lit(False)))
        .drop("_spread", "_heavy", "_repeated")
    )


def looked_up(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``df`` with the columns of ``values``, which has one row per ``key`` at most; NULL where there is none.

    Rows of heavy keys meet their values through a broadcast of at most HEAVY_SHARE rows; rows of other keys are joined
    by key, and so are rows without one or with a heavy one, under a hash of the whole row that no key has.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    heavy = counts.where((F.col("_n") > 1) & (F.col("_n") * HEAVY_SHARE >= total)).select(key)
    names = [c for c in values.columns if c != key]
    hot = heavy.join(values, key, "left").select(key, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    spread = F.when(F.col("_heavy") | F.col(key).isNull(), F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string"))).otherwise(F.col(key).cast("string"))
    cold = values.select(F.col(key).cast("string").alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    joined = df.join(F.broadcast(hot), key, "left").withColumn("_spread", spread).join(cold, "_spread", "left")
    return joined.select(*df.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in names])


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row ``(n)``: child rows whose non-NULL key has no parent.

    Children are counted per key before the anti join, so a hot key moves as one row.
    """
    per_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    missing = per_key.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n"))


def repeated_key_count(df: DataFrame, key: str) -> DataFrame:
    """One row ``(n)``: key values (NULL included) that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("n"))
