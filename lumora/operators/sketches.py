"""Sketches that are stored by period and merged over any range, so that no row is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.tables import dropped, written


def sketched(df: DataFrame, by: list[str | Column], distinct: str, value: str, *, lg: int = 12, k: int = 200) -> DataFrame:
    """by, n, hll, theta, kll: rows, two sketches of the distinct values of a column and one of a number's distribution.

    HLL holds 2**lg registers, with an error of about 1.04 / sqrt(2**lg); theta holds 2**lg hashes, so it counts
    up to as many values exactly and can be intersected; KLL answers ranks within about 1.7 / k**0.9.
    Nulls are left out of the sketches and counted in n.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, lg).alias("hll"), F.theta_sketch_agg(distinct, lg).alias("theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("kll"),
    )


def merged(sketches: DataFrame, by: list[str], *, lg: int = 12, k: int = 200) -> DataFrame:
    """sketched() of larger groups from those of smaller ones: sketches are merged before the shuffle, rows are not needed."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("hll", True).alias("hll"), F.theta_union_agg("theta", lg).alias("theta"), F.kll_merge_agg_double("kll", F.lit(k)).alias("kll")
    )


def estimates(sketches: DataFrame, shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The sketches' answers in their place: distinct_hll, distinct_theta, quantiles."""
    rest = [c for c in sketches.columns if c not in ("hll", "theta", "kll")]
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(x)) for x in shares])
    return sketches.select(*rest, F.hll_sketch_estimate("hll").alias("distinct_hll"), F.theta_sketch_estimate("theta").alias("distinct_theta"), quantiles.alias("quantiles"))


def parted(df: DataFrame, by: list[str], distinct: str, *, lg: int = 12) -> DataFrame:
    """by, part, theta: the distinct values of a column dealt to parts by their hash, a theta sketch for each, so that counts() is exact.

    There are as many parts as leave none with over 2**lg values in the whole table, so no union of a part's sketches holds more
    and all of them count exactly. That is seen from the sketches; until it holds the parts are doubled. The table is written.
    """
    rows = df.where(F.col(distinct).isNotNull()).select(*by, F.col(distinct).alias("_value"))
    parts = 1 + (rows.agg(F.approx_count_distinct("_value", 0.05)).first()[0] >> (lg - 1))
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("_value"), F.lit(parts)))
        made = written(dealt.groupBy(*by, "part").agg(F.theta_sketch_agg("_value", lg).alias("theta")), "theta")
        whole = made.groupBy("part").agg(F.theta_sketch_estimate(F.theta_union_agg("theta", lg)).alias("n"))
        if (whole.agg(F.max("n")).first()[0] or 0) <= 1 << lg:  # an estimate of more than 2**lg is the only inexact one
            return made
        dropped(made)
        parts *= 2


def counts(parts: DataFrame, by: list[str], *, lg: int = 12) -> DataFrame:
    """by, distinct_values of larger groups from parted() ones of smaller groups, exactly; a group without values has no row."""
    found = parts.groupBy(*by, "part").agg(F.theta_sketch_estimate(F.theta_union_agg("theta", lg)).alias("_n"))
    return found.groupBy(*by).agg(F.sum("_n").alias("distinct_values"))


def common(a: Column, b: Column) -> Column:
    """About how many distinct values two theta sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
