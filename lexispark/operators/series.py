"""Daily series: dates, gaps, rolling features, extremes, grids and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexispark.plans.blocked import neighbours, running_sum


def year_block(date: str) -> Column:
    return F.year(date)


def date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.select(
        "*",
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day_of_month"),
        F.dayofyear(date).alias("day_of_year"),
    )


def clean_number(c: Column) -> Column:
    """Numbers with stray marks behind them; anything else (`-`, `x`, `####`, blanks) counts as 0."""
    bare = F.regexp_replace(F.trim(c), r"[*.]+$", "")
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def fill_gaps(df: DataFrame, series: str, date: str = "date", value: str = "y") -> DataFrame:
    """One row per day between the first and last day of a series; missing days repeat the last value.

    Each day is stretched to the day before its successor, so no calendar is
    joined and no value is searched for backwards. Repeated days count once.
    """
    daily = df.groupBy(series, date).agg(F.max(value).alias(value))
    nxt = neighbours(daily, [series], [date], year_block(date), {"__next": (date, -1)})
    days = F.sequence(date, F.coalesce(F.date_sub("__next", 1), F.col(date)))
    return (
        nxt.withColumn("__day", F.explode(days))
        .select(series, F.col("__day").alias(date), value, (F.col("__day") != F.col(date)).cast("int").alias("filled"))
    )


def roll(
    df: DataFrame,
    series: str,
    look_back: int,
    horizon: int,
    features: list[str],
    target: str = "y",
    date: str = "date",
    impute: bool = False,
) -> DataFrame:
    """Past values ``<name>_m<k>`` of features and target, future values ``<target>_p<k>``."""
    back = {f"{c}_m{k}": (c, k) for c in [*features, target] for k in range(look_back - 1, 0, -1)}
    ahead = {f"{target}_p{k}": (target, -k) for k in range(1, horizon + 1)}
    out = neighbours(df, [series], [date], year_block(date), {**back, **ahead})
    return out.fillna(0, subset=list(back)) if impute else out


def extreme_by_rank(df: DataFrame, series: str, value: str, share: float = 0.9, bucket: float = 1000.0) -> DataFrame:
    """Add ``pct_rank`` (average rank of ties over the count) and ``extreme``.

    Ranks come from the histogram of values, so rows of one series are never sorted together.
    A null value has no rank; a null series is one series.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(series, value).agg(F.count("*").alias("c"))
    below = running_sum(counts, [series], [value], F.floor(F.col(value) / bucket), F.col("c"), "below", inclusive=False)
    total = known.groupBy(F.col(series).alias("__of")).agg(F.count("*").alias("n"))
    ranks = below.join(total, F.col(series).eqNullSafe(F.col("__of"))).select(
        "__of", F.col(value).alias("__value"), ((F.col("below") + (F.col("c") + 1) / 2) / F.col("n")).alias("pct_rank")
    )
    same = F.col(series).eqNullSafe(F.col("__of")) & (F.col(value) == F.col("__value"))
    return df.join(ranks, same, "left").drop("__of", "__value").withColumn(
        "extreme", (F.col("pct_rank") >= share).cast("int")
    )


def extreme_by_threshold(value: Column, limit: float = 50.0) -> Column:
    return F.when(value >= limit, 1).otherwise(0)


def grid_cell(lat: Column, lon: Column, step: float = 2.5) -> tuple[Column, Column]:
    """Row and column of a world grid that starts at the north pole and longitude 0."""
    return F.floor((F.lit(90) - lat) / step), F.floor(lon / step)


def grid_variables(df: DataFrame, levels: list[int], variables: list[str]) -> DataFrame:
    """Long grid records to one row per date and cell, one column per variable."""
    return (
        df.filter(F.col("level").isin(levels))
        .groupBy("date", "lat_id", "lon_id")
        .agg(*[F.sum(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])
    )


def scale_stats(df: DataFrame, series: str, columns: list[str]) -> DataFrame:
    return df.groupBy(series).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}__std") for c in columns]
    )


def standard_scale(df: DataFrame, stats: DataFrame, series: str, columns: list[str], with_mean: bool) -> DataFrame:
    """``<c>_scaled``; statistics come from ``scale_stats`` of the training rows. A series without them scales to null."""
    out = _with_stats(df, stats, series)
    for c in columns:
        shifted = F.col(c) - F.col(f"{c}__mean") if with_mean else F.col(c)
        out = out.withColumn(f"{c}_scaled", F.try_divide(shifted, F.col(f"{c}__std")))
    return out.drop(*[f"{c}__mean" for c in columns], *[f"{c}__std" for c in columns])


def unscale(df: DataFrame, stats: DataFrame, series: str, scaled: str, column: str, name: str) -> DataFrame:
    back = F.col(scaled) * F.col(f"{column}__std") + F.col(f"{column}__mean")
    return _with_stats(df, stats, series).withColumn(name, back).drop(f"{column}__mean", f"{column}__std")


def _with_stats(df: DataFrame, stats: DataFrame, series: str) -> DataFrame:
    other = stats.withColumnRenamed(series, "__of")
    return df.join(other, F.col(series).eqNullSafe(F.col("__of")), "left").drop("__of")


# Residue letters, ids 1 to 20.
RESIDUES = "AVLIMFWPGDEKRHSTNQYC"


def residue_ids(sequence: Column, size: int) -> Column:
    """Letters to ids (0 when unknown), zero-filled at the front, cut at the end."""
    letters = F.filter(F.split(sequence, ""), lambda ch: ch != "")
    ids = F.transform(letters, lambda ch: F.position(ch, F.lit(RESIDUES)))
    kept = F.slice(ids, 1, size)
    return F.concat(F.array_repeat(F.lit(0), F.lit(size) - F.size(kept)), kept)
