"""Column functions of the retail domain: cohorts, item codes, decays, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The age cohorts.
AGE_LABELS = ["<25", "25-34", "35-44", "45-54", "55+"]
GLOBAL = "GLOBAL"


def age_bin_cut(age: Column) -> Column:
    """Right-closed bins at 25, 35, 45, 55 (25 is ``<25``), as on ingest; null stays null."""
    out = F.when(age.isNull(), None)
    for edge, label in zip((25, 35, 45, 55), AGE_LABELS, strict=False):
        out = out.when(age <= edge, label)
    return out.otherwise(AGE_LABELS[-1])


def age_bin_case(age: Column) -> Column:
    """Left-closed bins (25 is ``25-34``), as in the cascades; null is ``GLOBAL``."""
    return F.when(age < 25, "<25").when(age <= 34, "25-34").when(age <= 44, "35-44").when(age <= 54, "45-54").when(age.isNotNull(), "55+").otherwise(GLOBAL)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, which grows with the tables, as a side of a join.  Spark would broadcast it for the size of its compressed files: an
    estimate below 10 MB may be millions of rows, hundreds of MB in the driver."""
    return df.hint("merge")


def item_code(article: Column) -> Column:
    """The 10-digit code of an article."""
    return F.lpad(article.cast("string"), 10, "0")


def exp_decay(rate: float, age: Column) -> Column:
    return F.exp(F.lit(-rate) * age)


def pow_decay(base: float, age: Column) -> Column:
    return F.pow(F.lit(base), age)


def aged(tx: DataFrame, ref_date: str | None = None) -> DataFrame:
    """Add ``ref_date`` (given, or the last day of ``tx``) and ``days_ago``; rows that have both keep them
    unless another day is given."""
    if ref_date is not None:
        out = tx.withColumn("ref_date", F.lit(ref_date).cast("date"))
    elif {"ref_date", "days_ago"} <= set(tx.columns):
        return tx
    else:
        out = tx.crossJoin(F.broadcast(tx.agg(F.max("t_dat").alias("ref_date"))))  # one row
    return out.withColumn("days_ago", F.datediff("ref_date", "t_dat"))


def between(first: int, end: int) -> Column:
    """Days ``first`` to ``end`` (exclusive) before the reference day, as bounds of ``t_dat``: where the reference
    day is a constant they reach the scan."""
    return (F.col("t_dat") > F.date_sub("ref_date", end)) & (F.col("t_dat") <= F.date_sub("ref_date", first))


def last_days(tx: DataFrame, days: int, ref_date: str | None = None) -> DataFrame:
    """Rows of the last ``days`` days, the reference day included; with ``days_ago``."""
    return aged(tx, ref_date).where(between(0, days))
