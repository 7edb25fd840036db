"""Temporal splits, leakage checks, ground truth and the ranker's training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.retail import aged, between
from vitrina.operators.recall import PAIRS, dealt


@dataclass(frozen=True)
class Split:
    train: DataFrame
    validation: DataFrame


def temporal(tx: DataFrame, val_days: int = 7, history_days: int | None = None, ref_date: str | None = None) -> Split:
    """TS1: validation is the last ``val_days`` days, training what is before (``history_days`` of it)."""
    rows = aged(tx, ref_date)
    before = F.col("t_dat") <= F.date_sub("ref_date", val_days)
    train = rows.where(before if history_days is None else between(val_days, val_days + history_days))
    return Split(train.select(*undated(tx)), rows.where(between(0, val_days)).select(*undated(tx)))


def undated(tx: DataFrame) -> list[str]:
    """The columns of ``tx`` but for the ages, which are those of another reference day."""
    return [c for c in tx.columns if c not in ("ref_date", "days_ago")]


def rolling(tx: DataFrame, val_days: int = 7, history_days: int = 35) -> dict[str, DataFrame]:
    """TS2: features and targets of training, one validation window earlier, and of evaluation."""
    rows, keep = aged(tx), undated(tx)
    window = lambda a, b: rows.where(between(a, b)).select(*keep)
    return {
        "val_target": window(0, val_days),
        "val_features": window(val_days, val_days + history_days),
        "train_target": window(val_days, 2 * val_days),
        "train_features": window(2 * val_days, 2 * val_days + history_days),
    }


def leakage(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """TS3: one row: the last day before, the first day after, and rows before that aren't before it."""
    first = later.agg(F.min("t_dat").alias("min_later"))
    return earlier.crossJoin(F.broadcast(first)).agg(F.max("t_dat").alias("max_earlier"), F.first("min_later").alias("min_later"), F.count_if(F.col("t_dat") >= F.col("min_later")).alias("leaks"))


def require_no_leakage(earlier: DataFrame, later: DataFrame) -> None:
    found = leakage(earlier, later).first()
    if found["leaks"]:
        raise ValueError(f"{found['leaks']} rows are not before {found['min_later']}")


def ground_truth(validation: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """TS4: ``(customer_idx, items)``, distinct items in order; with ``users`` all of those, empty lists too."""
    own = validation.groupBy("customer_idx").agg(F.array_sort(F.collect_set("article_id")).alias("items"))
    if users is None:
        return own
    return users.select("customer_idx").distinct().join(own, "customer_idx", "left").withColumn("items", F.coalesce("items", F.array().cast("array<int>")))


def label(pairs: DataFrame, validation: DataFrame, count: int | None = None) -> DataFrame:
    """``pairs`` with ``target``: 1 if bought in the validation window.  A customer's purchases go to their pairs; with the ``count`` of the
    pairs both are dealt by customer to as many tasks as it asks for (of one side only, Spark would take the number of the other)."""
    if count is not None:
        pairs, validation = (dealt(side, count, PAIRS, "customer_idx") for side in (pairs, validation))
    bought = ground_truth(validation).withColumnRenamed("items", "_bought")
    found = F.coalesce(F.array_contains("_bought", F.col("article_id")), F.lit(False)).cast("int")
    return pairs.join(bought, "customer_idx", "left").withColumn("target", found).drop("_bought")


def shuffled(seed: int):
    """A portable pseudo-random order of pairs: a linear congruence of both keys."""
    mixed = F.col("customer_idx").cast("bigint") * 7919 + F.col("article_id").cast("bigint") * 104729 + F.lit(seed * 15485863)
    return F.pmod(F.pmod(mixed, F.lit(2147483647)) * 48271, F.lit(2147483647))


def training_rows(labelled: DataFrame, ratio: int | None = 5, drop_empty: bool = True, seed: int = 42) -> DataFrame:
    """TS5: all positives and at most ``ratio`` negatives for each of them, by user (users without positives are
    dropped, or count as having one)."""
    rows = labelled.where("customer_idx is not null").withColumn("n_pos", F.sum("target").over(Window.partitionBy("customer_idx")))
    rows = rows.where("n_pos > 0") if drop_empty else rows
    if ratio is None:
        return rows.drop("n_pos")
    w = Window.partitionBy("customer_idx", "target").orderBy(shuffled(seed), F.asc("article_id"))
    room = F.greatest(F.col("n_pos"), F.lit(1)) * ratio
    return rows.withColumn("_r", F.row_number().over(w)).where((F.col("target") == 1) | (F.col("_r") <= room)).drop("n_pos", "_r")
