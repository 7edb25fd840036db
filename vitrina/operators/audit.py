"""Ingest, sampling and data-quality audits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.quantiles import quantiles
from vitrina.functions.retail import age_bin_cut, by_shuffle, last_days
from vitrina.operators import explore
from vitrina.sources.scratch import drop, kept

# Shares of the activity strata of a sample.
STRATA = {1: 0.40, 2: 0.35, 3: 0.175}


def customer_mapping(ids: DataFrame, column: str = "customer_id") -> DataFrame:
    """Dense numbers from 0 in the order of the distinct ids.  Ids are dealt to ranges of near-equal counts,
    whatever they look like, numbered within, and offset by the counts before: no task holds more
    than a range, and what is broadcast is a row for each range."""
    spread = ids.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    ranges = kept(spread.withColumn("_b", F.spark_partition_id()), "ids")
    counts, before, offsets = ranges.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).orderBy("_b").collect(), 0, []  # a row a range
    for r in counts:
        offsets.append((r["_b"], before))
        before += r["n"]
    numbered = ranges.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(column)))
    return numbered.join(F.broadcast(ids.sparkSession.createDataFrame(offsets, "_b int, _before long")), "_b").select(column, (F.col("_before") + F.col("_r") - 1).cast("int").alias("customer_idx"))


def prepared_customers(customers: DataFrame) -> DataFrame:
    """Missing ages become the median, memberships NONE; ``age_bin`` right-closed."""
    rows = customers.crossJoin(F.broadcast(quantiles(customers, "age", {"_m": 0.5}, counted=True)))  # one row
    age = F.coalesce(F.col("age").cast("double"), F.col("_m"))
    filled = [F.coalesce(c, F.lit("NONE")).alias(c) for c in ("club_member_status", "fashion_news_frequency")]
    return rows.withColumn("_age", age).select("customer_idx", "customer_id", F.col("_age").alias("age"), *filled, age_bin_cut(F.col("_age")).alias("age_bin"))


def stratified_sample(tx: DataFrame, n_customers: int, days: int, seed: int = 42) -> DataFrame:
    """``(customer_idx, purchases, stratum)``: customers of at least two recent purchases, drawn by stratum
    (2, 3-4, 5-6, 7 and more) in the order of a portable pseudo-random number."""
    n = last_days(tx, days).groupBy("customer_idx").agg(F.count(F.lit(1)).alias("purchases")).where("purchases >= 2")
    rows = n.withColumn("stratum", F.when(F.col("purchases") == 2, 1).when(F.col("purchases") <= 4, 2).when(F.col("purchases") <= 6, 3).otherwise(4))
    order = F.pmod(F.pmod(F.col("customer_idx").cast("bigint") * 7919 + F.lit(seed * 15485863), F.lit(2147483647)) * 48271, F.lit(2147483647))
    size = {k: int(n_customers * v) for k, v in STRATA.items()}
    size[4] = n_customers - sum(size.values())
    # Each task keeps the first of its rows only, and those are merged: no sort of all customers.
    return reduce(DataFrame.unionByName, [rows.where(F.col("stratum") == k).orderBy(order, "customer_idx").limit(size[k]) for k in sorted(size)])


def sample_tables(sample: DataFrame, tx: DataFrame, customers: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """The tables of a sample, without orphans."""
    own = tx.join(sample.select("customer_idx"), "customer_idx", "left_semi")
    return {"transactions": own, "customers": customers.join(sample.select("customer_idx"), "customer_idx", "left_semi"), "articles": articles.join(own.select("article_id").distinct(), "article_id", "left_semi")}


def narrow_types(df: DataFrame) -> DataFrame:
    """D3: ``(column, low, high, type)``: the narrowest integer type each integer column fits (a report: types of
    tables are fixed by their schemas)."""
    whole = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    cells = [F.struct(F.lit(c).alias("column"), F.min(c).cast("bigint").alias("low"), F.max(c).cast("bigint").alias("high")) for c in whole]
    x = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    fits = lambda bits: (F.col("low") >= -(1 << (bits - 1))) & (F.col("high") < (1 << (bits - 1)))
    return x.withColumn("type", F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint"))


def quality(tx: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """``(check, value)``, values that should be 0 but for ``rows`` and ``days``."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    checks = {
        "rows": F.count(F.lit(1)), "days": F.count_distinct("t_dat"), "null_dates": bad(F.col("t_dat").isNull()), "null_customers": bad(F.col("customer_idx").isNull()),
        "null_articles": bad(F.col("article_id").isNull()), "prices_not_positive": bad(F.col("price") <= 0), "unknown_channels": bad(~F.col("sales_channel_id").isin(1, 2)),
    }
    one = tx.agg(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value")) for k, v in checks.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    orphan = lambda other, key, name: tx.join(by_shuffle(other.select(key)), key, "left_anti").agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("value"))
    dup = customers.agg(F.lit("repeated_customers").alias("check"), (F.count(F.lit(1)) - F.count_distinct("customer_idx")).alias("value"))
    ages = customers.agg(F.lit("ages_out_of_range").alias("check"), bad(~F.col("age").between(16, 100)).alias("value"))
    return reduce(DataFrame.unionByName, [one, orphan(customers, "customer_idx", "orphan_customers"), orphan(articles, "article_id", "orphan_articles"), dup, ages])


def statistics(tx: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """``(measure, value)``: the statistics of the data set in one table: sparsity, repurchase lags, power law,
    Gini indexes, channels and cohorts."""

    def rows(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Each number of a summary as a row, named by the summary, its key and its column."""
        key = [F.lit(name)] if by is None else [F.lit(name), F.col(by).cast("string")]
        cells = [F.struct(F.concat_ws(".", *key, F.lit(c)).alias("measure"), F.col(c).cast("double").alias("value")) for c, t in df.dtypes if c != by and t != "string"]
        return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")

    return reduce(DataFrame.unionByName, [
        rows(explore.sparsity(tx), "sparsity"), rows(explore.lag_cdf(tx, by=("customer_idx",)), "lag", "day"), rows(explore.power_law(tx), "power_law"),
        rows(explore.gini(tx, articles), "gini"), rows(explore.channel_mix(tx, customers), "channel", "age_bin"), rows(explore.demographics(customers), "cohort", "age_bin"),
    ])


def catalog(articles: DataFrame, files: DataFrame, attributes: list[str], key: str = "article_id") -> DataFrame:
    """``(attribute, values, nulls, null_share, files, coverage)``: distinct values and nulls of each attribute, and how many
    articles have a file in ``files(article_id)``."""
    marked = articles.join(by_shuffle(files.select(key).distinct().withColumn("_f", F.lit(1))), key, "left")
    cells = [F.struct(F.lit(c).alias("attribute"), F.count_distinct(c).alias("values"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.col(c).isNull().cast("double")).alias("null_share"), F.count("_f").alias("files"), F.avg(F.col("_f").isNotNull().cast("double")).alias("coverage")) for c in attributes]
    return marked.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def lookup(articles: DataFrame, codes: list[int], files: DataFrame | None = None, key: str = "article_id") -> DataFrame:
    """The rows of some articles, missing ones with nulls, and whether each has a file."""
    wanted = articles.sparkSession.createDataFrame([(c,) for c in codes], f"{key} int")
    out = F.broadcast(wanted).join(articles, key, "left")
    if files is None:
        return out
    return out.join(by_shuffle(files.select(key).distinct().withColumn("has_file", F.lit(True))), key, "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, with their share."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_t")).alias("share"))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls, share)``."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.col(c).isNull().cast("double")).alias("share")) for c in df.columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mean, std, low, high)``."""
    cells = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")) for c in columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def frontier(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Places of the rows that no other is as high as in every column and higher in one.  In the order of their sums a
    row is beaten by rows before it only, so blocks are held against what is left so far and against themselves."""
    order = np.lexsort((*x.T, -x.sum(1)))
    x, kept_ = x[order], np.zeros(0, np.int64)
    for a in range(0, len(x), block):
        own = np.arange(a, min(a + block, len(x)))
        for by in (*(kept_[i : i + block] for i in range(0, len(kept_), block)), own):
            if len(own):
                lo, hi = x[own][:, None], x[by][None]
                own = own[~((hi >= lo).all(2) & (hi > lo).any(2)).any(1)]
        kept_ = np.r_[kept_, own]
    return order[kept_]


def pareto(results: DataFrame, up: list[str], down: list[str], key: str, most: int = 10_000) -> DataFrame:
    """Rows that no other row is as good as in everything and better in something (rows with a null objective are not compared and
    stay).  Each partition is reduced to its own frontier, and the frontiers are merged four to a task again and again; once
    ``most`` rows are left they are held against each other at once.  A frontier that stays larger is held against itself
    in blocks of ``most`` rows."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*up, *down]])

    def local(batches):
        held, signs = None, np.array([1.0] * len(up) + [-1.0] * len(down))
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = both.iloc[np.sort(frontier(both[[*up, *down]].to_numpy(float) * signs))]
        if held is not None:
            yield held

    def beaten(rows: DataFrame, by: DataFrame) -> DataFrame:
        other = F.broadcast(by.select(*[F.col(c).alias(f"_{c}") for c in [key, *up, *down]]))  # at most about ``most`` rows
        no_worse = [F.col(f"_{c}") >= F.col(c) for c in up] + [F.col(f"_{c}") <= F.col(c) for c in down]
        better = [F.col(f"_{c}") > F.col(c) for c in up] + [F.col(f"_{c}") < F.col(c) for c in down]
        return rows.join(other, reduce(lambda a, b: a & b, no_worse) & reduce(lambda a, b: a | b, better), "left_anti")

    if results.count() <= most:
        return beaten(results, results)
    alive = kept(results.where(whole).mapInPandas(local, results.schema), "frontier")
    n, parts = alive.count(), alive.rdd.getNumPartitions()
    while n > most and parts > 1:
        parts = -(-parts // 4)
        merged = kept(alive.repartition(parts).mapInPandas(local, results.schema), "frontier")
        drop(alive)
        alive, before, n = merged, n, merged.count()
        if n > 0.9 * before:  # that is the frontier, more or less
            break
    out, blocks = alive, -(-n // most)
    for k in range(blocks):
        out = beaten(out, alive.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k))
    return out.unionByName(results.where(~whole))


def archetypes(users: DataFrame) -> DataFrame:
    """L4: one customer each: loyal (most purchases among the recent), explorer (most items in the dearest half of
    activity), cold (fewest purchases, longest away)."""
    pick = lambda name, rows, *order: rows.orderBy(*order, F.asc("customer_idx")).limit(1).select(F.lit(name).alias("archetype"), "customer_idx")
    loyal = pick("loyal", users.where((F.col("u_last_purchase_days_ago") <= 30) & (F.col("u_total_transactions") >= 4)), F.desc("u_total_transactions"))
    explorer = pick("explorer", users.where((F.col("u_unique_articles") == F.col("u_total_transactions")) & (F.col("u_total_transactions") >= 3)), F.desc("u_unique_articles"))
    cold = pick("cold", users.where(F.col("u_total_transactions") <= 1), F.desc("u_last_purchase_days_ago"))
    return loyal.unionByName(explorer).unionByName(cold)
