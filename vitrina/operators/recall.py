"""Candidate recall R1-R8, their pool, and the popular fallback lists.

All return ``customer_idx, article_id, source, rank_in_source``.  Ranks break ties by
``article_id``; scores that are float sums are rounded before they are ranked, so the order
does not depend on the order of summation.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.retail import GLOBAL, age_bin_case, aged, by_shuffle, exp_decay, item_code

# Source names in the order of R1..R8.
SOURCES = ["R1_repurchase", "R2_popular_global", "R3_popular_age", "R4_popular_channel", "R5_itemcf", "R6_product_family", "R7_trending", "R8_user_dept_popularity"]
OUT = ["customer_idx", "article_id", "source", "rank_in_source"]
#: Customers whose candidates (a hundred each or so), and pairs that, a task holds at once.
USERS, PAIRS = 5_000, 400_000


def dealt(rows: DataFrame, count: int, most: int, *by: str) -> DataFrame:
    """``rows`` dealt by a key to tasks of about ``most`` of ``count``, so that what a task holds does not grow with the table."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(count / most)), *by)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank_in_source") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 (Spark limits groups before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_all(df: DataFrame, order: list[Column], k: int, name: str = "rank_in_source") -> DataFrame:
    """The first ``k`` rows of all, numbered from 1: the limit comes first, so only they are numbered."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def named(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).select(*OUT)


def repurchase(tx: DataFrame, top_k: int = 24) -> DataFrame:
    """A user's own items, latest first, then most bought."""
    own = tx.groupBy("customer_idx", "article_id").agg(F.max("t_dat").alias("last"), F.count(F.lit(1)).alias("n"))
    return named(top(own, ["customer_idx"], [F.desc("last"), F.desc("n"), F.asc("article_id")], top_k), SOURCES[0])


def popular_items(tx: DataFrame, rate: float, top_k: int, per_days: float = 7.0) -> DataFrame:
    scored = aged(tx).groupBy("article_id").agg(F.round(F.sum(exp_decay(rate, F.col("days_ago") / per_days)), 9).alias("score"))
    return top_all(scored, [F.desc("score"), F.asc("article_id")], top_k)


def to_all_users(items: DataFrame, tx: DataFrame, source: str) -> DataFrame:
    """Every user of ``tx`` with every one of at most a few dozen ranked items."""
    return named(tx.select("customer_idx").distinct().crossJoin(F.broadcast(items)), source)


def popular_global(tx: DataFrame, rate: float = 0.1, top_k: int = 20) -> DataFrame:
    """R2: exponentially decayed sales, in weeks."""
    return to_all_users(popular_items(tx, rate, top_k), tx, SOURCES[1])


def popular_age(tx: DataFrame, customers: DataFrame, top_k: int = 15) -> DataFrame:
    """Items of a user's age cohort (``age_bin`` of ``customers``), for all customers."""
    bins = customers.select("customer_idx", "age_bin")
    return named(bins.join(F.broadcast(age_items(tx, bins, top_k)), "age_bin"), SOURCES[2])  # top_k rows a cohort


def age_items(tx: DataFrame, bins: DataFrame, top_k: int) -> DataFrame:
    sold = tx.join(by_shuffle(bins), "customer_idx").where("age_bin is not null").groupBy("age_bin", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return top(sold, ["age_bin"], [F.desc("n"), F.asc("article_id")], top_k)


def modal(tx: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent ``value`` of each ``key`` (the smallest of equally frequent ones)."""
    n = tx.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(value))


def popular_channel(tx: DataFrame, top_k: int = 15) -> DataFrame:
    """Items of a user's main channel."""
    return named(modal(tx, "customer_idx", "sales_channel_id").join(F.broadcast(channel_items(tx, top_k)), "sales_channel_id"), SOURCES[3])  # top_k rows a channel


def channel_items(tx: DataFrame, top_k: int) -> DataFrame:
    sold = tx.groupBy("sales_channel_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return top(sold, ["sales_channel_id"], [F.desc("n"), F.asc("article_id")], top_k)


def item_cf(tx: DataFrame, window_days: int = 14, top_k: int = 20, per_user: int = 10, neighbours: int = 5, seeds: int = 3) -> DataFrame:
    """Items bought by the same users in the last ``window_days`` (both ends included; all
    of ``tx`` if that is empty).  The self-join is bounded by ``per_user`` rows a user."""
    near = aged(tx).where(F.col("days_ago") <= window_days)
    rows = top(near, ["customer_idx"], [F.desc("t_dat"), F.asc("article_id"), F.asc("price"), F.asc("sales_channel_id")], per_user, "pos")
    rows = rows.select("customer_idx", "article_id", "pos")
    other = rows.select("customer_idx", F.col("article_id").alias("other"))
    pairs = rows.join(other, "customer_idx").where("article_id != other").groupBy("article_id", "other").agg(F.count(F.lit(1)).alias("n"))
    pairs = top(pairs, ["article_id"], [F.desc("n"), F.asc("other")], neighbours, "r")
    scored = rows.where(F.col("pos") <= seeds).join(pairs.select("article_id", "other", "n"), "article_id").groupBy("customer_idx", F.col("other").alias("article_id")).agg(F.sum("n").alias("score"))
    return named(top(scored, ["customer_idx"], [F.desc("score"), F.asc("article_id")], top_k), SOURCES[4])


def product_family(tx: DataFrame, articles: DataFrame, top_k: int = 10, departments: int = 2) -> DataFrame:
    """Best items of a user's two main departments; ranks restart in each."""
    mine, best = family(tx, articles, top_k, departments)
    return named(mine.join(best, "department_no"), SOURCES[5])


def family(tx: DataFrame, articles: DataFrame, top_k: int, departments: int) -> tuple[DataFrame, DataFrame]:
    """The main departments of each user, and the best items of each department."""
    sold = tx.join(by_shuffle(articles.select("article_id", "department_no")), "article_id")
    best = top(sold.groupBy("department_no", "article_id").agg(F.count(F.lit(1)).alias("n")), ["department_no"], [F.desc("n"), F.asc("article_id")], top_k)
    mine = top(sold.groupBy("customer_idx", "department_no").agg(F.count(F.lit(1)).alias("n")), ["customer_idx"], [F.desc("n"), F.asc("department_no")], departments, "r")
    return mine.select("customer_idx", "department_no"), best.select("department_no", "article_id", "rank_in_source")


def trending(tx: DataFrame, top_k: int = 10, min_support: int = 3) -> DataFrame:
    """Growth of the last seven days over the seven before, of items sold enough."""
    return to_all_users(trending_items(tx, top_k, min_support), tx, SOURCES[6])


def trending_items(tx: DataFrame, top_k: int, min_support: int) -> DataFrame:
    weeks = aged(tx).where(F.col("days_ago") < 14).groupBy("article_id").agg(F.count_if(F.col("days_ago") < 7).alias("recent"), F.count_if(F.col("days_ago") >= 7).alias("prior"))
    speed = weeks.where(F.col("recent") >= min_support).withColumn("v", F.round((F.col("recent") - F.col("prior")) / (F.col("prior") + 1.0), 9))
    return top_all(speed, [F.desc("v"), F.asc("article_id")], top_k)


def dept_popular(tx: DataFrame, articles: DataFrame, top_k: int = 12, recent_days: int = 7) -> DataFrame:
    """Recent best items (decayed by day) of a user's main department."""
    mine, best = dept_recent(tx, articles, top_k, recent_days)
    return named(mine.join(best, "department_no"), SOURCES[7])


def dept_recent(tx: DataFrame, articles: DataFrame, top_k: int, recent_days: int) -> tuple[DataFrame, DataFrame]:
    """The main department of each user, and the recent best items of each department."""
    sold = aged(tx).join(by_shuffle(articles.select("article_id", "department_no")), "article_id")
    recent = sold.where(F.col("days_ago") <= recent_days).groupBy("department_no", "article_id").agg(F.round(F.sum(exp_decay(0.05, F.col("days_ago"))), 9).alias("score"))
    best = top(recent, ["department_no"], [F.desc("score"), F.asc("article_id")], top_k)
    return modal(sold, "customer_idx", "department_no"), best.select("department_no", "article_id", "rank_in_source")


def all_sources(tx: DataFrame, customers: DataFrame, articles: DataFrame, **supports: int) -> list[DataFrame]:
    return [repurchase(tx), popular_global(tx), popular_age(tx, customers), popular_channel(tx), item_cf(tx), product_family(tx, articles), trending(tx, **supports), dept_popular(tx, articles)]


def candidates(tx: DataFrame, customers: DataFrame, articles: DataFrame, min_support: int = 3) -> DataFrame:
    """The rows of :func:`all_sources` as ``(customer_idx, article_id, source, rank_in_source)`` with the sources' numbers, 1 to 8, dealt by
    customer.  Only a customer's own rows (R1, R5) and the names of the lists they are given are shuffled; the lists (two dozen
    items for everyone, a cohort, a channel or a department of the catalog) are broadcast and opened where the customer is."""
    users = tx.select("customer_idx").distinct()
    mine, family_best = family(tx, articles, 10, 2)
    main, recent_best = dept_recent(tx, articles, 12, 7)
    asks = {  # who asks for a list, and the list's items
        2: (users.withColumn("key", F.lit("")), popular_items(tx, 0.1, 20).withColumn("key", F.lit(""))),
        3: (customers.select("customer_idx", F.col("age_bin").alias("key")), age_items(tx, customers.select("customer_idx", "age_bin"), 15).withColumnRenamed("age_bin", "key")),
        4: (modal(tx, "customer_idx", "sales_channel_id").withColumnRenamed("sales_channel_id", "key"), channel_items(tx, 15).withColumnRenamed("sales_channel_id", "key")),
        6: (mine.withColumnRenamed("department_no", "key"), family_best.withColumnRenamed("department_no", "key")),
        7: (users.withColumn("key", F.lit("")), trending_items(tx, 10, min_support).withColumn("key", F.lit(""))),
        8: (main.withColumnRenamed("department_no", "key"), recent_best.withColumnRenamed("department_no", "key")),
    }
    number, key = lambda n: F.lit(n).alias("source"), F.col("key").cast("string").alias("key")
    none = F.lit(None).cast("int")
    own = [df.select("customer_idx", number(n), F.lit(None).cast("string").alias("key"), "article_id", F.col("rank_in_source").alias("rank")) for n, df in ((1, repurchase(tx)), (5, item_cf(tx)))]
    given = [df.where("key is not null").select("customer_idx", number(n), key, none.alias("article_id"), none.alias("rank")) for n, (df, _) in asks.items()]
    rows = dealt(reduce(DataFrame.unionByName, [*own, *given]), customers.count(), USERS, "customer_idx")
    items = reduce(DataFrame.unionByName, [df.select(number(n), key, "article_id", F.col("rank_in_source").alias("rank")) for n, (_, df) in asks.items()])
    listed = items.groupBy("source", "key").agg(F.collect_list(F.struct("article_id", "rank")).alias("items"))
    opened = rows.join(F.broadcast(listed), ["source", "key"], "left")
    one = F.when(F.col("key").isNull(), F.array(F.struct("article_id", "rank")))
    return opened.select("customer_idx", "source", F.explode(F.coalesce("items", one)).alias("x")).select("customer_idx", "x.article_id", "source", F.col("x.rank").alias("rank_in_source"))


def consolidate(sources: list[DataFrame], max_per_user: int = 100) -> DataFrame:
    """One row a pair: best rank, number of sources, a flag for each; the first
    ``max_per_user`` by sources, then rank."""
    number = reduce(lambda out, i: F.when(F.col("source") == SOURCES[i - 1], i).otherwise(out), range(1, 9), F.lit(0))
    return merged(reduce(DataFrame.unionByName, sources).withColumn("source", number), max_per_user)


def merged(rows: DataFrame, max_per_user: int = 100) -> DataFrame:
    """:func:`consolidate` of rows with the sources' numbers; rows dealt by customer are merged where they are."""
    found = rows.groupBy("customer_idx", "article_id").agg(F.min("rank_in_source").alias("best_rank"), F.count(F.lit(1)).alias("n_sources"), F.bit_or(F.expr("shiftleft(1, source)")).alias("_in"))
    best = top(found, ["customer_idx"], [F.desc("n_sources"), F.asc("best_rank"), F.asc("article_id")], max_per_user, "r")
    flags = [F.col("_in").bitwiseAND(1 << i).cast("boolean").alias(f"is_R{i}") for i in range(1, 9)]
    return best.select("customer_idx", "article_id", "best_rank", "n_sources", *flags)


def candidate_pool(tx: DataFrame, customers: DataFrame, articles: DataFrame, max_per_user: int = 100, **supports: int) -> DataFrame:
    """:func:`consolidate` of :func:`all_sources`, dealt by customer."""
    return merged(candidates(tx, customers, articles, **supports), max_per_user)


def fallback(tx: DataFrame, top_k: int = 12, days: int = 7, rate: float = 0.05, by: str | None = None) -> DataFrame:
    """``(cohort, article_id, rank)``: best sellers of the last days, padded from the counts of
    all of ``tx`` and, for cohorts, from the global list."""
    rows = aged(tx).withColumn("cohort", F.col(by) if by else F.lit(GLOBAL))
    recent = rows.where(F.col("days_ago") < days).groupBy("cohort", "article_id").agg(F.round(F.sum(exp_decay(rate, F.col("days_ago") / 7.0)), 9).alias("score"))
    level1 = top(recent, ["cohort"], [F.desc("score"), F.asc("article_id")], top_k, "pos").select("cohort", "article_id", F.lit(1).alias("level"), "pos")
    counts = rows.groupBy("cohort", "article_id").agg(F.count(F.lit(1)).alias("n"))
    level2 = top(counts, ["cohort"], [F.desc("n"), F.asc("article_id")], 3 * top_k, "pos").select("cohort", "article_id", F.lit(2).alias("level"), "pos")
    both = level1.unionByName(level2)
    if by:
        base = fallback(tx, top_k, days, rate)
        both = both.unionByName(both.select("cohort").distinct().crossJoin(F.broadcast(base.select("article_id", F.lit(3).alias("level"), F.col("rank").alias("pos")))))  # top_k rows
    return first_wins(both, ["cohort"], top_k)


def first_wins(levels: DataFrame, by: list[str], top_k: int) -> DataFrame:
    """Ordered merge: each item at its first ``(level, pos)``, the first ``top_k`` of each group."""
    once = levels.groupBy(*by, "article_id").agg(F.min(F.struct("level", "pos")).alias("at"))
    return top(once, by, [F.asc("at"), F.asc("article_id")], top_k, "rank").select(*by, "article_id", "rank", F.col("at.level").alias("level"))


def fallback_cohorts(tx: DataFrame, customers: DataFrame, **options) -> DataFrame:
    rows = tx.join(by_shuffle(customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))), "customer_idx")
    return fallback(rows, by="age_bin", **options)


def as_codes(ranked: DataFrame, by: str) -> DataFrame:
    """``(by, items)``: the ranked items as codes with blanks between."""
    items = F.array_sort(F.collect_list(F.struct("rank", item_code(F.col("article_id")).alias("c"))))
    return ranked.groupBy(by).agg(items.alias("x")).select(by, F.array_join(F.transform("x", lambda s: s["c"]), " ").alias("items"))
