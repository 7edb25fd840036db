"""Exploratory statistics: the data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.quantiles import quantiles
from vitrina.functions.retail import age_bin_case, by_shuffle, last_days

# The points of the lag distribution.
LAG_DAYS = [1, 2, 3, 5, 7, 10, 14, 21, 28, 35, 60, 90]


def sparsity(tx: DataFrame) -> DataFrame:
    """Users, items, density and purchases of a user."""
    per = tx.groupBy("customer_idx").agg(F.count(F.lit(1)).alias("n"))
    users = per.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("rows"), F.avg("n").alias("mean_per_user")).crossJoin(F.broadcast(quantiles(per, "n", {"median_per_user": 0.5}, counted=True)))  # one row
    items = tx.agg(F.count_distinct("article_id").alias("items"))
    return users.crossJoin(F.broadcast(items)).select("users", "items", "rows", (1 - F.col("rows") / (F.col("users") * F.col("items"))).alias("sparsity"), "mean_per_user", "median_per_user")


def weekly(tx: DataFrame) -> DataFrame:
    """Sales by week (from Monday)."""
    return tx.groupBy(F.to_date(F.date_trunc("week", "t_dat")).alias("week_date")).agg(
        F.count(F.lit(1)).alias("n_transactions"), F.count_distinct("article_id").alias("n_unique_articles"), F.count_distinct("customer_idx").alias("n_unique_customers"),
        F.sum("price").alias("total_revenue"), F.avg("price").alias("avg_price"), F.max("t_dat").alias("max_t_dat"), F.min("t_dat").alias("min_t_dat"),
    )


def lags(tx: DataFrame, by: tuple[str, ...] = ("customer_idx", "article_id"), distinct_days: bool = True) -> DataFrame:
    """Positive days between consecutive purchases."""
    rows = tx.select(*by, "t_dat")
    rows = rows.distinct() if distinct_days else rows
    before = F.lag("t_dat").over(Window.partitionBy(*by).orderBy("t_dat"))
    return rows.withColumn("lag", F.datediff("t_dat", before)).where("lag > 0")


def lag_cdf(tx: DataFrame, points: list[int] = LAG_DAYS, **options) -> DataFrame:
    """Share of lags up to each point, with the median."""
    found = lags(tx, **options)
    shares = F.array(*[F.struct(F.lit(d).alias("day"), F.avg((F.col("lag") <= d).cast("double")).alias("cdf")) for d in points])
    one = found.agg(F.count(F.lit(1)).alias("lags"), shares.alias("x")).crossJoin(F.broadcast(quantiles(found, "lag", {"median_lag": 0.5}, counted=True)))  # one row
    return one.select("lags", "median_lag", F.explode("x").alias("x")).select("x.day", "x.cdf", "lags", "median_lag")


def ranked_counts(tx: DataFrame, by: str = "article_id") -> DataFrame:
    """``(n, items, first_rank)``: how many items have each count and the rank of the first of them, most bought
    first.  Ranks come from the counts of counts, so no window holds all items."""
    counts = tx.groupBy(by).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("items"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_rank", F.coalesce(F.sum("items").over(w), F.lit(0)) + 1)


def power_law(tx: DataFrame, low: int = 11, high: int = 5000) -> DataFrame:
    """Slope of log10(count) on log10(rank) for the ranks from ``low`` to ``high``."""
    runs = ranked_counts(tx).select("n", F.greatest("first_rank", F.lit(low)).alias("a"), F.least(F.col("first_rank") + F.col("items") - 1, F.lit(high)).alias("b")).where("a <= b")
    points = runs.select(F.log10("n").alias("y"), F.explode(F.sequence("a", "b")).alias("r")).withColumn("x", F.log10("r"))  # at most ``high`` rows
    return points.agg((-F.regr_slope("y", "x")).alias("alpha"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("points"))


def gini(tx: DataFrame, catalog: DataFrame) -> DataFrame:
    """E5: Gini index of sales over active items and over the catalog (with zeros)."""
    runs = ranked_counts(tx)
    # In ascending order an item of run rank r (descending) has place n_items - r + 1.
    total = runs.agg(F.sum("items").alias("active"), F.sum(F.col("n") * F.col("items")).alias("sales"), F.sum(F.col("n") * (F.col("items") * F.col("first_rank") + F.col("items") * (F.col("items") - 1) / 2)).alias("down"))
    size = catalog.agg(F.count_distinct("article_id").alias("catalog"))
    index = lambda n: (2 * ((F.col(n) + 1) * F.col("sales") - F.col("down")) - (F.col(n) + 1) * F.col("sales")) / (F.col(n) * F.col("sales"))
    return total.crossJoin(F.broadcast(size)).select("active", "catalog", index("active").alias("gini_active"), index("catalog").alias("gini_catalog"))


def lorenz(tx: DataFrame, points: int = 10) -> DataFrame:
    """E5: share of sales of the least sold shares of active items, in ``points`` steps."""
    runs = ranked_counts(tx).crossJoin(F.broadcast(tx.agg(F.count_distinct("article_id").alias("active"), F.count(F.lit(1)).alias("sales"))))
    at = runs.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("p")).withColumn("k", F.floor(F.col("active") * F.col("p") / points))
    last = F.col("active") - F.col("first_rank") + 1  # ascending place of the run's last item
    taken = F.greatest(F.least(F.col("k"), last) - (last - F.col("items")), F.lit(0))
    return at.groupBy("p").agg((F.sum(taken * F.col("n")) / F.first("sales")).alias("share")).select((F.col("p") / points).alias("items_share"), "share")


def demographics(customers: DataFrame) -> DataFrame:
    """Customers and mean age by cohort."""
    return customers.groupBy(age_bin_case(F.col("age")).alias("age_bin")).agg(F.count(F.lit(1)).alias("customers"), F.avg("age").alias("mean_age"))


def age_histogram(customers: DataFrame, bins: int = 40, low: int = 15, high: int = 80) -> DataFrame:
    """Customers in each of ``bins`` equal bins."""
    return customers.where(F.col("age").between(low, high)).select(F.least(F.floor((F.col("age") - low) * bins / (high - low)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("customers"))


def channel_mix(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of online purchases by cohort."""
    rows = tx.join(by_shuffle(customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))), "customer_idx")
    return rows.groupBy("age_bin").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("sales_channel_id") == 2).cast("double"))).alias("online_pct"))


def dept_revenue(tx: DataFrame, articles: DataFrame, k: int = 15) -> DataFrame:
    """The departments of highest revenue."""
    found = tx.join(by_shuffle(articles.select("article_id", "department_no")), "article_id").groupBy("department_no").agg(F.round(F.sum("price"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("revenue"), F.asc("department_no")).limit(k)


def text_length(docs: DataFrame, column: str = "text") -> DataFrame:
    """Words (split on single blanks) and share of nulls."""
    words = docs.select(F.when(F.col(column).isNotNull(), F.size(F.split(column, " "))).alias("words"))
    one = words.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("words").isNull().cast("double")).alias("null_share"), F.avg("words").alias("mean_words"))
    return one.crossJoin(F.broadcast(quantiles(words, "words", {"median_words": 0.5}, counted=True)))  # one row


def basket_matrix(tx: DataFrame, articles: DataFrame, category: str = "garment_group_name") -> DataFrame:
    """P(B|A) of categories in one basket (user and day), the diagonal included."""
    lines = tx.join(by_shuffle(articles.select("article_id", F.col(category).alias("a"))), "article_id").select("customer_idx", "t_dat", "a").distinct()
    both = lines.join(lines.select("customer_idx", "t_dat", F.col("a").alias("b")), ["customer_idx", "t_dat"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return both.join(lines.groupBy("a").agg(F.count(F.lit(1)).alias("n_a")), "a").select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("p_b_given_a"))


def price_tiers(tx: DataFrame, customers: DataFrame, low: float = 0.02, high: float = 0.035) -> DataFrame:
    """Price tiers, mean and (interpolated) quartiles by cohort."""
    rows = tx.join(by_shuffle(customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))), "customer_idx")
    share = lambda c: F.avg(c.cast("double"))
    p = F.col("price")
    tiers = rows.groupBy("age_bin").agg(
        F.count(F.lit(1)).alias("n"), share(p < low).alias("entry"), share((p >= low) & (p <= high)).alias("mid"), share(p > high).alias("premium"),
        F.avg(p).alias("mean"),
    )
    return tiers.join(F.broadcast(quantiles(rows, "price", {"q25": 0.25, "q75": 0.75}, by=("age_bin",))), "age_bin", "left")  # a row a cohort


def contributions(labelled: DataFrame) -> DataFrame:
    """By source: pairs, hits, and hits that no other source has."""
    out = None
    for i in range(1, 9):
        only = F.col(f"is_R{i}") & ~F.greatest(*[F.col(f"is_R{j}") for j in range(1, 9) if j != i])
        one = [F.count_if(F.col(f"is_R{i}")).alias("pairs"), F.count_if(F.col(f"is_R{i}") & (F.col("target") == 1)).alias("hits"), F.count_if(only & (F.col("target") == 1)).alias("exclusive_hits")]
        row = F.struct(F.lit(f"R{i}").alias("source"), *one)
        out = [row] if out is None else [*out, row]
    return labelled.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def consensus(labelled: DataFrame) -> DataFrame:
    """Conversion by number of sources."""
    return labelled.groupBy("n_sources").agg(F.count(F.lit(1)).alias("pairs"), F.sum("target").alias("hits"), F.avg("target").alias("rate"))


def source_correlation(pool: DataFrame) -> DataFrame:
    """Pearson correlation of the source flags, all pairs."""
    flag = lambda i: F.col(f"is_R{i}").cast("double")
    cells = [F.struct(F.lit(f"R{i}").alias("a"), F.lit(f"R{j}").alias("b"), F.corr(flag(i), flag(j)).alias("r")) for i in range(1, 9) for j in range(i + 1, 9)]
    return pool.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def activity(tx: DataFrame, days: int, frequent: int = 4) -> DataFrame:
    """Users as ``frequent`` (four purchases or more) or ``sporadic``."""
    n = last_days(tx, days).groupBy("customer_idx").agg(F.count(F.lit(1)).alias("n"))
    return n.select("customer_idx", F.when(F.col("n") >= frequent, "frequent").otherwise("sporadic").alias("activity"))
