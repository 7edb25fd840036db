"""The registered queries over the retail views of a folder of tables.

The tables' purchases are spread over years, so the windows are longer than the production
defaults of the operators; the same numbers stand in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.retail import age_bin_case, by_shuffle, last_days
from vitrina.operators import ablation, audit, explore, features, metrics, ranking, recall, split, versions, waterfall
from vitrina.sources import scratch
from vitrina.sources.tables import Retail
from vitrina.streaming import state, telemetry

HISTORY, VALIDATION, SUPPORT = 364, 28, 2
WEEKS = (13, 26, 39, 52)
V5 = waterfall.Cascade(200, 364, 12)
V6 = waterfall.Cascade(200, 364, 3, 2800, 4)
V7 = waterfall.Cascade(200, 364, 12, 2800, 6)
V8 = waterfall.Cascade(200, 364, 12, 2800, 6, 2, 8, 0.12, weighted=True)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Retail], DataFrame]) -> Callable[[Retail], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(Retail(spark, sf_dir))
        # Whole numbers as bigint and days as text: the same types from any engine.
        wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "date": "string", "timestamp": "string", "timestamp_ntz": "string"}
        return out.select(*[F.col(c).cast(wide.get(t, t)).alias(c) for c, t in out.dtypes])

    QUERIES[f.__name__] = run
    return f


def recent(r: Retail) -> DataFrame:
    return last_days(r.tx, HISTORY)


def binned(r: Retail) -> DataFrame:
    return audit.prepared_customers(r.customers)


def parts(r: Retail) -> split.Split:
    s = split.temporal(r.tx, VALIDATION, HISTORY)
    return split.Split(r.dated("train", s.train), s.validation)


def pool(r: Retail) -> DataFrame:
    """The candidates of the training window: written once, all that reads them reads that."""
    return r.kept("pool", lambda: recall.candidate_pool(parts(r).train, binned(r), r.articles, min_support=SUPPORT))


def dealt_pool(r: Retail) -> DataFrame:
    """The pool dealt by customer, so that what joins or ranks a customer's pairs is done where they are."""
    return recall.dealt(pool(r), pool(r).count(), recall.PAIRS, "customer_idx")


def labelled_pool(r: Retail) -> DataFrame:
    return split.label(pool(r), parts(r).validation, pool(r).count())


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def nudged(df: DataFrame) -> DataFrame:
    """Rounded with a nudge far above the noise of a sum and far below a digit, so that means that end
    in a 5 round alike in any order of summation; ratios to a mean of 0 are large and get two digits."""
    near = lambda c: F.round(F.col(c) + 3e-5, 2) if c.endswith("_ratio") and c.startswith("uxa") else F.round(F.col(c) + 3e-9, 6)
    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def repurchase(r):
    return recall.repurchase(recent(r))


@query
def popular_global(r):
    return recall.popular_global(recent(r))


@query
def popular_age(r):
    return recall.popular_age(recent(r), binned(r))


@query
def popular_channel(r):
    return recall.popular_channel(recent(r))


@query
def item_cf(r):
    return recall.item_cf(recent(r), window_days=90)


@query
def product_family(r):
    return recall.product_family(recent(r), r.articles)


@query
def trending(r):
    return recall.trending(recent(r), min_support=SUPPORT)


@query
def dept_popular(r):
    return recall.dept_popular(recent(r), r.articles, recent_days=28)


@query
def consolidated_pool(r):
    return pool(r)


@query
def fallback_global(r):
    return recall.fallback(r.tx).select("cohort", "article_id", "rank")


@query
def fallback_cohort(r):
    return recall.fallback_cohorts(r.tx, r.customers).select("cohort", "article_id", "rank")


@query
def weekly_agg(r):
    return nudged(explore.weekly(r.tx))


@query
def customer_mapping(r):
    return audit.customer_mapping(r.customers)


@query
def customers_binned(r):
    return binned(r)


@query
def temporal_split_counts(r):
    s = parts(r)
    one = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.min("t_dat").alias("first"), F.max("t_dat").alias("last"))
    return one(s.train, "train").unionByName(one(s.validation, "validation"))


@query
def rolling_split_bounds(r):
    one = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.min("t_dat").alias("first"), F.max("t_dat").alias("last"))
    out = None
    for name, df in split.rolling(r.tx, VALIDATION, HISTORY).items():
        out = one(df, name) if out is None else out.unionByName(one(df, name))
    return out


@query
def leakage_audit(r):
    s = parts(r)
    return split.leakage(s.train, s.validation)


@query
def ground_truth(r):
    return split.ground_truth(parts(r).validation).select("customer_idx", F.array_join(F.transform("items", lambda i: i.cast("string")), " ").alias("items"))


@query
def features_user(r):
    return nudged(features.user_features(recent(r), r.customers))


@query
def features_article(r):
    return nudged(features.article_features(recent(r), r.articles))


@query
def features_interaction(r):
    tx = parts(r).train
    return nudged(features.interaction_features(pool(r), tx, r.articles, features.user_features(tx, r.customers), features.article_features(tx, r.articles)))


@query
def features_meta(r):
    return features.meta_features(pool(r))


@query
def features_matrix(r):
    return nudged(matrix(r, pool(r)))


@query
def ranker_labels(r):
    return labelled_pool(r).groupBy("target").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("customer_idx").alias("users"))


@query
def negative_sample(r):
    return split.training_rows(labelled_pool(r), 5).select("customer_idx", "article_id", "target")


def pool_lists(r: Retail) -> DataFrame:
    return ablation.as_lists(dealt_pool(r))


@query
def ap_at_12(r):
    return rounded(metrics.by_user(ablation.as_truth(parts(r).validation), pool_lists(r), 12))


@query
def ranking_metrics(r):
    catalog = r.articles.select(F.col("article_id").alias("item"))
    return rounded(metrics.evaluate(ablation.as_truth(parts(r).validation), pool_lists(r), 12, catalog=catalog))


@query
def recall_curve(r):
    ranked = recall.top(dealt_pool(r), ["customer_idx"], [F.desc("n_sources"), F.asc("best_rank"), F.asc("article_id")], 80, "rank")
    predicted = ranked.select(F.col("customer_idx").alias("user"), F.col("article_id").alias("item"), "rank")
    return rounded(metrics.curve(ablation.as_truth(parts(r).validation), predicted, [1, 5, 12, 20, 40, 80]))


@query
def source_contribution(r):
    return explore.contributions(labelled_pool(r))


@query
def source_consensus(r):
    return rounded(explore.consensus(labelled_pool(r)))


@query
def source_correlation(r):
    return rounded(explore.source_correlation(pool(r)))


@query
def frequent_vs_sporadic(r):
    scores = metrics.by_user(ablation.as_truth(parts(r).validation), pool_lists(r), 12)
    kinds = explore.activity(parts(r).train, HISTORY).withColumnRenamed("customer_idx", "user")
    return rounded(metrics.summary(scores.join(kinds, "user"), "activity"))


def lists(r: Retail, spec: waterfall.Cascade) -> DataFrame:
    return waterfall.arrays_as_prediction(waterfall.cascade_arrays(r.tx, r.customers, spec))


@query
def waterfall_v5(r):
    return lists(r, V5)


@query
def waterfall_v6(r):
    return lists(r, V6)


@query
def waterfall_v7(r):
    return lists(r, V7)


@query
def waterfall_v8(r):
    return lists(r, V8)


@query
def waterfall_comparison(r):
    return rounded(ablation.compare_cascades(r.tx, r.customers, {"v5": V5, "v6": V6, "v7": V7, "v8": V8}, VALIDATION))


def serving(r: Retail) -> dict[str, DataFrame]:
    return waterfall.serving_tables(r.tx, r.customers, 201, 2801, 364, 2)


@query
def serving_bestsellers(r):
    return rounded(serving(r)["bestsellers"])


@query
def serving_affinity(r):
    return rounded(serving(r)["affinity"])


@query
def serving_history(r):
    return serving(r)["history"]


def requests(r: Retail) -> DataFrame:
    return r.customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))


@query
def online_cascade(r):
    return waterfall.online(serving(r), requests(r), top_k=12, offset=6)


@query
def request_pipeline(r):
    seen = recent(r).select("customer_idx", "article_id").distinct()
    return rounded(waterfall.request_pipeline(serving(r), requests(r), seen, limit=10, offset=2))


@query
def prediction_contract(r):
    found = lists(r, V8).join(by_shuffle(r.customers.select("customer_idx", "customer_id")), "customer_idx")
    return waterfall.contract(found, 1000)


@query
def popularity_assembly(r):
    scored = dealt_pool(r).withColumn("score", F.round(F.col("n_sources") + 1.0 / F.col("best_rank"), 9))
    return waterfall.as_prediction(waterfall.assemble(scored, recall.fallback_cohorts(parts(r).train, r.customers), requests(r)))


@query
def sparsity(r):
    return rounded(explore.sparsity(r.tx), 9)


@query
def repurchase_lag_cdf(r):
    return rounded(explore.lag_cdf(r.tx, by=("customer_idx",)))


@query
def power_law(r):
    return rounded(explore.power_law(r.tx))


@query
def lorenz_gini(r):
    return rounded(explore.gini(recent(r), r.articles))


@query
def lorenz_curve(r):
    return rounded(explore.lorenz(recent(r)))


@query
def cohort_demographics(r):
    return rounded(explore.demographics(r.customers))


@query
def age_histogram(r):
    return explore.age_histogram(r.customers)


@query
def channel_mix(r):
    return rounded(explore.channel_mix(r.tx, r.customers))


@query
def dept_revenue(r):
    return explore.dept_revenue(r.tx, r.articles)


@query
def text_length(r):
    return rounded(explore.text_length(r.table("documents")))


@query
def basket_matrix(r):
    return rounded(explore.basket_matrix(r.tx, r.articles))


@query
def price_tiers(r):
    return rounded(explore.price_tiers(r.tx, r.customers, 20000.0, 60000.0), 4)


@query
def quality_audit(r):
    return audit.quality(r.tx, r.customers, r.articles)


@query
def catalog_value_counts(r):
    return rounded(audit.value_counts(r.articles, "garment_group_name"))


@query
def null_counts(r):
    return rounded(audit.null_counts(r.customers))


@query
def describe_features(r):
    return rounded(audit.describe(features.user_features(recent(r), r.customers), ["u_total_transactions", "u_mean_price", "u_online_ratio", "u_age"]), 4)


@query
def narrow_types(r):
    return audit.narrow_types(r.tx.select("customer_idx", "article_id", "sales_channel_id"))


@query
def stratified_sample(r):
    return audit.stratified_sample(r.tx, 200, HISTORY)


@query
def telemetry_percentiles(r):
    return rounded(telemetry.percentiles(r.table("events")))


@query
def telemetry_windows(r):
    return rounded(telemetry.windows(r.table("events")), 4)


@query
def pareto_frontier(r):
    rows = recent(r).join(by_shuffle(r.articles.select("article_id", "department_no")), "article_id").groupBy("department_no").agg(F.count(F.lit(1)).alias("sales"), F.round(F.avg("price"), 4).alias("mean_price"), F.count_distinct("article_id").alias("items"))
    return audit.pareto(rows, ["sales"], ["mean_price", "items"], "department_no")


@query
def archetypes(r):
    return audit.archetypes(features.user_features(recent(r), r.customers))


def matrix(r: Retail, rows: DataFrame) -> DataFrame:
    return features.matrix(rows, parts(r).train, r.customers, r.articles)


def trained(r: Retail) -> ranking.LambdaRanker:
    """The ranker of the production size, trained once for all that asks it: its rows are drawn from the labelled pairs before they get
    their features."""

    def make() -> ranking.LambdaRanker:
        chosen = scratch.kept(split.training_rows(labelled_pool(r), 5), "chosen")
        rows = scratch.kept(matrix(r, chosen), "training")
        out = ranking.LambdaRanker([c for c in rows.columns if c not in ("customer_idx", "article_id", "target")], **ranking.PRODUCTION).fit(rows)
        scratch.drop(chosen, rows)
        return out

    return r.once("ranker", make)


def scores(r: Retail) -> DataFrame:
    return trained(r).score(matrix(r, pool(r))).select("customer_idx", "article_id", "score")


@query
def ranker_scores(r):
    return recall.top(scores(r), ["customer_idx"], [F.desc("score"), F.asc("article_id")], 12, "rank")


@query
def feature_importance(r):
    return trained(r).importance(r.spark)


@query
def shap_top(r):
    ranker = trained(r)
    bought = r.kept("bought", lambda: labelled_pool(r).where("target = 1"))
    return ranking.mean_abs(ranker.shap(matrix(r, bought)), ranker.features)


@query
def waterfall_v2(r):
    return versions.predict("v2", parts(r).train, r.customers, lambda: scores(r))


@query
def ablation_window(r):
    return rounded(ablation.by_window(r.tx, binned(r), r.articles, WEEKS, VALIDATION, min_support=SUPPORT))


@query
def ablation_leave_one_out(r):
    return rounded(ablation.leave_one_out(r.tx, binned(r), r.articles, HISTORY, VALIDATION, min_support=SUPPORT))


@query
def ablation_ranker(r):
    variants = {"A3_no_flags": {"flags": False}, **{f"A4_1_to_{n}": {"ratio": n} for n in (3, 5, 10, 20)}, "A5_pointwise": {"loss": "pointwise"}}
    return ablation.ranker_variants(r.tx, binned(r), r.articles, variants, HISTORY, VALIDATION, min_support=SUPPORT)


@query
def statistics_audit(r):
    return rounded(audit.statistics(r.tx, r.customers, r.articles))


@query
def catalog_audit(r):
    pictured = r.table("part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("int").alias("article_id"))
    return rounded(audit.catalog(r.articles, pictured, ["department_no", "garment_group_name", "product_type_no", "detail_desc"]))


@query
def telemetry_recent(r):
    return rounded(telemetry.recent_percentiles(r.table("events"), 500))


@query
def weekly_best_sellers(r):
    return telemetry.best_sellers(telemetry.sales_by_window(r.tx, "28 days"), 5)


@query
def telemetry_stream(r):
    where = scratch.new_path(r.spark, "telemetry")
    events = telemetry.stream(r.spark, r.sf_dir, "events", r.table("events").schema)
    return rounded(telemetry.run_to_table(telemetry.windows(events), f"{where}/out", f"{where}/state"), 4)


@query
def telemetry_recent_stream(r):
    where = scratch.new_path(r.spark, "recent")
    state.recent_on_stream(telemetry.stream(r.spark, r.sf_dir, "events", r.table("events").schema), f"{where}/out", f"{where}/state", last=500)
    return rounded(state.recent_summary(r.spark, f"{where}/out", 500))


@query
def telemetry_sketches(r):
    """Whether the ranks of the sketches' percentiles are within 2 % of a window's rows (or one row) of the wanted ones."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = state.window_percentiles(r.table("events"), shares)
    rows = r.table("events").select(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type", "value").where("value IS NOT NULL")
    ranks = rows.join(F.broadcast(found), ["start", "event_type"]).groupBy("start", "event_type", "events")  # a row a window
    off = lambda c, q: F.greatest(F.avg((F.col("value") < F.col(c)).cast("double")) - q, q - F.avg((F.col("value") <= F.col(c)).cast("double")))
    return ranks.agg(*[(off(c, q) <= F.greatest(F.lit(0.02), 1 / F.count(F.lit(1)))).alias(f"{c}_fits") for c, q in shares.items()])


@query
def stream_best_sellers(r):
    where = scratch.new_path(r.spark, "best")
    purchases = r.spark.readStream.schema(r.purchases.schema).parquet(r.purchases.vitrina_path)
    state.best_sellers_on_stream(purchases, f"{where}/out", f"{where}/state", days=28)
    return state.decayed_best(state.Versions(r.spark, f"{where}/out").before())
