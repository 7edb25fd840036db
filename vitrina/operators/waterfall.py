"""Recommendation cascades V5-V8, serving tables, the online cascade and the output contract.

A list is the ordered merge of levels: personal items, basket complements, cohort best
sellers, global best sellers; each item stays at its first place.  All levels are rows
``(customer_idx, article_id, level, pos)``, so a cascade is joins, one aggregation and one
window, whatever the number of users.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.functions.retail import AGE_LABELS, GLOBAL, age_bin_case, by_shuffle, item_code, last_days, pow_decay
from vitrina.operators.recall import USERS, dealt, first_wins, top, top_all
from vitrina.sources.scratch import kept

TOP_K = 12
#: Items of a basket that meet all at once.
BASKET_ITEMS = 1000
#: Pairs of baskets that a task makes, or counts.
BASKET_PAIRS = 1_000_000


@dataclass(frozen=True)
class Cascade:
    """Parameters of a cascade; days count the reference day."""

    personal_days: int
    bestseller_days: int
    personal_cap: int
    basket_days: int = 0
    complement_cap: int = 0
    support: int = 2
    top_pairs: int = 5
    bestseller_decay: float = 1.0
    weighted: bool = False
    pair_decay: float = 0.85
    base_decay: float = 0.80
    base_items: int = 5


# The parameters of the versions.
VERSIONS = {
    "v5": Cascade(35, 7, 12),
    "v6": Cascade(35, 7, 3, 35, 4),
    "v7": Cascade(35, 7, 12, 35, 6),
    "v8": Cascade(28, 21, 12, 35, 6, 3, 8, 0.12, weighted=True),
}


def history(tx: DataFrame, days: int, ref_date: str | None = None) -> DataFrame:
    """Personal items by last purchase, then count: ``(customer_idx, article_id, pos, days_ago)``."""
    own = last_days(tx, days, ref_date).groupBy("customer_idx", "article_id").agg(F.min("days_ago").alias("days_ago"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("customer_idx").orderBy(F.asc("days_ago"), F.desc("n"), F.asc("article_id"))
    return own.select("customer_idx", "article_id", "days_ago", F.row_number().over(w).alias("pos"))


def within_baskets(lines: DataFrame, basket: list[str], pairs: int = 0) -> DataFrame:
    """Pairs of different items of one basket: ``lines(..., article_id, n)`` with ``other`` and ``m`` beside them.  A basket of more than
    ``BASKET_ITEMS`` items is dealt to parts of about so many, and every two of its parts meet in a group of their own.  ``pairs``: how
    many there are about; tasks make ``BASKET_PAIRS`` of them each."""
    size = lines.groupBy(*basket).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > BASKET_ITEMS)
    own = lines.join(size, basket, "left").withColumn("_parts", F.coalesce(F.ceil(F.col("_size") / BASKET_ITEMS), F.lit(1)).cast("int"))
    own = own.withColumns({"_a": F.pmod(F.xxhash64("article_id"), F.col("_parts")).cast("int"), "_all": F.sequence(F.lit(0), F.col("_parts") - 1)}).drop("_size", "_parts")
    left = own.withColumn("_b", F.explode("_all")).drop("_all")
    other = own.select(*basket, F.col("article_id").alias("other"), F.col("n").alias("m"), F.col("_a").alias("_b"), F.explode("_all").alias("_a"))
    meet = [*basket, "_a", "_b"]
    left, other = (dealt(side, pairs, BASKET_PAIRS, *meet) for side in (left, other))
    return left.join(other, meet).where("article_id != other").drop("_a", "_b")


def met_pairs(tx: DataFrame, days: int, support: int, decay: float, ref_date: str | None = None) -> DataFrame:
    """Items bought by one user on one day, each pair once: ``(article_id, other, decayed, support)`` with ``article_id < other``.  Rows of one
    basket and item are counted first, which keeps repeats as products of counts.  A basket is dealt to a task and its pairs are made there;
    those of more than ``BASKET_ITEMS`` rows (at most one for as many rows, so they are broadcast) meet in parts.  Tasks are as many
    as the baskets' pairs ask for."""
    basket = ["customer_idx", "days_ago"]
    near = last_days(tx, days, ref_date).where("customer_idx is not null").select(*basket, "article_id")
    sizes = near.groupBy(*basket).agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = sizes.agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.count_if(F.col("n") > BASKET_ITEMS).alias("huge")).first()
    n_pairs = int(found["pairs"] or 0)
    huge = F.broadcast(kept((sizes.where(F.col("n") > BASKET_ITEMS) if found["huge"] else sizes.limit(0)).select(*basket), "huge"))
    counted = lambda rows: rows.groupBy(*basket, "article_id").agg(F.count(F.lit(1)).alias("n"))
    lines = counted(dealt(near.join(huge, basket, "left_anti"), n_pairs, BASKET_PAIRS, *basket))
    small = lines.groupBy(*basket).agg(F.collect_list(F.struct("article_id", "n")).alias("items"))
    own = small.select("days_ago", "items", F.inline("items")).select("days_ago", "article_id", "n", F.inline("items").alias("other", "m"))
    rest = within_baskets(counted(near.join(huge, basket, "left_semi")), basket, n_pairs).select(*own.columns)
    both = own.unionByName(rest).where("article_id < other").select("article_id", "other", "days_ago", (F.col("n") * F.col("m")).alias("times"))
    decayed = F.round(F.sum(F.col("times") * pow_decay(decay, 2 * F.col("days_ago") / 14.0)), 12)
    pairs = dealt(both, n_pairs, BASKET_PAIRS, "article_id", "other").groupBy("article_id", "other")
    return pairs.agg(decayed.alias("decayed"), F.sum("times").alias("support")).where(F.col("support") >= support)


def basket_pairs(tx: DataFrame, days: int, support: int, top_pairs: int, decay: float, weighted: bool, ref_date: str | None = None, met: DataFrame | None = None) -> DataFrame:
    """The items bought most with an item: ``(article_id, other, weight, r)``.  ``met``: the pairs of :func:`met_pairs`, if they are made."""
    met = met_pairs(tx, days, support, decay, ref_date) if met is None else met.where(F.col("support") >= support)
    weight = F.col("decayed") if weighted else F.col("support").cast("double")
    sides = F.array(F.struct("article_id", "other"), F.struct(F.col("other").alias("article_id"), F.col("article_id").alias("other")))
    pairs = met.select(weight.alias("weight"), F.inline(sides))
    return top(pairs, ["article_id"], [F.desc("weight"), F.asc("other")], top_pairs, "r").select("article_id", "other", "weight", "r")


def bestsellers(tx: DataFrame, customers: DataFrame, days: int, decay: float, ref_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Global ``(article_id, rank)`` and cohort ``(age_bin, article_id, rank)`` lists of ``TOP_K``."""
    sold = last_days(tx, days, ref_date)
    score = F.round(F.sum(pow_decay(decay, F.col("days_ago") / 7.0)), 9).alias("score")
    order = [F.desc("score"), F.asc("article_id")]
    all_ = top_all(sold.groupBy("article_id").agg(score), order, TOP_K, "rank").select("article_id", "score", "rank")
    bins = customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))
    cohort = top(sold.join(by_shuffle(bins), "customer_idx").groupBy("age_bin", "article_id").agg(score), ["age_bin"], order, TOP_K, "rank")
    return all_, cohort.select("age_bin", "article_id", "score", "rank")


def complements(hist: DataFrame, pairs: DataFrame, spec: Cascade) -> DataFrame:
    """Complements of what a user has, best first: ``(customer_idx, article_id, pos)``.  Kept personal items are
    no complements; the cap is taken before the slots are filled."""
    kept = hist.where(F.col("pos") <= spec.personal_cap).select("customer_idx", "article_id")
    base = hist.where(F.col("pos") <= spec.base_items) if spec.weighted else hist
    found = base.join(by_shuffle(pairs), "article_id").select("customer_idx", F.col("other").alias("article_id"), "pos", "r", "days_ago", "weight")
    found = found.join(by_shuffle(kept), ["customer_idx", "article_id"], "left_anti")
    if spec.weighted:
        score = F.round(F.sum(pow_decay(spec.base_decay, F.col("days_ago") / 7.0) * F.col("weight")), 12)
        scored, order = found.groupBy("customer_idx", "article_id").agg(score.alias("score")), [F.desc("score"), F.asc("article_id")]
    else:
        scored, order = found.groupBy("customer_idx", "article_id").agg(F.min(F.struct("pos", "r")).alias("at")), [F.asc("at"), F.asc("article_id")]
    return top(scored, ["customer_idx"], order, spec.complement_cap, "pos").select("customer_idx", "article_id", "pos")


def parts(tx: DataFrame, customers: DataFrame, spec: Cascade, ref_date: str | None = None, met: dict[tuple, DataFrame] | None = None) -> dict[str, tuple[tuple, Callable[[], object]]]:
    """What a cascade is made of: by name what tells it from that of other cascades over the same purchases, and how it is made.
    ``met``: tables of :func:`met_pairs` by days and decay."""
    days, decay = spec.bestseller_days, spec.bestseller_decay
    out = {
        "history": (("history", spec.personal_days), lambda: history(tx, spec.personal_days, ref_date)),
        "best": (("best", days, decay), lambda: bestsellers(tx, customers, days, decay, ref_date)),
    }
    if spec.complement_cap:
        of = spec.basket_days, spec.support, spec.top_pairs, spec.pair_decay, spec.weighted
        out["pairs"] = ("pairs", *of), lambda: basket_pairs(tx, *of, ref_date, (met or {}).get((spec.basket_days, spec.pair_decay)))
    return out


def made_once(tx: DataFrame, customers: DataFrame, specs: list[Cascade], ref_date: str | None = None, parallelism: int = 4) -> dict[tuple, object]:
    """The parts of several cascades, each written once; some at a time, as their small jobs leave executors idle.  The pairs of baskets,
    which are most of the work and of the disk, meet once for all cascades of the same days and decay."""
    supports: dict[tuple, int] = {}
    for spec in specs:
        if spec.complement_cap:
            of = spec.basket_days, spec.pair_decay
            supports[of] = min(spec.support, supports.get(of, spec.support))
    met = {(days, decay): kept(met_pairs(tx, days, least, decay, ref_date), "met") for (days, decay), least in supports.items()}
    wanted = {key: make for spec in specs for key, make in parts(tx, customers, spec, ref_date, met).values()}

    def written(item: tuple) -> object:
        (name, *_), make = item
        out = make()
        return tuple(kept(t, name) for t in out) if isinstance(out, tuple) else kept(out, name)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(wanted, pool.map(inheritable_thread_target(written), wanted.items()), strict=True))


def cascade_arrays(tx: DataFrame, customers: DataFrame, spec: Cascade, ref_date: str | None = None, top_k: int = TOP_K, made: dict | None = None) -> DataFrame:
    """``(customer_idx, items)`` for every customer: an array of ``(article_id, level)``, level 1 personal, 2 complement, 3
    cohort, 4 global.  Only a customer's own items are rows; the lists of the cohorts are broadcast (a list of ``TOP_K`` for
    each of six cohorts) and fill the array in the customer's row.
    ``made``: parts that :func:`made_once` has written."""
    own_parts = {name: made[key] if made is not None else make() for name, (key, make) in parts(tx, customers, spec, ref_date).items()}
    hist = own_parts["history"]
    level = lambda df, n: df.select("customer_idx", "article_id", F.lit(n).alias("level"), "pos")
    rows = level(hist.where(F.col("pos") <= spec.personal_cap), 1)
    if "pairs" in own_parts:
        rows = rows.unionByName(level(complements(hist, own_parts["pairs"], spec), 2))
    all_, cohort = own_parts["best"]
    in_order = lambda *by: F.array_sort(F.collect_list(F.struct(*by, "article_id")))  # noqa: E731  at most the caps
    own = rows.groupBy("customer_idx").agg(in_order("level", "pos").alias("own"))
    by_cohort = F.broadcast(cohort.where(F.col("age_bin") != GLOBAL).groupBy("age_bin").agg(in_order("rank").alias("cohort")))
    everyones = F.broadcast(all_.agg(in_order("rank").alias("rest")))
    users = customers.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin")).join(by_cohort, "age_bin", "left").crossJoin(everyones).join(by_shuffle(own), "customer_idx", "left")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["article_id"]), F.array().cast("array<int>"))
    more = users.select("customer_idx", F.coalesce(F.transform("own", lambda x: F.struct(x["article_id"], x["level"])), F.array().cast("array<struct<article_id:int,level:int>>")).alias("own"), ids("own").alias("has"), ids("cohort").alias("cohort"), ids("rest").alias("rest"))
    at_level = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("article_id"), F.lit(n).alias("level")))
    filled = F.concat("own", at_level(F.array_except("cohort", "has"), 3), at_level(F.array_except(F.array_except("rest", "has"), "cohort"), 4))
    return more.select("customer_idx", F.slice(filled, 1, top_k).alias("items"))


def cascade(tx: DataFrame, customers: DataFrame, spec: Cascade, ref_date: str | None = None, top_k: int = TOP_K, made: dict | None = None) -> DataFrame:
    """The rows ``(customer_idx, article_id, rank, level)`` of :func:`cascade_arrays`."""
    placed = cascade_arrays(tx, customers, spec, ref_date, top_k, made).select("customer_idx", F.posexplode("items").alias("at", "x"))
    return placed.select("customer_idx", "x.article_id", (F.col("at") + 1).alias("rank"), "x.level")


def arrays_as_prediction(lists: DataFrame) -> DataFrame:
    """``(customer_idx, prediction)`` of :func:`cascade_arrays`: the codes in order with blanks between."""
    return lists.select("customer_idx", F.array_join(F.transform("items", lambda x: item_code(x["article_id"])), " ").alias("prediction"))


def as_prediction(lists: DataFrame, key: str = "customer_idx", item: Column | None = None) -> DataFrame:
    """``(key, prediction)``: the codes in order with blanks between."""
    code = item_code(F.col("article_id")) if item is None else item
    ordered = F.array_sort(F.collect_list(F.struct("rank", code.alias("c"))))
    return lists.groupBy(key).agg(ordered.alias("x")).select(key, F.array_join(F.transform("x", lambda s: s["c"]), " ").alias("prediction"))


def assemble(scored: DataFrame, fallback: DataFrame, users: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The best ``top_k`` of scored pairs ``(customer_idx, article_id, score)``, padded from the list of the user's
    cohort ``(cohort, article_id, rank)``, that of ``GLOBAL`` if there is none; all of ``users(customer_idx, age_bin)``."""
    best = top(scored, ["customer_idx"], [F.desc("score"), F.asc("article_id")], top_k, "pos").select("customer_idx", "article_id", F.lit(1).alias("level"), "pos")
    known = users.join(F.broadcast(fallback.select(F.col("cohort").alias("age_bin")).distinct()), "age_bin", "left_semi").unionByName(users.join(F.broadcast(fallback.select(F.col("cohort").alias("age_bin")).distinct()), "age_bin", "left_anti").withColumn("age_bin", F.lit(GLOBAL)))
    pad = known.join(F.broadcast(fallback.select(F.col("cohort").alias("age_bin"), "article_id", "rank")), "age_bin")
    rows = best.unionByName(pad.select("customer_idx", "article_id", F.lit(2).alias("level"), F.col("rank").alias("pos")))
    return first_wins(dealt(rows, users.count(), USERS, "customer_idx"), ["customer_idx"], top_k)


def serving_tables(tx: DataFrame, customers: DataFrame, history_days: int = 29, basket_days: int = 36, bestseller_days: int = 21, support: int = 3) -> dict[str, DataFrame]:
    """What an online service loads; windows one day longer and pairs up to twelve."""
    all_, cohort = bestsellers(tx, customers, bestseller_days, 0.12)
    both = cohort.where(F.col("age_bin").isin(AGE_LABELS)).unionByName(all_.withColumn("age_bin", F.lit("ALL")))
    hist = history(tx, history_days)
    return {
        "bestsellers": both.select("age_bin", "article_id", "score", "rank"),
        "affinity": basket_pairs(tx, basket_days, support, TOP_K, 0.85, weighted=True),
        "history": hist.where(F.col("pos") <= TOP_K).select("customer_idx", "article_id", "days_ago", F.col("pos").alias("purchase_rank")),
    }


#: The key by which a serving table is asked.
SERVED_BY = {"bestsellers": "age_bin", "affinity": "article_id", "history": "customer_idx"}


def save_serving(tables: dict[str, DataFrame], prefix: str, buckets: int = 64, folder: str | None = None) -> None:
    """The serving tables as tables ``{prefix}_{name}``, dealt to buckets by the key they are asked by and sorted in each, with Bloom
    filters of the key: a request reads the bucket of its key and the row groups that may hold it.  ``folder``: where the
    files are, the warehouse by default."""
    for name, df in tables.items():
        key = SERVED_BY[name]
        n = 1 if name == "bestsellers" else buckets  # at most 72 rows
        out = df.repartition(n, key).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", "true")
        (out.option("path", f"{folder}/{prefix}_{name}") if folder else out).saveAsTable(f"{prefix}_{name}")


def load_serving(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}_{name}") for name in SERVED_BY}


def lookup(tables: dict[str, DataFrame], customer: int, age_bin: str, top_k: int = TOP_K, offset: int = 0) -> DataFrame:
    """X2 for one customer: :func:`online` over the rows of the customer's key and of those of the items they have bought (at most
    ``TOP_K``, which are fetched first), so that no table is read whole."""
    own = tables["history"].where(F.col("customer_idx") == customer)
    items = [r.article_id for r in own.select("article_id").collect()]
    near = {"history": own, "affinity": tables["affinity"].where(F.col("article_id").isin(items)), "bestsellers": tables["bestsellers"].where(F.col("age_bin").isin(age_bin, "ALL"))}
    return online(near, own.sparkSession.createDataFrame([(customer, age_bin)], "customer_idx int, age_bin string"), top_k, offset)


def online(tables: dict[str, DataFrame], requests: DataFrame, top_k: int = TOP_K, offset: int = 0) -> DataFrame:
    """The lists of ``requests(customer_idx, age_bin)`` from the serving tables: own items, all complements by
    (own rank, pair rank), cohort, all; unknown cohorts get the list of ``ALL``.  A page of ``top_k`` from ``offset``."""
    hist = tables["history"].join(by_shuffle(requests.select("customer_idx").distinct()), "customer_idx", "left_semi")
    own = hist.select("customer_idx", "article_id", F.lit(1).alias("level"), F.col("purchase_rank").alias("pos"))
    pairs = tables["affinity"].select("article_id", "other", "r")
    found = hist.join(pairs, "article_id").select("customer_idx", F.col("other").alias("article_id"), F.lit(2).alias("level"), (F.col("purchase_rank") * 100 + F.col("r")).alias("pos"))
    best = F.broadcast(tables["bestsellers"].select("age_bin", "article_id", F.col("rank").alias("pos")))  # at most 72 rows
    cohort = requests.join(best, "age_bin").select("customer_idx", "article_id", F.lit(3).alias("level"), "pos")
    rest = requests.select("customer_idx").crossJoin(best.where("age_bin = 'ALL'").drop("age_bin")).select("customer_idx", "article_id", F.lit(4).alias("level"), "pos")
    rows = own.unionByName(found).unionByName(cohort).unionByName(rest)
    return first_wins(dealt(rows, requests.count(), USERS, "customer_idx"), ["customer_idx"], offset + top_k).where(F.col("rank") > offset)


def request_pipeline(tables: dict[str, DataFrame], requests: DataFrame, exclude: DataFrame, limit: int = TOP_K, offset: int = 0) -> DataFrame:
    """Source, hydrator, filter (``exclude(customer_idx, article_id)``), scorer, selector for a batch of requests."""
    sourced = online(tables, requests, top_k=100)
    kept = sourced.join(exclude, ["customer_idx", "article_id"], "left_anti")
    scored = kept.withColumn("score", F.round(F.lit(1.0) / F.col("rank"), 9))
    return top(scored, ["customer_idx"], [F.desc("score"), F.asc("article_id")], offset + limit, "position").where(F.col("position") > offset).select("customer_idx", "article_id", "score", "position", "level")


def contract(predictions: DataFrame, expected_rows: int, top_k: int = TOP_K, key: str = "customer_id") -> DataFrame:
    """P10: one row of counts that must be 0 (and the rows, which must be ``expected_rows``)."""
    items = F.split("prediction", " ")
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.lit(expected_rows)).alias("rows_off"),
        bad(F.col(key).isNull() | F.col("prediction").isNull())("nulls"),
        (F.count(key) - F.count_distinct(key)).alias("repeated_ids"),
        bad(~F.col(key).rlike("^[0-9a-f]{64}$"))("bad_ids"),
        bad(F.size(items) != top_k)("bad_lengths"),
        bad(F.size(F.array_distinct(items)) != F.size(items))("repeated_items"),
        bad(~F.forall(items, lambda i: i.rlike("^[0-9]{10}$")))("bad_items"),
    )
