"""What the driver and the disk hold does not follow the size of the tables' files, the number of lists or that of tasks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vitrina.operators import ablation, features, ranking, recall, waterfall
from vitrina.plans import queries
from vitrina.sources import scratch
from vitrina.sources.tables import Retail


@pytest.fixture(scope="module")
def r(spark, data_dir):
    return Retail(spark, data_dir)


def test_compared_cascades_shuffle_each_pair_of_a_basket_once(r, monkeypatch):
    rows, deal = [], recall.dealt

    def dealt(df, count, most, *by):
        if by == ("article_id", "other"):
            rows.append(df.count())
        return deal(df, count, most, *by)

    monkeypatch.setattr(waterfall, "dealt", dealt)
    waterfall.made_once(r.tx, r.customers, [queries.V5, queries.V6, queries.V7, queries.V8])
    a = r.tx.select("customer_idx", "t_dat", "article_id").distinct()
    pairs = a.join(a.withColumnRenamed("article_id", "other"), ["customer_idx", "t_dat"]).where("article_id < other").count()
    assert rows == [pairs] and pairs


def test_pairs_of_huge_and_small_baskets_and_of_no_customer(spark, monkeypatch):
    monkeypatch.setattr(waterfall, "BASKET_ITEMS", 30)
    rng = random.Random(3)
    rows = [(1, 1, a % 300) for a in range(330)] + [(c, d, rng.randrange(40)) for c in range(2, 30) for d in (1, 2) for _ in range(rng.randint(1, 12))] + [(None, 1, 5), (None, 1, 6), (2, 1, None)]
    tx = spark.createDataFrame(rows, "customer_idx int, d int, article_id int").withColumn("t_dat", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    want = {}
    for i, (c, d, a) in enumerate(rows):
        for e, f, b in rows[i + 1 :]:
            if c is not None and (c, d) == (e, f) and a is not None and b is not None and a != b:
                pair = min(a, b), max(a, b)
                n, w = want.get(pair, (0, 0.0))
                want[pair] = n + 1, w + 0.5 ** (2 * (2 - d) / 14)
    found = waterfall.met_pairs(tx, 100, 1, 0.5).collect()
    assert {(x.article_id, x.other): x.support for x in found} == {p: n for p, (n, _) in want.items()}
    assert all(abs(x.decayed - want[x.article_id, x.other][1]) < 1e-9 for x in found)


def test_tables_that_grow_are_not_broadcast_for_their_small_files(r, spark):
    """Spark goes by the size of compressed files; 12 kB is between those of customers and items and those of purchases."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        train = queries.parts(r).train
        plans = {
            "pool": recall.candidates(train, queries.binned(r), r.articles, min_support=2),
            "padding": recall.fallback_cohorts(train, r.customers),
            "profiles": features.profiles(train, r.articles),
            "facts": features.item_facts(train, r.articles, features.article_features(train, r.articles)),
            "best": waterfall.bestsellers(r.tx, r.customers, 364, 0.12)[1],
            "requests": waterfall.online(queries.serving(r), queries.requests(r)),
        }
        for name, df in plans.items():
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert not re.search(r"BroadcastHashJoin \[(customer_idx|article_id)#\d+\],", plan), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_lists_of_a_window_are_written_before_the_next(r, monkeypatch):
    made = []

    def kept(df, name):
        made.append({x.variant for x in df.select("variant").distinct().collect()})
        return scratch.kept(df, name)

    monkeypatch.setattr(ablation, "kept", kept)
    found = ablation.by_window(r.tx, queries.binned(r), r.articles, (13, 26), 28, min_support=2).collect()
    assert made == [{"A1_13w"}, {"A1_26w"}] and {x.variant for x in found} == {"A1_13w", "A1_26w"}


def test_the_ranker_has_a_task_for_each_block(spark, monkeypatch):
    """The driver merges a histogram for each of a few tasks, whatever the session's partitions."""
    rng = random.Random(5)
    rows = [(u, a, int(rng.random() < 0.3), rng.random()) for u in range(60) for a in range(10)]
    df = spark.createDataFrame(rows, "customer_idx int, article_id int, target int, x double")
    ranker = ranking.LambdaRanker(["x"], rounds=1)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 100)
    packed = ranker._packed(df, ranker.edges(df))
    assert packed.select(F.input_file_name()).distinct().count() == 6
    n = spark.sparkContext.parallelize(range(32), 32)
    group = "histograms"
    spark.sparkContext.setJobGroup(group, group)
    assert ranking._merged(n.map(lambda x: (x,))) == (496,)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert min(s.numTasks for s in stages if s) <= 10
