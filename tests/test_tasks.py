"""What a task holds does not grow with the tables: rows are dealt to as many tasks as they ask for, with the same results."""

from collections import Counter

import pytest

from vitrina.operators import features, metrics, recall, split, waterfall
from vitrina.plans import queries
from vitrina.sources.tables import Retail


@pytest.fixture(scope="module")
def r(spark, data_dir):
    return Retail(spark, data_dir)


@pytest.fixture(scope="module")
def pool(r):
    return recall.candidate_pool(queries.parts(r).train, queries.binned(r), r.articles, min_support=2).cache()


def same(a, b):
    assert a.columns == b.columns
    return Counter(map(repr, a.collect())) == Counter(map(repr, b.collect()))


def test_the_pool_is_merged_where_the_customers_are(r, pool, monkeypatch):
    monkeypatch.setattr(recall, "USERS", 10)
    train = queries.parts(r).train
    found = recall.candidate_pool(train, queries.binned(r), r.articles, min_support=2)
    assert found.rdd.getNumPartitions() == -(-r.customers.count() // 10)
    assert same(found, recall.consolidate(recall.all_sources(train, queries.binned(r), r.articles, min_support=2)))


def test_features_of_popular_items_come_to_the_pairs(r, pool, monkeypatch):
    """No item's pairs meet in one task, and the matrix is the same with and without popular items."""
    train, tables = queries.parts(r).train, (r.customers, r.articles)
    plain = features.matrix(pool, train, *tables)
    monkeypatch.setattr(features, "POPULAR", 20)
    monkeypatch.setattr(features, "PAIRS", 500)
    found = features.matrix(pool, train, *tables)
    assert pool.groupBy("article_id").count().where("count >= 20").count() > 20
    assert found.rdd.getNumPartitions() == -(-pool.count() // 500)
    assert same(queries.nudged(found), queries.nudged(plain))


def test_labels_are_dealt_by_the_number_of_pairs(r, pool, monkeypatch):
    monkeypatch.setattr(split, "PAIRS", 500)
    held = queries.parts(r).validation
    found = split.label(pool, held, pool.count())
    assert found.rdd.getNumPartitions() == -(-pool.count() // 500)
    bought = {(x.customer_idx, x.article_id) for x in held.collect()}
    assert {(x.customer_idx, x.article_id): x.target for x in found.collect()} == {(x.customer_idx, x.article_id): int((x.customer_idx, x.article_id) in bought) for x in pool.collect()}


def test_tasks_of_basket_pairs_follow_their_number(r, monkeypatch):
    plain = waterfall.basket_pairs(r.tx, 2800, 1, 8, 0.85, True).collect()
    seen = []
    deal = recall.dealt

    def dealt(rows, count, most, *by):
        out = deal(rows, count, most, *by)
        seen.append((by, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(waterfall, "dealt", dealt)
    monkeypatch.setattr(waterfall, "BASKET_PAIRS", 1000)
    assert sorted(waterfall.basket_pairs(r.tx, 2800, 1, 8, 0.85, True).collect()) == sorted(plain)
    sizes = Counter((x.customer_idx, x.t_dat) for x in r.tx.collect())
    assert len(seen) == 4 and {n for _, n in seen} == {-(-sum(n * n for n in sizes.values()) // 1000)}


def test_variants_without_truth_have_a_row(spark):
    none = spark.createDataFrame([], "user int, item int")
    shown = spark.createDataFrame([("a", 1, 5, 1)], "variant string, user int, item int, rank int")
    assert {(x.variant, x.users, x.coverage) for x in metrics.evaluate_variants(none, shown, ("a", "b")).collect()} == {("a", 0, 1.0), ("b", 0, None)}
