import datetime as dt

import pytest

from vitrina.operators import recall

# Day of March 2021, user, item, price, channel; the last day is the 31st, day -18 is the 10th of February.
ROWS = [(31, 11, 7, 12.0, 1), (30, 11, 8, 20.0, 1), (22, 11, 7, 12.0, 1), (29, 12, 8, 20.0, 2), (29, 12, 9, 5.0, 2), (12, 12, 5, 7.5, 2),
        (31, 13, 9, 5.0, 2), (24, 13, 6, 9.0, 1), (23, 13, 9, 5.0, 2), (-18, 14, 5, 7.5, 1)]


@pytest.fixture(scope="module")
def tx(spark):
    rows = [(dt.date(2021, 3, 1) + dt.timedelta(d - 1), *r) for d, *r in ROWS]
    return spark.createDataFrame(rows, "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int").cache()


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(11, "1f" * 32, 19, "<25"), (12, "2e" * 32, 33, "25-34"), (13, "3d" * 32, 33, "25-34"), (14, "4c" * 32, 60, "55+")], "customer_idx int, customer_id string, age int, age_bin string")


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(5, 40), (6, 40), (7, 41), (8, 41), (9, 42)], "article_id int, department_no int")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.customer_idx, r.rank_in_source, r.article_id)):
        out.setdefault(r.customer_idx, []).append(r.article_id)
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_r1_latest_then_most_then_smallest(tx, k):
    want = {11: [7, 8], 12: [8, 9, 5], 13: [9, 6], 14: [5]}
    assert lists(recall.repurchase(tx, k)) == {u: x[:k] for u, x in want.items()}


@pytest.mark.parametrize(("rate", "want"), [(0.0, [9, 5, 7]), (0.1, [9, 8, 7])])
def test_r2_reaches_all_users(tx, rate, want):
    assert lists(recall.popular_global(tx, rate, 3)) == dict.fromkeys((11, 12, 13, 14), want)


def test_r3_to_r8(tx, customers, articles):
    assert lists(recall.popular_age(tx, customers)) == {11: [7, 8], 12: [9, 5, 6, 8], 13: [9, 5, 6, 8], 14: [5]}
    assert lists(recall.popular_channel(tx)) == {11: [7, 5, 6, 8], 12: [9, 5, 8], 13: [9, 5, 8], 14: [7, 5, 6, 8]}
    assert lists(recall.item_cf(tx)) == {11: [8, 7, 9], 12: [6, 7, 8, 9], 13: [6, 8, 9]}
    assert lists(recall.product_family(tx, articles)) == {11: [7, 8], 12: [5, 7, 6, 8], 13: [5, 9, 6], 14: [5, 6]}
    assert lists(recall.trending(tx, min_support=1)) == dict.fromkeys((11, 12, 13, 14), [8, 9, 7])
    assert lists(recall.dept_popular(tx, articles)) == {11: [8, 7], 12: [6], 13: [9], 14: [6]}


def test_r5_counts_repeats_and_bounds_rows(spark):
    rows = [(dt.date(2020, 9, 20), 1, a, 1.0, 1) for a in (1, 1, 2)] + [(dt.date(2020, 9, 1), 1, 9, 1.0, 1)]
    tx = spark.createDataFrame(rows, "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    got = {r.article_id: r.rank_in_source for r in recall.item_cf(tx).collect()}
    assert got == {2: 1, 1: 2}  # 2 x 2 pairs (1, 2) by two seeds, 2 pairs (2, 1) by one; day 19 is outside
    assert recall.item_cf(tx, per_user=1).count() == 0


def test_trending_window_ends_at_the_last_day(spark):
    m = dt.date(2020, 9, 22)
    rows = [(m - dt.timedelta(d), 1, 201, 1.0, 1) for d in (1, 2, 3, 4)] + [(m - dt.timedelta(10), 1, 202, 1.0, 1)]
    tx = spark.createDataFrame(rows, "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    assert [r.article_id for r in recall.trending(tx).collect()] == [201]


def test_pool(tx, customers, articles):
    pool = recall.consolidate(recall.all_sources(tx, customers, articles, min_support=1))
    rows = pool.collect()
    assert pool.columns == ["customer_idx", "article_id", "best_rank", "n_sources", *(f"is_R{i}" for i in range(1, 9))]
    assert len({(r.customer_idx, r.article_id) for r in rows}) == len(rows)
    assert all(r.best_rank >= 1 and r.n_sources == sum(r[f"is_R{i}"] for i in range(1, 9)) for r in rows)
    own = {(r.customer_idx, r.article_id) for r in recall.repurchase(tx).collect()}
    assert {(r.customer_idx, r.article_id) for r in rows if r.is_R1} == own
    assert recall.consolidate([recall.repurchase(tx)], max_per_user=1).count() == 4


def test_fallbacks_are_padded_codes(tx, customers):
    assert recall.as_codes(recall.fallback(tx, top_k=4), "cohort").first().items == "0000000009 0000000008 0000000007 0000000005"
    cohorts = {r.cohort for r in recall.fallback_cohorts(tx, customers).collect()}
    assert cohorts == {"<25", "25-34", "55+"}


def test_missing_columns_raise_and_empty_tables_give_none(tx):
    with pytest.raises(Exception, match="t_dat"):
        recall.repurchase(tx.drop("t_dat")).count()
    assert recall.popular_global(tx.limit(0)).count() == 0 and recall.item_cf(tx.limit(0)).count() == 0
