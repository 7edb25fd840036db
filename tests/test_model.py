import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import ablation, audit, features, ranking, split, versions
from vitrina.operators.ranking import LambdaRanker
from vitrina.plans import queries
from vitrina.sources.tables import Retail


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for u in range(60):
        x = rng.random((12, 3))
        y = x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.random(12)
        best = set(np.argsort(-y)[:2].tolist())
        out += [(u, i, int(i in best), *map(float, x[i])) for i in range(12)]
    return spark.createDataFrame(out, "customer_idx int, article_id int, target int, a double, b double, c double").cache()


@pytest.mark.parametrize("loss", ["pairwise", "pointwise"])
def test_ranker_learns_and_reloads(spark, rows, loss):
    ranker = LambdaRanker(["a", "b", "c"], rounds=4, depth=3, loss=loss).fit(rows)
    assert ranker.losses[-1] < ranker.losses[0]
    gains = {r.feature: r.gain_pct for r in ranker.importance(spark).collect()}
    assert sum(gains.values()) == pytest.approx(100, abs=0.01) and gains["a"] > gains["c"]
    again = LambdaRanker.loads(ranker.dumps())
    key = lambda r: (r.customer_idx, r.article_id)
    scores = {key(r): r.score for r in ranker.score(rows).collect()}
    assert scores == {key(r): r.score for r in again.score(rows).collect()}
    for r in ranker.shap(rows).collect():
        assert r.base + sum(r.phi) == pytest.approx(scores[key(r)], abs=1e-6)


def test_registered_rankers_have_the_production_size(spark, data_dir, monkeypatch):
    seen = []

    def fit(self, rows):
        seen.append((self.rounds, self.depth, self.leaves, self.rate, self.least, self.row_share, self.column_share))
        return self

    monkeypatch.setattr(LambdaRanker, "fit", fit)
    queries.trained(Retail(spark, data_dir))
    queries.QUERIES["ablation_ranker"](spark, data_dir)
    assert len(seen) > 3 and set(seen) == {(50, 7, 63, 0.05, 30, 0.8, 0.8)}


def test_leaves_are_capped_by_gain(rows):
    whole, capped = (LambdaRanker(["a", "b", "c"], rounds=1, depth=7, leaves=k).fit(rows).trees[0] for k in (None, 9))

    def splits(t):
        return [t["gain"], *splits(t["left"]), *splits(t["right"])] if "left" in t else []

    assert len(splits(whole)) > 8 and len(splits(capped)) == 8
    assert set(splits(capped)) <= set(splits(whole)) and max(splits(whole)) in splits(capped)


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(5)

    def grow(depth, cover):
        if not depth:
            return {"value": float(rng.normal()), "cover": cover}
        part = cover * float(rng.uniform(0.1, 0.9))
        return {"value": 0.0, "cover": cover, "feature": int(rng.integers(5)), "at": float(rng.random()), "left": grow(depth - 1, part), "right": grow(depth - 1, cover - part)}

    tree, x = grow(4, 1e6), rng.random((6, 5))
    phi = np.zeros((6, 5))
    base = ranking._shap(tree, x, phi, 1.0)

    def expected(t, row, known):
        if "left" not in t:
            return t["value"]
        if t["feature"] in known:
            return expected(t["left" if row[t["feature"]] <= t["at"] else "right"], row, known)
        return sum(t[s]["cover"] / t["cover"] * expected(t[s], row, known) for s in ("left", "right"))

    for row, own in zip(x, phi, strict=True):
        assert base == pytest.approx(expected(tree, row, set()))
        for i in range(5):
            rest = [j for j in range(5) if j != i]
            want = sum(factorial(len(c)) * factorial(4 - len(c)) / 120 * (expected(tree, row, {*c, i}) - expected(tree, row, set(c))) for m in range(5) for c in combinations(rest, m))
            assert own[i] == pytest.approx(want, abs=1e-9)


def tx_of(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), *r) for d, *r in rows], "t_dat date, customer_idx int, article_id int")


def test_splits_and_leaks(spark):
    day = dt.date(2024, 3, 1)
    tx = tx_of(spark, [(str(day + dt.timedelta(i // 3)), i % 10, 100 + i % 20) for i in range(84)])
    s = split.temporal(tx)
    assert s.train.count() + s.validation.count() == 84 and s.validation.count() == 21
    assert split.leakage(s.train, s.validation).first().leaks == 0
    split.require_no_leakage(s.train, s.validation)
    with pytest.raises(ValueError, match="rows are not before"):
        split.require_no_leakage(tx, s.validation)
    parts = split.rolling(tx, 7, 7)
    assert [parts[k].count() for k in ("val_target", "val_features", "train_target", "train_features")] == [21] * 4
    truth = split.ground_truth(s.validation, spark.createDataFrame([(1,), (99,)], "customer_idx int")).collect()
    assert {r.customer_idx: len(r["items"]) for r in truth}[99] == 0


def test_training_rows_keep_positives_and_ratio(rows):
    got = split.training_rows(rows, ratio=2).groupBy("customer_idx", "target").count().collect()
    assert {r["count"] for r in got if r.target == 1} == {2} and {r["count"] for r in got if r.target == 0} == {4}
    a = split.training_rows(rows, 2, seed=1).collect()
    assert sorted(a) == sorted(split.training_rows(rows, 2, seed=1).collect()) != sorted(split.training_rows(rows, 2, seed=2).collect())


def test_user_and_article_features(spark):
    tx = spark.createDataFrame([(dt.date(2020, 9, 20), 1, 101, 0.02, 2), (dt.date(2020, 9, 15), 1, 101, 0.04, 1), (dt.date(2020, 8, 1), 2, 102, 0.03, 1)], "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    customers = spark.createDataFrame([(1, 22, "ACTIVE", "Regularly"), (2, None, "PRE-CREATE", "Monthly"), (4, None, None, None)], "customer_idx int, age int, club_member_status string, fashion_news_frequency string")
    u = {r.customer_idx: r for r in features.user_features(tx, customers).collect()}
    assert (u[1].u_total_transactions, u[1].u_club_status, u[1].u_fashion_news, u[1].u_online_ratio, u[1].u_last_purchase_days_ago) == (2, 1, 2, 0.5, 0)
    assert (u[2].u_age, u[2].u_std_price, u[4].u_total_transactions, u[4].u_last_purchase_days_ago, u[4].u_club_status) == (32, 0.0, 0, 999, 0)
    articles = spark.createDataFrame([(101, 1, 1, 1, 7), (102, 1, None, 1, 7), (999, 2, 2, 2, None)], "article_id int, product_type_no int, graphical_appearance_no int, colour_group_code int, department_no int")
    a = {r.article_id: r for r in features.article_features(tx, articles).collect()}
    assert (a[101].a_sales_count, a[101].a_is_recent_introduction, a[102].a_is_recent_introduction, a[102].a_graphical_appearance_no) == (2, 1, 0, -1)
    assert (a[999].a_sales_count, a[999].a_department_no) == (0, -1) and a[999].a_mean_price == pytest.approx(0.03)


def test_mapping_is_dense_and_ordered(spark):
    ids = spark.createDataFrame([(f"{i * 37 % 101:064d}",) for i in range(101)] * 2, "customer_id string")
    got = {r.customer_id: r.customer_idx for r in audit.customer_mapping(ids).collect()}
    assert got == {c: i for i, c in enumerate(sorted(got))} and len(got) == 101


def test_pareto_keeps_what_nothing_beats(spark):
    df = spark.createDataFrame([("x", 0.0195, 350, 0.15), ("y", 0.0210, 450, 0.22), ("z", 0.0180, 460, 0.25)], "id string, map double, mb int, s double")
    assert {r.id for r in audit.pareto(df, ["map"], ["mb", "s"], "id").collect()} == {"x", "y"}


def test_dense_ids_of_random_hexadecimal(spark):
    import hashlib

    ids = [hashlib.sha256(str(i % 900).encode()).hexdigest() for i in range(1200)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "customer_id string").repartition(7)
    got = {r.customer_id: r.customer_idx for r in audit.customer_mapping(df).collect()}
    assert got == {c: k for k, c in enumerate(sorted(set(ids)))}
    assert audit.customer_mapping(df.limit(0)).count() == 0


def test_frontier_in_blocks(spark):
    import random

    rng = random.Random(4)
    rows = [(k, rng.randrange(60), rng.randrange(60), rng.randrange(60)) for k in range(800)]
    want = {a[0] for a in rows if not any(b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and b[1:] != a[1:] for b in rows)}
    df = spark.createDataFrame(rows, "k int, gain int, cost int, time int")
    for most in (10_000, 40):
        assert {r.k for r in audit.pareto(df, ["gain"], ["cost", "time"], "k", most).collect()} == want


def test_frontier_of_partitions(spark):
    """Random, all-equal and opposed objectives: the merged frontiers equal the definition; a large frontier too."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.integers(0, 30, (500, 3)), np.full((50, 3), 29), np.c_[np.arange(300), 300 - np.arange(300), np.zeros(300, int)]]).astype(float)
    want = [not any((b >= a).all() and (b > a).any() for b in x) for a in x]
    assert sorted(audit.frontier(x, 37).tolist()) == np.flatnonzero(want).tolist()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(9999, None, 0.0, 0.0)], "k int, a double, b double, c double").repartition(9)
    for most in (10_000, 400, 50):
        assert {r.k for r in audit.pareto(df, ["a", "b", "c"], [], "k", most).collect()} == {*np.flatnonzero(want).tolist(), 9999}


def test_strata_are_limited_without_a_sort(spark):
    tx = spark.createDataFrame([(dt.date(2021, 3, 1), c, c) for c in range(300) for _ in range(1 + c % 9)], "t_dat date, customer_idx int, article_id int")
    got = audit.stratified_sample(tx, 40, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 4 and "Window" not in plan and " Sort " not in plan
    assert {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()} == {1: 16, 2: 14, 3: 7, 4: 3}


def test_catalog_lookup_and_statistics(spark):
    articles = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "article_id int, kind string")
    files = spark.createDataFrame([(1,), (2,), (2,), (9,)], "article_id int")
    r = audit.catalog(articles, files, ["kind"]).first()
    assert (r["values"], r.nulls, r.files, round(r.coverage, 3)) == (1, 1, 2, 0.667)
    assert {(r.article_id, r.kind, r.has_file) for r in audit.lookup(articles, [2, 3, 7], files).collect()} == {(2, None, True), (3, "a", False), (7, None, False)}


def test_versions_and_experiments(spark):
    import datetime as dt

    tx = spark.createDataFrame([(dt.date(2021, 3, 1) + dt.timedelta(i % 40), i % 9, i * 5 % 23, 1.0 + i % 3, 1 + i % 2) for i in range(700)], "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    customers = spark.createDataFrame([(i, f"{i:064x}", 20 + 4 * i, None, None) for i in range(9)], "customer_idx int, customer_id string, age int, club_member_status string, fashion_news_frequency string")
    scored = tx.select("customer_idx", "article_id").distinct().withColumn("score", F.col("article_id").cast("double"))
    for version in ("v1", " V2", "v5", "v8"):
        rows = versions.predict(version, tx, customers, lambda: scored).collect()
        assert len(rows) == 9 and all(len(r.prediction.split(" ")) == 12 for r in rows)
    best = {r.customer_idx: r.prediction.split(" ")[0] for r in versions.predict("v4", tx, customers, lambda: scored).collect()}
    assert best == {r.customer_idx: f"{r.m:010d}" for r in tx.groupBy("customer_idx").agg(F.max("article_id").alias("m")).collect()}
    with pytest.raises(ValueError, match="v9"):
        versions.lists("v9", tx, customers)
    with pytest.raises(ValueError, match="A7"):
        ablation.run("A7", tx, customers, None)
    assert {r.variant for r in ablation.run("A6", tx, customers, None, below=5).collect()} == {"v5", "v6", "v7", "v8"}
    with_ages = customers.withColumn("age_bin", F.lit("<25"))
    articles = spark.createDataFrame([(i, i % 4) for i in range(23)], "article_id int, department_no int")
    assert {r.variant for r in ablation.run("A1", tx, with_ages, articles, weeks=(2, 4)).collect()} == {"A1_2w", "A1_4w"}


def test_gradients_by_definition():
    rng = np.random.default_rng(8)
    users, s, y, item = np.array([2, 7, 30, 1]), rng.integers(0, 4, 40) / 3.0, rng.integers(0, 2, 40).astype(float), rng.permutation(40)
    g, h, (loss, n) = ranking.gradients(users, s, y, item)
    want_g, want_h, losses, start = np.zeros(40), np.zeros(40), [], 0
    for size in users:
        own, pairs = range(start, start + size), []
        start += size
        order = sorted(own, key=lambda i: (-s[i], item[i]))
        gain = {i: 1 / np.log2(place + 2) for place, i in enumerate(order)}
        ideal = sum(1 / np.log2(p + 2) for p in range(int(sum(y[i] for i in own))))
        for i in own:
            for j in own:
                if y[i] == 1 and y[j] == 0:
                    p = 1 / (1 + np.exp(s[i] - s[j]))
                    w = abs(gain[i] - gain[j]) / ideal
                    want_g[i] += w * p
                    want_g[j] -= w * p
                    want_h[i] += w * p * (1 - p)
                    want_h[j] += w * p * (1 - p)
                    pairs.append(np.log(1 + np.exp(-(s[i] - s[j]))))
        if pairs:
            losses.append(np.mean(pairs))
    assert np.allclose(g, want_g) and np.allclose(h, want_h) and n == len(losses) and np.isclose(loss, sum(losses))


def replica(users, item, y, key, x, edges, rounds, depth, leaves, least, rate, row_share, column_share, seed):
    """The boosted trees as loops over rows and thresholds, from their definition: ``(value by row, tree sizes)``."""
    s, sizes = np.zeros(len(y)), []
    for n in range(rounds):
        g, h, _ = ranking.gradients(users, s, y, item)
        seen = ranking.drawn(key, row_share, seed, n)
        columns = sorted(np.random.default_rng([seed, n]).permutation(x.shape[1])[: round(column_share * x.shape[1])])

        def best(rows):
            out = None
            for j in columns:
                for t in edges[j]:
                    left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if len(left) >= least and len(right) >= least and h[left].sum() >= 1e-3 and h[right].sum() >= 1e-3:
                        gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                        if gain > 1e-12 and (out is None or gain > out[0] + 1e-12):
                            out = gain, j, t, left, right
            return out

        open_, step = [(np.flatnonzero(seen), 0, np.arange(len(y)))], np.zeros(len(y))
        while True:  # the open leaf of the largest gain is split first
            at = [i for i, leaf in enumerate(open_) if leaf[1] < depth and best(leaf[0])]
            if not at or len(open_) >= leaves:
                break
            i = max(at, key=lambda i: best(open_[i][0])[0])
            rows, d, every = open_.pop(i)
            _, j, t, left, right = best(rows)
            open_ += [(left, d + 1, every[x[every, j] <= t]), (right, d + 1, every[x[every, j] > t])]
        for rows, _, every in open_:
            step[every] = rate * g[rows].sum() / h[rows].sum()
        s = s + step
        sizes.append(len(open_))
    return s, sizes


@pytest.mark.parametrize("shares", [(1.0, 1.0), (0.7, 0.6)])
def test_five_trees_equal_a_replica(spark, monkeypatch, shares):
    monkeypatch.setattr(ranking, "CUT", 2)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(11)
    rows = [(u, i, int(rng.random() < 0.3), *map(float, np.round(rng.random(5), 1))) for u in range(40) for i in range(int(rng.integers(1, 15)))]
    names = list("abcde")
    df = spark.createDataFrame(rows, "customer_idx int, article_id int, target int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    size = {"rounds": 5, "depth": 3, "leaves": 6, "rate": 0.3, "least": 8}
    ranker = LambdaRanker(names, **size, row_share=shares[0], column_share=shares[1]).fit(df)
    keyed = df.select("*", F.xxhash64(*ranking.KEYS).alias("key")).orderBy("customer_idx", "article_id").toPandas()
    x, users = keyed[names].to_numpy(), keyed.groupby("customer_idx").size().to_numpy()
    want, sizes = replica(users, keyed.article_id.to_numpy(), keyed.target.to_numpy().astype(float), keyed.key.to_numpy().view(np.uint64), x, ranker.edges(df), **size, row_share=shares[0], column_share=shares[1], seed=42)
    got = {(r.customer_idx, r.article_id): r.score for r in ranker.score(df).collect()}
    assert [sum("left" not in n for n in ranking._nodes(t)) for t in ranker.trees] == sizes and max(sizes) > 2
    assert np.allclose([got[k] for k in zip(keyed.customer_idx, keyed.article_id, strict=True)], want, atol=1e-7)


def test_evaluation_stops_early_and_keeps_the_best(spark, rows):
    held = rows.withColumn("target", (F.rand(3) < 0.2).cast("int"))  # nothing to learn here
    ranker = LambdaRanker(["a", "b", "c"], rounds=30, depth=3).fit(rows, held, patience=3)
    assert len(ranker.scores) < 30 and len(ranker.trees) == int(np.argmax(ranker.scores)) + 1
    assert len(ranker.scores) - len(ranker.trees) == 3
    again = {(r.customer_idx, r.article_id): r.score for r in ranker.score(held).collect()}
    by_user: dict = {}
    for r in held.collect():
        by_user.setdefault(r.customer_idx, []).append((-again[r.customer_idx, r.article_id], r.article_id, r.target))
    ap = []
    for own in by_user.values():
        hit = [t for *_, t in sorted(own)]
        if sum(hit):
            ap.append(sum(sum(hit[: i + 1]) / (i + 1) for i in range(min(12, len(hit))) if hit[i]) / min(sum(hit), 12))
    assert np.isclose(max(ranker.scores), np.mean(ap))


def test_no_rows_give_no_trees(spark, rows):
    ranker = LambdaRanker(["a", "b", "c"], rounds=3).fit(rows.limit(0))
    assert not ranker.trees and {r.score for r in ranker.score(rows).collect()} == {0.0}
