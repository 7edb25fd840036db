import datetime as dt
import random

import pytest

from vitrina.functions.retail import age_bin_case, age_bin_cut
from vitrina.operators import waterfall as wf

DAY = dt.date(2020, 9, 22)


def loop(tx, ages, spec):
    """The cascade as a loop over users, from its definition."""
    ago = [((DAY - d).days, c, a) for d, c, a in tx]
    hist = {}
    for c in ages:
        own = {}
        for g, u, a in ago:
            if u == c and g < spec.personal_days:
                own.setdefault(a, []).append(g)
        hist[c] = sorted(own, key=lambda a: (min(own[a]), -len(own[a]), a)), {a: min(g) for a, g in own.items()}
    pairs = {}
    for g1, u1, a in ago:
        for g2, u2, b in ago:
            if u1 == u2 and g1 == g2 and a != b and g1 < spec.basket_days:
                w = pairs.setdefault(a, {}).setdefault(b, [0.0, 0])
                w[0] += spec.pair_decay ** ((g1 + g2) / 14) if spec.weighted else 1
                w[1] += 1
    best = {a: sorted(((-round(w, 12), b) for b, (w, n) in x.items() if n >= spec.support))[: spec.top_pairs] for a, x in pairs.items()}

    def top(rows):
        s = {}
        for g, a in rows:
            s[a] = s.get(a, 0) + spec.bestseller_decay ** (g / 7)
        return sorted(s, key=lambda a: (-round(s[a], 9), a))[:12]

    cohort = lambda age: "GLOBAL" if age is None else "<25" if age < 25 else "25-34" if age <= 34 else "35-44" if age <= 44 else "45-54" if age <= 54 else "55+"
    sold = [(g, c, a) for g, c, a in ago if g < spec.bestseller_days]
    world = top([(g, a) for g, _, a in sold])
    out = {}
    for c, age in ages.items():
        items, days = hist[c]
        preds = items[: spec.personal_cap]
        comps = []
        if spec.weighted:
            score = {}
            for a in items[: spec.base_items]:
                for w, b in best.get(a, []):
                    if b not in preds:
                        score[b] = score.get(b, 0) + spec.base_decay ** (days[a] / 7) * -w
            comps = sorted(score, key=lambda b: (-round(score[b], 12), b))
        else:
            for a in items:
                comps += [b for _, b in best.get(a, []) if b not in preds and b not in comps]
        preds = preds + comps[: spec.complement_cap]
        mine = top([(g, a) for g, u, a in sold if cohort(ages[u]) == cohort(age)]) if age is not None else []
        for a in mine + world:
            if a not in preds:
                preds.append(a)
        out[c] = preds[:12]
    return out


@pytest.mark.parametrize("name", ["v5", "v6", "v7", "v8"])
def test_equals_the_loop(spark, name):
    rng = random.Random(4)
    ages = {c: rng.choice([None, 19, 24, 25, 34, 35, 50, 70]) for c in range(1, 25)}
    tx = [(DAY - dt.timedelta(int(rng.random() ** 2 * 45)), c, int(rng.paretovariate(0.7)) % 40 + 1) for c in list(ages)[:20] for _ in range(rng.randint(1, 25))]
    tx += [(DAY, 1, 1)]
    spec = wf.Cascade(**{**wf.VERSIONS[name].__dict__, "support": 2})
    rows = [(d, c, a, 1.0, 1) for d, c, a in tx]
    df = spark.createDataFrame(rows, "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    got = wf.as_prediction(wf.cascade(df, spark.createDataFrame(list(ages.items()), "customer_idx int, age int"), spec)).collect()
    assert {r.customer_idx: [int(x) for x in r.prediction.split()] for r in got} == loop(tx, ages, spec)


def test_a_huge_basket_meets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(wf, "BASKET_ITEMS", 30)
    rng = random.Random(9)
    rows = [(1, 1, a, 1 + a % 3) for a in range(400)] + [(c, d, a, 1) for c in range(2, 30) for d in (1, 2) for a in {rng.randrange(50) for _ in range(rng.randint(1, 12))}]
    lines = spark.createDataFrame(rows, "customer_idx int, t_dat int, article_id int, n int").repartition(4)
    both = wf.within_baskets(lines, ["customer_idx", "t_dat"])
    found = sorted((r.customer_idx, r.t_dat, r.article_id, r.other, r.n, r.m) for r in both.collect())
    assert found == sorted((c, d, a, b, n, m) for c, d, a, n in rows for e, f, b, m in rows if (c, d) == (e, f) and a != b)


def test_lookup_of_one_customer_reads_one_bucket(spark, tmp_path, capsys):
    rng = random.Random(2)
    rows = [(DAY - dt.timedelta(rng.randrange(25)), c, rng.randrange(40), 1.0, 1) for c in range(300) for _ in range(rng.randint(1, 6))]
    tx = spark.createDataFrame(rows, "t_dat date, customer_idx int, article_id int, price double, sales_channel_id int")
    customers = spark.createDataFrame([(c, c % 70 if c % 70 > 15 else None) for c in range(301)], "customer_idx int, age int")
    tables = wf.serving_tables(tx, customers, support=2)
    try:
        wf.save_serving(tables, "served", buckets=16, folder=str(tmp_path))
        saved = wf.load_serving(spark, "served")
        bins = {r.customer_idx: r.b for r in customers.select("customer_idx", age_bin_case(customers.age).alias("b")).collect()}
        for c in (3, 17, 300):
            want = wf.online(tables, spark.createDataFrame([(c, bins[c])], "customer_idx int, age_bin string"), 10, 1)
            assert sorted(map(tuple, wf.lookup(saved, c, bins[c], 10, 1).collect())) == sorted(map(tuple, want.collect()))
        wf.lookup(saved, 3, bins[3]).explain("formatted")
        plan = capsys.readouterr().out
        assert plan.count("SelectedBucketsCount: 1 out of 16") >= 1 and "EqualTo(customer_idx,3)" in plan and "In(article_id" in plan or "EqualTo(article_id" in plan
        assert "SelectedBucketsCount: 16 out of 16" not in plan
    finally:
        for name in wf.SERVED_BY:
            spark.sql(f"DROP TABLE IF EXISTS served_{name}")


def test_age_bins_differ_at_the_edges(spark):
    df = spark.createDataFrame([(25,), (35,), (24,), (None,)], "age int")
    got = [tuple(r) for r in df.select(age_bin_cut(df.age), age_bin_case(df.age)).collect()]
    assert got == [("<25", "25-34"), ("25-34", "35-44"), ("<25", "<25"), (None, "GLOBAL")]


def test_assembly_pads_by_cohort(spark):
    scored = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.5)], "customer_idx int, article_id int, score double")
    lists = spark.createDataFrame([(c, base + i, i) for c, base in (("<25", 100), ("25-34", 200), ("GLOBAL", 300)) for i in range(1, 13)], "cohort string, article_id int, rank int")
    users = spark.createDataFrame([(1, "25-34"), (2, "<25"), (3, "GLOBAL"), (4, "no such")], "customer_idx int, age_bin string")
    got = {r.customer_idx: [int(x) for x in r.prediction.split()] for r in wf.as_prediction(wf.assemble(scored, lists, users)).collect()}
    assert got[1] == [7, 8, *range(201, 211)] and got[2] == list(range(101, 113)) and got[3] == got[4] == list(range(301, 313))


def test_contract_counts_each_fault(spark):
    good = " ".join(f"{i:010d}" for i in range(12))
    rows = [("a" * 64, good), (None, good), ("b" * 10, good), ("c" * 64, "0000000001 0000000002"), ("d" * 64, " ".join(["0000000001"] * 12)), ("a" * 64, None)]
    r = wf.contract(spark.createDataFrame(rows, "customer_id string, prediction string"), 6).first()
    assert (r.rows_off, r.nulls, r.repeated_ids, r.bad_ids, r.bad_lengths, r.repeated_items, r.bad_items) == (0, 2, 1, 1, 1, 1, 0)
