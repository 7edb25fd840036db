"""The same results as SQL, written from the definitions and not from the plans: row form, no arrays
(lists are ordered string aggregates), windows where the operators use pre-aggregation."""

from __future__ import annotations

import re

VIEWS = """
tx AS (SELECT CAST(o_orderdate AS DATE) AS t_dat, CAST(o_custkey AS INT) AS customer_idx, CAST(l_partkey AS INT) AS article_id,
    l_extendedprice AS price, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS sales_channel_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cust0 AS (SELECT CAST(c_custkey AS INT) AS customer_idx, lpad(CAST(c_custkey AS VARCHAR), 64, '0') AS customer_id,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(16 + FLOOR(c_acctbal / 10000 * 64) AS INT) END AS age,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ACTIVE' WHEN 'BUILDING' THEN 'PRE-CREATE' WHEN 'FURNITURE' THEN 'LEFT CLUB' WHEN 'HOUSEHOLD' THEN NULL ELSE 'OTHER' END AS club_member_status,
    CASE c_nationkey % 3 WHEN 0 THEN 'Regularly' WHEN 1 THEN 'Monthly' ELSE 'NONE' END AS fashion_news_frequency FROM customer),
cust AS (SELECT *, CASE WHEN age < 25 THEN '<25' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' WHEN age IS NOT NULL THEN '55+' ELSE 'GLOBAL' END AS age_bin FROM cust0),
cut_age AS (SELECT customer_idx, COALESCE(CAST(age AS DOUBLE), (SELECT MEDIAN(age) FROM cust0)) AS age FROM cust0),
cut_bin AS (SELECT customer_idx, age, CASE WHEN age <= 25 THEN '<25' WHEN age <= 35 THEN '25-34' WHEN age <= 45 THEN '35-44' WHEN age <= 55 THEN '45-54' ELSE '55+' END AS age_bin FROM cut_age),
art AS (SELECT CAST(p_partkey AS INT) AS article_id, CAST(SUBSTR(p_brand, 7) AS INT) AS department_no, p_type AS garment_group_name, CAST(LENGTH(p_type) % 7 AS INT) AS product_type_no,
    CAST(p_size AS INT) AS graphical_appearance_no, CAST(p_size % 10 AS INT) AS colour_group_code FROM part),
m AS (SELECT MAX(t_dat) AS m FROM tx),
aged AS (SELECT tx.*, DATEDIFF('day', t_dat, m.m) AS days_ago FROM tx, m),
recent AS (SELECT * FROM aged WHERE days_ago < 364),
train AS (SELECT t_dat, customer_idx, article_id, price, sales_channel_id, days_ago - 28 - (SELECT MIN(days_ago) - 28 FROM aged WHERE days_ago >= 28) AS days_ago FROM aged WHERE days_ago >= 28 AND days_ago < 392),
val AS (SELECT * FROM aged WHERE days_ago < 28)
"""


TELEMETRY_RECENT = "SELECT (SELECT COUNT(*) FROM events) AS requests, (SELECT COUNT(*) FROM events WHERE event_type = 'error') AS errors, COUNT(*) AS measured, ROUND(QUANTILE_CONT(value, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(value, 0.95), 6) AS p95, ROUND(QUANTILE_CONT(value, 0.99), 6) AS p99 FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)"


def recall_sql(t: str, p: str, cf_days: int = 14, trend: int = 2, dept_days: int = 7) -> str:
    """CTEs ``{p}r1`` to ``{p}r8`` of the rows ``t`` (with ``days_ago``)."""
    rn = "ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {o})"
    users = f"(SELECT DISTINCT customer_idx FROM {t})"
    return f"""
{p}r1 AS (SELECT customer_idx, article_id, 'R1_repurchase' AS source, r FROM (SELECT *, {rn.format(by='customer_idx', o='last DESC, n DESC, article_id')} AS r
    FROM (SELECT customer_idx, article_id, MAX(t_dat) AS last, COUNT(*) AS n FROM {t} GROUP BY ALL)) WHERE r <= 24),
{p}i2 AS (SELECT article_id, ROW_NUMBER() OVER (ORDER BY s DESC, article_id) AS r FROM (SELECT article_id, ROUND(SUM(EXP(-0.1::DOUBLE * days_ago / 7.0::DOUBLE)), 9) AS s FROM {t} GROUP BY ALL)),
{p}r2 AS (SELECT customer_idx, article_id, 'R2_popular_global' AS source, r FROM {users}, {p}i2 WHERE r <= 20),
{p}i3 AS (SELECT *, {rn.format(by='age_bin', o='n DESC, article_id')} AS r FROM (SELECT age_bin, article_id, COUNT(*) AS n FROM {t} JOIN cut_bin USING (customer_idx) GROUP BY ALL)),
{p}r3 AS (SELECT customer_idx, article_id, 'R3_popular_age' AS source, r FROM cut_bin JOIN {p}i3 USING (age_bin) WHERE r <= 15),
{p}c4 AS (SELECT customer_idx, sales_channel_id, {rn.format(by='customer_idx', o='COUNT(*) DESC, sales_channel_id')} AS k FROM {t} GROUP BY customer_idx, sales_channel_id),
{p}i4 AS (SELECT *, {rn.format(by='sales_channel_id', o='n DESC, article_id')} AS r FROM (SELECT sales_channel_id, article_id, COUNT(*) AS n FROM {t} GROUP BY ALL)),
{p}r4 AS (SELECT customer_idx, article_id, 'R4_popular_channel' AS source, r FROM {p}c4 JOIN {p}i4 USING (sales_channel_id) WHERE k = 1 AND r <= 15),
{p}b5 AS (SELECT * FROM (SELECT customer_idx, article_id, {rn.format(by='customer_idx', o='t_dat DESC, article_id, price, sales_channel_id')} AS pos FROM {t} WHERE days_ago <= {cf_days}) WHERE pos <= 10),
{p}p5 AS (SELECT * FROM (SELECT *, {rn.format(by='a', o='n DESC, b')} AS k FROM (SELECT x.article_id AS a, y.article_id AS b, COUNT(*) AS n FROM {p}b5 x JOIN {p}b5 y ON x.customer_idx = y.customer_idx AND x.article_id <> y.article_id GROUP BY ALL)) WHERE k <= 5),
{p}r5 AS (SELECT customer_idx, article_id, 'R5_itemcf' AS source, r FROM (SELECT *, {rn.format(by='customer_idx', o='s DESC, article_id')} AS r
    FROM (SELECT customer_idx, b AS article_id, SUM(n) AS s FROM {p}b5 JOIN {p}p5 ON article_id = a WHERE pos <= 3 GROUP BY ALL)) WHERE r <= 20),
{p}i6 AS (SELECT *, {rn.format(by='department_no', o='n DESC, article_id')} AS r FROM (SELECT department_no, article_id, COUNT(*) AS n FROM {t} JOIN art USING (article_id) GROUP BY ALL)),
{p}d6 AS (SELECT *, {rn.format(by='customer_idx', o='n DESC, department_no')} AS k FROM (SELECT customer_idx, department_no, COUNT(*) AS n FROM {t} JOIN art USING (article_id) GROUP BY ALL)),
{p}r6 AS (SELECT customer_idx, article_id, 'R6_product_family' AS source, r FROM {p}d6 JOIN {p}i6 USING (department_no) WHERE k <= 2 AND r <= 10),
{p}i7 AS (SELECT article_id, ROW_NUMBER() OVER (ORDER BY v DESC, article_id) AS r FROM (SELECT article_id, ROUND((a - b) / (b + 1.0::DOUBLE), 9) AS v
    FROM (SELECT article_id, COUNT(*) FILTER (days_ago < 7) AS a, COUNT(*) FILTER (days_ago BETWEEN 7 AND 13) AS b FROM {t} GROUP BY ALL) WHERE a >= {trend})),
{p}r7 AS (SELECT customer_idx, article_id, 'R7_trending' AS source, r FROM {users}, {p}i7 WHERE r <= 10),
{p}i8 AS (SELECT *, {rn.format(by='department_no', o='s DESC, article_id')} AS r FROM (SELECT department_no, article_id, ROUND(SUM(EXP(-0.05::DOUBLE * days_ago)), 9) AS s FROM {t} JOIN art USING (article_id) WHERE days_ago <= {dept_days} GROUP BY ALL)),
{p}r8 AS (SELECT customer_idx, article_id, 'R8_user_dept_popularity' AS source, r FROM {p}d6 JOIN {p}i8 USING (department_no) WHERE k = 1 AND r <= 12)
"""


def pool_of(p: str, without: int | None = None, name: str = "") -> str:
    """CTE ``{p}{name}pool`` of the sources ``{p}r1`` to ``{p}r8``, all but one if ``without`` is given."""
    flags = ", ".join(f"BOOL_OR(source LIKE 'R{i}%') AS is_R{i}" for i in range(1, 9))
    union = " UNION ALL ".join(f"SELECT * FROM {p}r{i}" for i in range(1, 9) if i != without)
    return f"""{p}{name}pool AS (SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY n_sources DESC, best_rank, article_id) AS k
    FROM (SELECT customer_idx, article_id, MIN(r) AS best_rank, COUNT(*) AS n_sources, {flags} FROM ({union}) GROUP BY ALL)) WHERE k <= 100),
{p}{name}ranked AS (SELECT customer_idx, article_id, k AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY n_sources DESC, best_rank, article_id) AS k FROM {p}{name}pool) WHERE k <= 12)"""


def pool_sql() -> str:
    return f"""{recall_sql('train', 't_')},
{pool_of('t_')},
pool AS (SELECT * FROM t_pool),
truth AS (SELECT DISTINCT customer_idx, article_id FROM val),
labelled AS (SELECT p.*, CASE WHEN t.article_id IS NULL THEN 0 ELSE 1 END AS target FROM pool p LEFT JOIN truth t USING (customer_idx, article_id)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY n_sources DESC, best_rank, article_id) AS rank FROM labelled)"""


def metric_sql(ranked: str, truth: str = "truth", k: int = 12, p: str = "") -> str:
    """CTEs ``{p}n_actual``, ``{p}scores`` of distinct predictions ``ranked(customer_idx, article_id, rank)``."""
    return f"""
{p}n_actual AS (SELECT customer_idx, COUNT(*) AS n FROM {truth} GROUP BY ALL),
{p}found AS (SELECT p.customer_idx, p.rank, ROW_NUMBER() OVER (PARTITION BY p.customer_idx ORDER BY p.rank) AS c FROM {ranked} p JOIN {truth} t USING (customer_idx, article_id) WHERE p.rank <= {k}),
{p}scores AS (SELECT a.customer_idx AS user, ANY_VALUE(a.n) AS n_actual, COUNT(f.rank) AS n_hits, COALESCE(SUM(CAST(f.c AS DOUBLE) / f.rank), 0) / LEAST(ANY_VALUE(a.n), {k}) AS ap FROM {p}n_actual a LEFT JOIN {p}found f USING (customer_idx) GROUP BY a.customer_idx)"""


def user_sql(t: str) -> str:
    return f"""SELECT customer_idx, COALESCE(n, 0) AS u_total_transactions, COALESCE(items, 0) AS u_unique_articles, COALESCE(mean, 0) AS u_mean_price, COALESCE(std, 0) AS u_std_price,
    COALESCE(online, 0.5::DOUBLE) AS u_online_ratio, CAST(COALESCE(age, 32) AS BIGINT) AS u_age,
    CASE club_member_status WHEN 'ACTIVE' THEN 1 WHEN 'PRE-CREATE' THEN 2 WHEN 'LEFT CLUB' THEN 3 ELSE 0 END AS u_club_status,
    CASE fashion_news_frequency WHEN 'Regularly' THEN 2 WHEN 'Monthly' THEN 1 ELSE 0 END AS u_fashion_news, COALESCE(last, 999) AS u_last_purchase_days_ago
    FROM cust LEFT JOIN (SELECT customer_idx, COUNT(*) AS n, COUNT(DISTINCT article_id) AS items, AVG(price) AS mean, STDDEV_SAMP(price) AS std,
        AVG(CASE WHEN sales_channel_id = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS online, MIN(days_ago) AS last FROM {t} GROUP BY ALL) USING (customer_idx)"""


def article_sql(t: str) -> str:
    return f"""SELECT article_id, COALESCE(n, 0) AS a_sales_count, COALESCE(users, 0) AS a_unique_customers, COALESCE(mean, (SELECT AVG(price) FROM {t})) AS a_mean_price, COALESCE(decayed, 0) AS a_sales_decayed,
    CASE WHEN oldest <= 14 THEN 1 ELSE 0 END AS a_is_recent_introduction, COALESCE(product_type_no, -1) AS a_product_type_no, COALESCE(graphical_appearance_no, -1) AS a_graphical_appearance_no,
    COALESCE(colour_group_code, -1) AS a_colour_group_code, COALESCE(department_no, -1) AS a_department_no
    FROM art LEFT JOIN (SELECT article_id, COUNT(*) AS n, COUNT(DISTINCT customer_idx) AS users, AVG(price) AS mean, SUM(EXP(-0.1::DOUBLE * days_ago / 7.0::DOUBLE)) AS decayed, MAX(days_ago) AS oldest FROM {t} GROUP BY ALL) USING (article_id)"""


INTERACTION = f"""uf AS ({user_sql('train')}), af AS ({article_sql('train')}),
pair AS (SELECT customer_idx, article_id, COUNT(*) AS n, MIN(days_ago) AS last FROM train GROUP BY ALL),
by_dept AS (SELECT customer_idx, department_no, COUNT(*) AS in_dept FROM train JOIN art USING (article_id) GROUP BY ALL),
fav AS (SELECT * FROM (SELECT customer_idx, department_no AS favourite, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY in_dept DESC, department_no) AS k FROM by_dept) WHERE k = 1),
chan AS (SELECT * FROM (SELECT article_id, sales_channel_id AS item_channel, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY COUNT(*) DESC, sales_channel_id) AS k FROM train GROUP BY article_id, sales_channel_id) WHERE k = 1),
inter AS (SELECT p.customer_idx, p.article_id, COALESCE(pair.n, 0) AS uxa_repurchase_count, COALESCE(pair.last, 999) AS uxa_days_since_last_purchase, COALESCE(in_dept, 0) AS uxa_dept_affinity,
    a_mean_price - u_mean_price AS uxa_price_diff, a_mean_price / (u_mean_price + 1e-4::DOUBLE) AS uxa_price_ratio, CASE WHEN in_dept > 0 THEN 1 ELSE 0 END AS uxa_bought_dept_before,
    CASE WHEN item_channel IS NULL THEN 0.5::DOUBLE WHEN item_channel = CASE WHEN u_online_ratio >= 0.5 THEN 2 ELSE 1 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS uxa_channel_affinity,
    CASE WHEN art.department_no = favourite THEN 1 ELSE 0 END AS uxa_is_favorite_dept
    FROM pool p LEFT JOIN pair USING (customer_idx, article_id) LEFT JOIN art USING (article_id) LEFT JOIN by_dept b ON b.customer_idx = p.customer_idx AND b.department_no = art.department_no
    LEFT JOIN fav ON fav.customer_idx = p.customer_idx LEFT JOIN chan ON chan.article_id = p.article_id LEFT JOIN uf ON uf.customer_idx = p.customer_idx LEFT JOIN af ON af.article_id = p.article_id),
meta AS (SELECT customer_idx, article_id, {', '.join(f'CAST(is_R{i} AS INT) AS is_R{i}' for i in range(1, 9))}, n_sources, best_rank,
    ROUND({' + '.join(f'CAST(is_R{i} AS INT) * {w}::DOUBLE' for i, w in enumerate((0.25, 0.1, 0.1, 0.1, 0.15, 0.1, 0.1, 0.1), 1))}, 9) AS source_diversity_score,
    CAST(is_R1 OR is_R5 OR is_R8 AS INT) AS is_personal_candidate, CAST(is_R6 OR is_R7 AS INT) AS is_exploration_candidate FROM pool)"""


def cascade_sql(t: str, personal: int, best: int, cap: int, basket: int = 0, comp_cap: int = 0, support: int = 2, top_pairs: int = 5, gamma: float = 1.0, weighted: bool = False, p: str = "") -> str:
    """CTE ``{p}lists(customer_idx, article_id, rank)`` of the rows ``t``."""
    w = f"ROUND(SUM(POWER(0.85::DOUBLE, (x.days_ago + y.days_ago) / 14.0::DOUBLE)), 12)" if weighted else "CAST(COUNT(*) AS DOUBLE)"  # noqa: F541
    if weighted:
        scored = f"SELECT h.customer_idx, b AS article_id, -ROUND(SUM(POWER(0.80::DOUBLE, h.days_ago / 7.0::DOUBLE) * w), 12) AS o1, 0 AS o2 FROM {p}hist h JOIN {p}pairs ON h.article_id = a WHERE pos <= 5"
    else:
        scored = f"SELECT customer_idx, article_id, MIN(o) // 1000 AS o1, MIN(o) % 1000 AS o2 FROM (SELECT h.customer_idx, b AS article_id, h.pos * 1000 + k AS o FROM {p}hist h JOIN {p}pairs ON h.article_id = a) h WHERE TRUE"
    comp = f"""{p}pairs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY w DESC, b) AS k FROM (SELECT x.article_id AS a, y.article_id AS b, {w} AS w FROM {t} x JOIN {t} y
    ON x.customer_idx = y.customer_idx AND x.t_dat = y.t_dat AND x.article_id <> y.article_id WHERE x.days_ago < {basket} AND y.days_ago < {basket} GROUP BY ALL HAVING COUNT(*) >= {support})) WHERE k <= {top_pairs}),
{p}comp AS (SELECT customer_idx, article_id, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY o1, o2, article_id) AS pos FROM ({scored}
    AND NOT EXISTS (SELECT 1 FROM {p}hist g WHERE g.customer_idx = h.customer_idx AND g.article_id = {'b' if weighted else 'h.article_id'} AND g.pos <= {cap}) GROUP BY ALL)),""" if comp_cap else ""
    level2 = f"UNION ALL SELECT customer_idx, article_id, 2, pos FROM {p}comp WHERE pos <= {comp_cap}" if comp_cap else ""
    score = f"ROUND(SUM(POWER({gamma}::DOUBLE, days_ago / 7.0::DOUBLE)), 9)"
    return f"""
{p}hist AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY days_ago, n DESC, article_id) AS pos FROM (SELECT customer_idx, article_id, MIN(days_ago) AS days_ago, COUNT(*) AS n FROM {t} WHERE days_ago < {personal} GROUP BY customer_idx, article_id)),
{comp}
{p}world AS (SELECT article_id, s, ROW_NUMBER() OVER (ORDER BY s DESC, article_id) AS r FROM (SELECT article_id, {score} AS s FROM {t} WHERE days_ago < {best} GROUP BY ALL)),
{p}coh AS (SELECT age_bin, article_id, s, ROW_NUMBER() OVER (PARTITION BY age_bin ORDER BY s DESC, article_id) AS r FROM (SELECT age_bin, article_id, {score} AS s FROM {t} JOIN cust USING (customer_idx) WHERE days_ago < {best} GROUP BY ALL)),
{p}levels AS (SELECT customer_idx, article_id, 1 AS l, pos FROM {p}hist WHERE pos <= {cap} {level2} UNION ALL SELECT customer_idx, article_id, 3, r FROM cust JOIN {p}coh USING (age_bin) WHERE r <= 12 AND age_bin <> 'GLOBAL'
    UNION ALL SELECT customer_idx, article_id, 4, r FROM cust, {p}world WHERE r <= 12),
{p}lists AS (SELECT * FROM (SELECT customer_idx, article_id, l, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY l, pos, article_id) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx, article_id ORDER BY l, pos) AS d FROM {p}levels) WHERE d = 1) WHERE rank <= 12)"""


PREDICTION = "SELECT customer_idx, STRING_AGG(LPAD(CAST(article_id AS VARCHAR), 10, '0'), ' ' ORDER BY rank) AS prediction FROM lists GROUP BY ALL"
SPECS = {"v5": (200, 364, 12), "v6": (200, 364, 3, 2800, 4), "v7": (200, 364, 12, 2800, 6), "v8": (200, 364, 12, 2800, 6, 2, 8, 0.12, True)}


def fallback_sql(t: str, p: str = "", days: int = 7) -> str:
    """CTEs ``{p}fg`` and ``{p}fc``: global and cohort lists of the rows ``t``."""

    def lists(rows: str, name: str, pad: str) -> str:
        return f"""{name} AS (SELECT * FROM (SELECT cohort, article_id, ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY l, pos, article_id) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort, article_id ORDER BY l, pos) AS d FROM (
    SELECT cohort, article_id, 1 AS l, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY s DESC, article_id) AS pos FROM (SELECT cohort, article_id, ROUND(SUM(EXP(-0.05::DOUBLE * (days_ago / 7.0::DOUBLE))), 9) AS s FROM {rows} WHERE days_ago < {days} GROUP BY ALL)) WHERE pos <= 12
    UNION ALL SELECT cohort, article_id, 2, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY n DESC, article_id) AS pos FROM (SELECT cohort, article_id, COUNT(*) AS n FROM {rows} GROUP BY ALL)) WHERE pos <= 36
    {pad})) WHERE d = 1) WHERE rank <= 12)"""

    return f"""{p}fr AS (SELECT {t}.*, age_bin AS cohort FROM {t} JOIN cust USING (customer_idx)), {p}fa AS (SELECT *, 'GLOBAL' AS cohort FROM {t}),
{lists(p + 'fa', p + 'fg', '')}, {lists(p + 'fr', p + 'fc', f"UNION ALL SELECT c.cohort, g.article_id, 3, g.rank FROM (SELECT DISTINCT cohort FROM {p}fr) c, {p}fg g")}"""


def with_(select: str, *ctes: str) -> str:
    """The views and CTEs before a query, each computed once."""
    return "WITH " + re.sub(r"\b(\w+) AS \((?=\s*(?:SELECT|\(SELECT|WITH))", r"\1 AS MATERIALIZED (", ",\n".join([VIEWS.strip(), *(c.strip() for c in ctes)])) + "\n" + select


def nudged(*columns: str) -> str:
    """See ``queries.nudged``."""
    return ", ".join(f"ROUND({c} + 3e-5::DOUBLE, 2) AS {c}" if c == "uxa_price_ratio" else f"ROUND({c} + 3e-9::DOUBLE, 6) AS {c}" for c in columns)


def bounds(parts: dict[str, tuple[int, int]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS part, COUNT(*) AS rows, CAST(MIN(t_dat) AS VARCHAR) AS first, CAST(MAX(t_dat) AS VARCHAR) AS last FROM aged WHERE days_ago >= {a} AND days_ago < {b}" for n, (a, b) in parts.items())


def oracle() -> dict[str, str]:
    rec, pool = recall_sql("recent", "q_", cf_days=90, dept_days=28), pool_sql()
    recall_names = ["repurchase", "popular_global", "popular_age", "popular_channel", "item_cf", "product_family", "trending", "dept_popular"]
    out = {n: with_(f"SELECT customer_idx, article_id, source, r AS rank_in_source FROM q_r{i}", rec) for i, n in enumerate(recall_names, 1)}
    lab = lambda s: with_(s, pool)
    scores = lambda s: with_(s, pool, metric_sql("ranked"))
    means = "COUNT(*) AS users, ROUND(AVG(ap), 6) AS map, ROUND(AVG(CAST(n_hits AS DOUBLE) / n_actual), 6) AS recall, ROUND(AVG(CASE WHEN n_hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate"
    out |= {
        "consolidated_pool": lab("SELECT * FROM pool"),
        "fallback_global": with_("SELECT * FROM fg", fallback_sql("aged")),
        "fallback_cohort": with_("SELECT * FROM fc", fallback_sql("aged")),
        "weekly_agg": with_("SELECT CAST(CAST(DATE_TRUNC('week', t_dat) AS DATE) AS VARCHAR) AS week_date, COUNT(*) AS n_transactions, COUNT(DISTINCT article_id) AS n_unique_articles, COUNT(DISTINCT customer_idx) AS n_unique_customers, ROUND(SUM(price) + 3e-9::DOUBLE, 6) AS total_revenue, ROUND(AVG(price) + 3e-9::DOUBLE, 6) AS avg_price, CAST(MAX(t_dat) AS VARCHAR) AS max_t_dat, CAST(MIN(t_dat) AS VARCHAR) AS min_t_dat FROM tx GROUP BY 1"),
        "customer_mapping": with_("SELECT customer_id, ROW_NUMBER() OVER (ORDER BY customer_id) - 1 AS customer_idx FROM cust"),
        "customers_binned": with_("SELECT customer_idx, customer_id, b.age, COALESCE(club_member_status, 'NONE') AS club_member_status, fashion_news_frequency, b.age_bin FROM cust0 JOIN cut_bin b USING (customer_idx)"),
        "temporal_split_counts": with_(bounds({"train": (28, 392), "validation": (0, 28)})),
        "rolling_split_bounds": with_(bounds({"val_target": (0, 28), "val_features": (28, 392), "train_target": (28, 56), "train_features": (56, 420)})),
        "leakage_audit": with_("SELECT CAST(MAX(t.t_dat) AS VARCHAR) AS max_earlier, CAST((SELECT MIN(t_dat) FROM val) AS VARCHAR) AS min_later, COUNT(*) FILTER (t.t_dat >= (SELECT MIN(t_dat) FROM val)) AS leaks FROM train t"),
        "ground_truth": with_("SELECT customer_idx, STRING_AGG(CAST(article_id AS VARCHAR), ' ' ORDER BY article_id) AS items FROM (SELECT DISTINCT customer_idx, article_id FROM val) GROUP BY ALL"),
        "features_user": with_(f"SELECT * REPLACE ({nudged('u_mean_price', 'u_std_price', 'u_online_ratio')}) FROM ({user_sql('recent')})"),
        "features_article": with_(f"SELECT * REPLACE ({nudged('a_mean_price', 'a_sales_decayed')}) FROM ({article_sql('recent')})"),
        "features_interaction": with_(f"SELECT * REPLACE ({nudged('uxa_price_diff', 'uxa_price_ratio', 'uxa_channel_affinity')}) FROM inter", pool, INTERACTION),
        "features_meta": with_("SELECT * FROM meta", pool, INTERACTION),
        "features_matrix": with_(f"SELECT * REPLACE ({nudged('source_diversity_score', 'uxa_price_diff', 'uxa_price_ratio', 'uxa_channel_affinity', 'u_mean_price', 'u_std_price', 'u_online_ratio', 'a_mean_price', 'a_sales_decayed')}) FROM meta JOIN inter USING (customer_idx, article_id) JOIN uf USING (customer_idx) JOIN af USING (article_id)", pool, INTERACTION),
        "ranker_labels": lab("SELECT target, COUNT(*) AS pairs, COUNT(DISTINCT customer_idx) AS users FROM labelled GROUP BY ALL"),
        "negative_sample": lab("SELECT customer_idx, article_id, target FROM (SELECT *, SUM(target) OVER (PARTITION BY customer_idx) AS n_pos, ROW_NUMBER() OVER (PARTITION BY customer_idx, target ORDER BY (((CAST(customer_idx AS BIGINT) * 7919 + CAST(article_id AS BIGINT) * 104729 + 42 * 15485863) % 2147483647) * 48271) % 2147483647, article_id) AS r FROM labelled) WHERE n_pos > 0 AND (target = 1 OR r <= 5 * n_pos)"),
        "ap_at_12": scores("SELECT user, n_actual, n_hits, ROUND(ap, 6) AS ap FROM scores"),
        "ranking_metrics": scores(f"SELECT {means}, ROUND((SELECT COUNT(DISTINCT article_id) FROM ranked WHERE rank <= 12) / (SELECT COUNT(*) FROM art)::DOUBLE, 6) AS coverage FROM scores"),
        "recall_curve": with_("SELECT k, ROUND(AVG(CAST(h AS DOUBLE) / n), 6) AS recall, ROUND(AVG(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM (SELECT customer_idx, k, ANY_VALUE(n) AS n, COUNT(*) FILTER (rank <= k) AS h FROM n_actual CROSS JOIN (SELECT UNNEST([1, 5, 12, 20, 40, 80]) AS k) LEFT JOIN found USING (customer_idx) GROUP BY customer_idx, k) GROUP BY k", pool, metric_sql("ranked", k=80)),
        "source_contribution": lab(" UNION ALL ".join(f"SELECT 'R{i}' AS source, COUNT(*) FILTER (is_R{i}) AS pairs, COUNT(*) FILTER (is_R{i} AND target = 1) AS hits, COUNT(*) FILTER (is_R{i} AND n_sources = 1 AND target = 1) AS exclusive_hits FROM labelled" for i in range(1, 9))),
        "source_consensus": lab("SELECT n_sources, COUNT(*) AS pairs, SUM(target)::BIGINT AS hits, ROUND(AVG(target), 6) AS rate FROM labelled GROUP BY ALL"),
        "source_correlation": lab(" UNION ALL ".join(f"SELECT 'R{i}' AS a, 'R{j}' AS b, ROUND(CORR(is_R{i}::INT, is_R{j}::INT), 6) AS r FROM pool" for i in range(1, 9) for j in range(i + 1, 9))),
        "frequent_vs_sporadic": scores(f"SELECT CASE WHEN c.n >= 4 THEN 'frequent' ELSE 'sporadic' END AS activity, {means} FROM scores JOIN (SELECT customer_idx, COUNT(*) AS n FROM train GROUP BY ALL) c ON user = customer_idx GROUP BY 1"),
    }
    out |= {f"waterfall_{n}": with_(PREDICTION, cascade_sql("aged", *spec)) for n, spec in SPECS.items()}
    held = [f"SELECT '{n}' AS variant, {means}, ROUND((SELECT COUNT(DISTINCT article_id) FROM {n}_lists) / (SELECT COUNT(DISTINCT article_id) FROM {n}_lists)::DOUBLE, 6) AS coverage FROM {n}_scores" for n in SPECS]
    ctes = ["older AS (SELECT * REPLACE (days_ago - (SELECT MIN(days_ago) FROM aged WHERE days_ago >= 28) AS days_ago) FROM aged WHERE days_ago >= 28), truth AS (SELECT DISTINCT customer_idx, article_id FROM val)"]
    for n, spec in SPECS.items():
        ctes += [cascade_sql("older", *spec, p=f"{n}_"), metric_sql(f"{n}_lists", p=f"{n}_")]
    out["waterfall_comparison"] = with_(" UNION ALL ".join(held), *ctes)
    one = lambda n, p: f"SELECT '{n}' AS variant, {means}, 1.0::DOUBLE AS coverage FROM {p}scores"
    truth, ctes, held = "truth AS (SELECT DISTINCT customer_idx, article_id FROM val)", [], []
    for w in (13, 26, 39, 52):
        rows = f"w{w} AS (SELECT * REPLACE (days_ago - (SELECT MIN(days_ago) FROM aged WHERE days_ago >= 28) AS days_ago) FROM aged WHERE days_ago >= 28 AND days_ago < {7 * w})"
        ctes += [rows, recall_sql(f"w{w}", f"w{w}_"), pool_of(f"w{w}_"), metric_sql(f"w{w}_ranked", p=f"w{w}_")]
        held.append(one(f"A1_{w}w", f"w{w}_"))
    out["ablation_window"] = with_(" UNION ALL ".join(held), truth, *ctes)
    ctes, held = [truth, recall_sql("train", "t_"), pool_of("t_"), metric_sql("t_ranked", p="t_")], [one("A2_all", "t_")]
    for i in range(1, 9):
        ctes += [pool_of("t_", i, f"no{i}_"), metric_sql(f"t_no{i}_ranked", p=f"t_no{i}_")]
        held.append(one(f"A2_no_R{i}", f"t_no{i}_"))
    out["ablation_leave_one_out"] = with_(" UNION ALL ".join(held), *ctes)
    serve = cascade_sql("aged", 201, 364, 12, 2801, 6, 2, 12, 0.12, True)
    best = "best AS (SELECT age_bin, article_id, s AS score, r AS rank FROM coh WHERE r <= 12 AND age_bin <> 'GLOBAL' UNION ALL SELECT 'ALL', article_id, s, r FROM world WHERE r <= 12)"
    walk = """walk AS (SELECT customer_idx, article_id, 1 AS l, pos AS o FROM hist WHERE pos <= 12 UNION ALL SELECT h.customer_idx, b, 2, h.pos * 100 + k FROM hist h JOIN pairs ON h.article_id = a WHERE h.pos <= 12
    UNION ALL SELECT customer_idx, article_id, 3, rank FROM cust JOIN best USING (age_bin) UNION ALL SELECT customer_idx, article_id, 4, rank FROM cust, best WHERE best.age_bin = 'ALL'),
page AS (SELECT customer_idx, article_id, l, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY l, o, article_id) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx, article_id ORDER BY l, o) AS d FROM walk) WHERE d = 1)"""
    tier = "COUNT(*) AS n, ROUND(AVG(CASE WHEN price < 20000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS entry, ROUND(AVG(CASE WHEN price BETWEEN 20000 AND 60000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS mid, ROUND(AVG(CASE WHEN price > 60000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS premium"
    counts = "counts AS (SELECT article_id, COUNT(*) AS n FROM {t} GROUP BY ALL)"
    lag_points = [1, 2, 3, 5, 7, 10, 14, 21, 28, 35, 60, 90]
    out |= {
        "serving_bestsellers": with_("SELECT age_bin, article_id, ROUND(score, 6) AS score, rank FROM best", serve, best),
        "serving_affinity": with_("SELECT a AS article_id, b AS other, ROUND(w, 6) AS weight, k AS r FROM pairs", serve),
        "serving_history": with_("SELECT customer_idx, article_id, days_ago, pos AS purchase_rank FROM hist WHERE pos <= 12", serve),
        "online_cascade": with_("SELECT customer_idx, article_id, rank, l AS level FROM page WHERE rank > 6 AND rank <= 18", serve, best, walk),
        "request_pipeline": with_("SELECT customer_idx, article_id, score, position, level FROM (SELECT customer_idx, article_id, ROUND(1.0::DOUBLE / rank, 6) AS score, l AS level, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY rank) AS position FROM page p WHERE rank <= 100 AND NOT EXISTS (SELECT 1 FROM recent q WHERE q.customer_idx = p.customer_idx AND q.article_id = p.article_id)) WHERE position > 2 AND position <= 12", serve, best, walk),
        "prediction_contract": with_("SELECT COUNT(DISTINCT customer_idx) AS rows, COUNT(DISTINCT customer_idx) - 1000 AS rows_off, 0 AS nulls, 0 AS repeated_ids, 0 AS bad_ids, COUNT(*) FILTER (n <> 12) AS bad_lengths, COUNT(*) FILTER (d <> n) AS repeated_items, 0 AS bad_items FROM (SELECT customer_idx, COUNT(*) AS n, COUNT(DISTINCT article_id) AS d FROM lists GROUP BY ALL)", cascade_sql("aged", *SPECS["v8"])),
        "popularity_assembly": with_(PREDICTION, pool, fallback_sql("train"), """known AS (SELECT customer_idx, CASE WHEN age_bin IN (SELECT cohort FROM fc) THEN age_bin ELSE 'GLOBAL' END AS cohort FROM cust),
levels AS (SELECT customer_idx, article_id, 1 AS l, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY ROUND(n_sources + 1.0::DOUBLE / best_rank, 9) DESC, article_id) AS pos FROM pool QUALIFY pos <= 12 UNION ALL SELECT customer_idx, article_id, 2, rank FROM known JOIN fc USING (cohort)),
lists AS (SELECT * FROM (SELECT customer_idx, article_id, ROW_NUMBER() OVER (PARTITION BY customer_idx ORDER BY l, pos, article_id) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_idx, article_id ORDER BY l, pos) AS d FROM levels) WHERE d = 1) WHERE rank <= 12)"""),
        "sparsity": with_("SELECT COUNT(*) AS users, (SELECT COUNT(DISTINCT article_id) FROM tx) AS items, SUM(n)::BIGINT AS rows, ROUND(1 - SUM(n) / (COUNT(*) * (SELECT COUNT(DISTINCT article_id) FROM tx))::DOUBLE, 9) AS sparsity, ROUND(AVG(n), 9) AS mean_per_user, MEDIAN(n)::DOUBLE AS median_per_user FROM (SELECT customer_idx, COUNT(*) AS n FROM tx GROUP BY ALL)"),
        "repurchase_lag_cdf": with_(" UNION ALL ".join(f"SELECT {d} AS day, ROUND(AVG(CASE WHEN lag <= {d} THEN 1.0::DOUBLE ELSE 0 END), 6) AS cdf, COUNT(*) AS lags, MEDIAN(lag)::DOUBLE AS median_lag FROM lags" for d in lag_points), "lags AS (SELECT * FROM (SELECT DATEDIFF('day', LAG(t_dat) OVER (PARTITION BY customer_idx ORDER BY t_dat), t_dat) AS lag FROM (SELECT DISTINCT customer_idx, t_dat FROM tx)) WHERE lag > 0)"),
        "power_law": with_("SELECT ROUND(-REGR_SLOPE(LOG10(n), LOG10(r)), 6) AS alpha, ROUND(REGR_R2(LOG10(n), LOG10(r)), 6) AS r2, COUNT(*) AS points FROM (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC, article_id) AS r FROM counts) WHERE r BETWEEN 11 AND 5000", counts.format(t="tx")),
        "lorenz_gini": with_("SELECT (SELECT COUNT(*) FROM counts) AS active, (SELECT COUNT(*) FROM art) AS catalog, (SELECT ROUND(SUM((2 * i - c - 1) * n) / (MAX(c) * SUM(n))::DOUBLE, 6) FROM (SELECT n, ROW_NUMBER() OVER (ORDER BY n, article_id) AS i, COUNT(*) OVER () AS c FROM counts)) AS gini_active, (SELECT ROUND(SUM((2 * i - c - 1) * n) / (MAX(c) * SUM(n))::DOUBLE, 6) FROM (SELECT COALESCE(n, 0) AS n, ROW_NUMBER() OVER (ORDER BY COALESCE(n, 0), article_id) AS i, COUNT(*) OVER () AS c FROM art LEFT JOIN counts USING (article_id))) AS gini_catalog", counts.format(t="recent")),
        "lorenz_curve": with_("SELECT p / 10.0::DOUBLE AS items_share, ROUND(SUM(CASE WHEN i <= c * p // 10 THEN n ELSE 0 END) / MAX(s)::DOUBLE, 6) AS share FROM (SELECT n, ROW_NUMBER() OVER (ORDER BY n, article_id) AS i, COUNT(*) OVER () AS c, SUM(n) OVER () AS s FROM counts), (SELECT UNNEST(range(1, 11)) AS p) GROUP BY p", counts.format(t="recent")),
        "cohort_demographics": with_("SELECT age_bin, COUNT(*) AS customers, ROUND(AVG(age), 6) AS mean_age FROM cust GROUP BY ALL"),
        "age_histogram": with_("SELECT CAST(LEAST((age - 15) * 40 // 65, 39) AS BIGINT) AS bin, COUNT(*) AS customers FROM cust WHERE age BETWEEN 15 AND 80 GROUP BY 1"),
        "channel_mix": with_("SELECT age_bin, COUNT(*) AS n, ROUND(100 * AVG(CASE WHEN sales_channel_id = 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS online_pct FROM tx JOIN cust USING (customer_idx) GROUP BY ALL"),
        "dept_revenue": with_("SELECT department_no, ROUND(SUM(price), 2) AS revenue, COUNT(*) AS n FROM tx JOIN art USING (article_id) GROUP BY ALL ORDER BY revenue DESC, department_no LIMIT 15"),
        "text_length": "SELECT COUNT(*) AS rows, ROUND(AVG(CASE WHEN text IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_share, ROUND(AVG(len(string_split(text, ' '))), 6) AS mean_words, MEDIAN(len(string_split(text, ' ')))::DOUBLE AS median_words FROM documents",
        "basket_matrix": with_("SELECT x.c AS a, y.c AS b, COUNT(*) AS n, ROUND(COUNT(*) / ANY_VALUE(t.n)::DOUBLE, 6) AS p_b_given_a FROM l x JOIN l y USING (customer_idx, t_dat) JOIN (SELECT c, COUNT(*) AS n FROM l GROUP BY ALL) t ON t.c = x.c GROUP BY x.c, y.c", "l AS (SELECT DISTINCT customer_idx, t_dat, garment_group_name AS c FROM tx JOIN art USING (article_id))"),
        "price_tiers": with_(f"SELECT age_bin, {tier}, ROUND(AVG(price), 4) AS mean, ROUND(QUANTILE_CONT(price, 0.25), 4) AS q25, ROUND(QUANTILE_CONT(price, 0.75), 4) AS q75 FROM tx JOIN cust USING (customer_idx) GROUP BY age_bin"),
        "quality_audit": with_("""SELECT 'rows' AS "check", COUNT(*) AS value FROM tx UNION ALL SELECT 'days', COUNT(DISTINCT t_dat) FROM tx UNION ALL SELECT 'null_dates', COUNT(*) FILTER (t_dat IS NULL) FROM tx UNION ALL SELECT 'null_customers', COUNT(*) FILTER (customer_idx IS NULL) FROM tx UNION ALL SELECT 'null_articles', COUNT(*) FILTER (article_id IS NULL) FROM tx UNION ALL SELECT 'prices_not_positive', COUNT(*) FILTER (price <= 0) FROM tx UNION ALL SELECT 'unknown_channels', COUNT(*) FILTER (sales_channel_id NOT IN (1, 2)) FROM tx
            UNION ALL SELECT 'orphan_customers', COUNT(*) FROM tx WHERE customer_idx NOT IN (SELECT customer_idx FROM cust) UNION ALL SELECT 'orphan_articles', COUNT(*) FROM tx WHERE article_id NOT IN (SELECT article_id FROM art) UNION ALL SELECT 'repeated_customers', COUNT(*) - COUNT(DISTINCT customer_idx) FROM cust UNION ALL SELECT 'ages_out_of_range', COUNT(*) FILTER (age NOT BETWEEN 16 AND 100) FROM cust"""),
        "catalog_value_counts": with_("SELECT garment_group_name AS value, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM art)::DOUBLE, 6) AS share FROM art GROUP BY ALL"),
        "null_counts": with_(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS nulls, ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM cust0" for c in ("customer_idx", "customer_id", "age", "club_member_status", "fashion_news_frequency"))),
        "describe_features": with_(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS low, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS high FROM u" for c in ("u_total_transactions", "u_mean_price", "u_online_ratio", "u_age")), f"u AS ({user_sql('recent')})"),
        "narrow_types": with_(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", MIN({c})::BIGINT AS low, MAX({c})::BIGINT AS high, CASE WHEN MAX({c}) < 128 THEN 'tinyint' WHEN MAX({c}) < 32768 THEN 'smallint' ELSE 'int' END AS type FROM tx" for c in ("customer_idx", "article_id", "sales_channel_id"))),
        "stratified_sample": with_("SELECT customer_idx, purchases, stratum FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY (((CAST(customer_idx AS BIGINT) * 7919 + 42 * 15485863) % 2147483647) * 48271) % 2147483647, customer_idx) AS r FROM (SELECT customer_idx, COUNT(*) AS purchases, CASE WHEN COUNT(*) = 2 THEN 1 WHEN COUNT(*) <= 4 THEN 2 WHEN COUNT(*) <= 6 THEN 3 ELSE 4 END AS stratum FROM recent GROUP BY customer_idx HAVING COUNT(*) >= 2)) WHERE r <= CASE stratum WHEN 1 THEN 80 WHEN 2 THEN 70 WHEN 3 THEN 35 ELSE 15 END"),
        "telemetry_percentiles": "SELECT event_type, COUNT(*) AS requests, ROUND(QUANTILE_CONT(value, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(value, 0.95), 6) AS p95, ROUND(QUANTILE_CONT(value, 0.99), 6) AS p99 FROM events GROUP BY ALL",
        "telemetry_windows": "SELECT strftime(DATE_TRUNC('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS events, ROUND(SUM(value), 4) AS total, ROUND(MAX(value), 4) AS most FROM events GROUP BY ALL",
        "telemetry_stream": "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS events, ROUND(SUM(value), 4) AS total, ROUND(MAX(value), 4) AS most FROM (SELECT *, DATE_TRUNC('day', ts) AS w FROM events) WHERE w + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL",
        "stream_best_sellers": with_(
            "SELECT fg.*, CAST((SELECT MAX(t_dat) FROM closed) AS VARCHAR) AS day FROM fg",
            "closed AS (SELECT tx.* EXCLUDE (days_ago), DATEDIFF('day', t_dat, (SELECT MAX(t_dat) FROM aged WHERE days_ago >= 3)) AS days_ago FROM aged tx WHERE days_ago >= 3)", fallback_sql("closed", days=28),
        ),
        "telemetry_sketches": "SELECT strftime(DATE_TRUNC('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS events, TRUE AS p50_fits, TRUE AS p95_fits, TRUE AS p99_fits FROM events GROUP BY ALL",
        "telemetry_recent_stream": TELEMETRY_RECENT,
        "telemetry_recent": TELEMETRY_RECENT,
        "weekly_best_sellers": with_("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, article_id, n, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY w ORDER BY n DESC, article_id) AS rank FROM (SELECT TIME_BUCKET(INTERVAL 28 DAY, t_dat, DATE '1970-01-01')::TIMESTAMP AS w, article_id, COUNT(*) AS n FROM tx GROUP BY ALL)) WHERE rank <= 5"),
        "catalog_audit": with_(" UNION ALL ".join(f"SELECT '{c}' AS attribute, COUNT(DISTINCT {v}) AS \"values\", COUNT(*) FILTER ({v} IS NULL) AS nulls, ROUND(AVG(CASE WHEN {v} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_share, COUNT(*) FILTER (p_partkey % 7 <> 0) AS files, ROUND(AVG(CASE WHEN p_partkey % 7 <> 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM part" for c, v in (("department_no", "SUBSTR(p_brand, 7)"), ("garment_group_name", "p_type"), ("product_type_no", "LENGTH(p_type) % 7"), ("detail_desc", "p_name")))),
        "pareto_frontier": with_("SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.sales >= x.sales AND y.mean_price <= x.mean_price AND y.items <= x.items AND (y.sales > x.sales OR y.mean_price < x.mean_price OR y.items < x.items))", "x AS (SELECT department_no, COUNT(*) AS sales, ROUND(AVG(price), 4) AS mean_price, COUNT(DISTINCT article_id) AS items FROM recent JOIN art USING (article_id) GROUP BY ALL)"),
        "archetypes": with_("(SELECT 'loyal' AS archetype, customer_idx FROM u WHERE u_last_purchase_days_ago <= 30 AND u_total_transactions >= 4 ORDER BY u_total_transactions DESC, customer_idx LIMIT 1) UNION ALL (SELECT 'explorer', customer_idx FROM u WHERE u_unique_articles = u_total_transactions AND u_total_transactions >= 3 ORDER BY u_unique_articles DESC, customer_idx LIMIT 1) UNION ALL (SELECT 'cold', customer_idx FROM u WHERE u_total_transactions <= 1 ORDER BY u_last_purchase_days_ago DESC, customer_idx LIMIT 1)", f"u AS ({user_sql('recent')})"),
    }
    each = {"sparsity": (None, "users items rows sparsity mean_per_user median_per_user"), "repurchase_lag_cdf": ("day", "cdf lags median_lag"), "power_law": (None, "alpha r2 points"), "lorenz_gini": (None, "active catalog gini_active gini_catalog"), "channel_mix": ("age_bin", "n online_pct"), "cohort_demographics": ("age_bin", "customers mean_age")}
    short = {"repurchase_lag_cdf": "lag", "lorenz_gini": "gini", "channel_mix": "channel", "cohort_demographics": "cohort"}
    parts = []
    for name, (by, columns) in each.items():
        inner = out[name] if name != "lorenz_gini" else with_(out[name].rpartition("\n")[2], counts.format(t="tx"))
        key = f"'{short.get(name, name)}.' || " + (f"CAST({by} AS VARCHAR) || '.' || " if by else "")
        parts += [f"SELECT {key}'{c}' AS measure, ROUND(CAST({c} AS DOUBLE), 6) AS value FROM ({inner})" for c in columns.split()]
    out["statistics_audit"] = " UNION ALL ".join(parts)
    return out
