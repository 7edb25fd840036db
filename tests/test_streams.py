import datetime as dt
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import recall
from vitrina.streaming import state, telemetry


def files(df, where, n):
    """``df`` as ``n`` files in any order of their rows."""
    df.withColumn("_p", F.pmod(F.xxhash64(*df.columns), F.lit(n))).repartition(n, "_p").drop("_p").write.parquet(str(where))
    return sorted(f for f in where.iterdir() if f.suffix == ".parquet")


def one_file_at_a_time(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_recent_requests_equal_the_table_and_survive_a_restart(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet").limit(600).cache()
    events = events.unionByName(events.limit(1).selectExpr("9999999L AS event_id", "ts", "user_id", "'error' AS event_type", "CAST(NULL AS double) AS value", "props"))
    parts = files(events, tmp_path / "all", 5)
    (tmp_path / "in").mkdir()
    for k, some in enumerate((parts[:2], parts[2:3], parts[3:])):  # each run goes on from the checkpoint of the one before
        for f in some:
            shutil.copy(f, tmp_path / "in")
        stream = one_file_at_a_time(spark, f"{tmp_path}/in", events.schema)
        state.recent_on_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", last=50, shards=3)
        want = telemetry.recent_percentiles(spark.read.parquet(f"{tmp_path}/in"), 50).first()
        got = state.recent_summary(spark, f"{tmp_path}/out", 50).first()
        assert got.asDict() == pytest.approx(want.asDict()), k
    assert len(state.Versions(spark, f"{tmp_path}/out").numbers()) == 2


def test_window_percentiles_within_the_bound(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    big = events.withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp")).crossJoin(spark.range(30)).withColumn("value", F.col("value") + F.col("id") * 0.37)
    for df in (events, big.drop("id")):
        rows = {}
        for r in df.select(F.window("ts", "1 day").start.alias("s"), "event_type", "value").where("value IS NOT NULL").collect():
            rows.setdefault((r.s, r.event_type), []).append(r.value)
        for r in state.window_percentiles(df, shares).collect():
            own = np.sort(rows[r.start, r.event_type])
            for name, q in shares.items():
                low, high = np.searchsorted(own, r[name], "left") / len(own), np.searchsorted(own, r[name], "right") / len(own)
                assert low - 0.006 - 1 / len(own) <= q <= high + 0.006 + 1 / len(own)
    stream = state.window_percentiles(telemetry.stream(spark, data_dir, "events", events.schema), shares)
    closed = telemetry.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    table = {(r.start, r.event_type): r for r in state.window_percentiles(events, shares).collect()}
    assert closed and all(table[r.start, r.event_type].events == r.events for r in closed)


def test_best_sellers_equal_c2_at_each_closed_day(spark, tmp_path):
    rng = np.random.default_rng(3)
    first = dt.date(2021, 3, 1)
    rows = [(first + dt.timedelta(int(d)), int(rng.pareto(0.9)) % 60) for d in np.sort(rng.integers(0, 30, 2000))]
    (tmp_path / "in").mkdir()
    tx = spark.createDataFrame(rows, "t_dat date, article_id int")
    seen = 0
    for k in range(5):  # six days a file, one run a file
        tx.where(f"t_dat >= date'{first + dt.timedelta(6 * k)}' AND t_dat < date'{first + dt.timedelta(6 * k + 6)}'").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in")
        state.best_sellers_on_stream(one_file_at_a_time(spark, f"{tmp_path}/in", tx.schema), f"{tmp_path}/out", f"{tmp_path}/state")
        now = state.Versions(spark, f"{tmp_path}/out").before()
        if now is None or not now.count():
            continue
        got = state.decayed_best(now).collect()
        day = got[0].day
        want = recall.fallback(tx.where(F.col("t_dat") <= F.lit(day))).collect()
        assert sorted((r["rank"], r.article_id) for r in got) == sorted((r["rank"], r.article_id) for r in want)
        seen += 1
    assert seen >= 4 and day == first + dt.timedelta(26)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    versions = state.Versions(spark, str(tmp_path / "v"))
    closed = spark.createDataFrame([(dt.datetime(2021, 3, 1), 7, 3), (dt.datetime(2021, 3, 9), 7, 2)], "start timestamp, article_id int, n long")
    more = spark.createDataFrame([(dt.datetime(2021, 3, 10), 7, 5)], "start timestamp, article_id int, n long")
    versions.write(state.merged_sales(versions.before(0), closed, 7), 0)
    for _ in range(2):
        versions.write(state.merged_sales(versions.before(1), more, 7), 1)
    assert {(r.day, r.n) for r in versions.before().collect()} == {(None, 3), (dt.date(2021, 3, 9), 2), (dt.date(2021, 3, 10), 5)}
