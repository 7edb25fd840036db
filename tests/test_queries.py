import gzip
import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from vitrina.plans import oracle, queries
from vitrina.sources import tables
from vitrina.streaming import telemetry

REPO = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def db(data_dir):
    c = duckdb.connect()
    for f in os.listdir(data_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data_dir}/{f}'")
    return c


def normal(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in row]) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle.oracle()))
def test_equals_sql(spark, db, data_dir, name):
    assert normal(queries.QUERIES[name](spark, data_dir).toPandas()) == normal(db.execute(oracle.oracle()[name]).df())


def test_every_sql_has_a_query():
    assert set(oracle.oracle()) <= set(queries.QUERIES)


def test_stream_equals_table(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    stream = telemetry.windows(telemetry.stream(spark, data_dir, "events", events.schema))
    out = telemetry.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = {(str(r.start), r.event_type): r.events for r in telemetry.windows(events).collect()}
    assert out and all(want[str(r.start), r.event_type] == r.events for r in out)
    assert 'quantile="0.95"' in telemetry.exposition(telemetry.percentiles(events))


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    tables.sink_parquet(df, str(tmp_path / "p"))
    tables.sink_csv(df, str(tmp_path / "c"), gzip=True)
    again = tables.scan_parquet(spark, str(tmp_path / "p"))
    found = tables.content_hash(df.repartition(3)).first()
    assert found == tables.content_hash(again).first() != tables.content_hash(df.limit(1)).first()
    path = str(tmp_path / "manifest.json")
    tables.register_manifest(path, "v8", {"rows": 0, "fingerprint": "0"})
    tables.register_manifest(path, "v8", {"rows": found.rows, "fingerprint": found.fingerprint})
    assert tables.verify_manifest(path, "v8", again) and not tables.verify_manifest(path, "v8", df.limit(1))
    new = spark.createDataFrame([(1, "z", 5)], "id int, v string, w int")
    assert sorted(map(tuple, tables.upsert(new, df, "id").select("id", "v", "w").collect())) == [(1, "z", 5), (2, "b", None)]
    (tmp_path / "a.csv").write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-09-22,x,7,0.5,2\n")
    assert tables.scan_csv(spark, str(tmp_path / "a.csv"), "transactions", ["article_id", "price"]).first() == (7, 0.5)


def test_ordered_sinks_digests_and_integrity(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id * 7 % 5000 AS k", "'x' AS v").repartition(5)
    for name in ("one", "two"):
        tables.sink_csv(df.repartition(3), str(tmp_path / f"{name}.csv"), gzip=True, order_by=["k"])
    parts = sorted((tmp_path / "one.csv").glob("part-*"))
    rows = [int(line.split(",")[1]) for f in parts for line in gzip.decompress(f.read_bytes()).decode().splitlines()[1:]]
    assert rows == list(range(5000))
    one, two = (sorted((r.bytes, r.md5, r.sha256) for r in tables.file_digests(spark, str(tmp_path / f"{name}.csv")).collect()) for name in ("one", "two"))
    assert one == two and one[0][2] in {hashlib.sha256(f.read_bytes()).hexdigest() for f in parts}
    assert [r.k for r in tables.first_rows(df, 3, ["k"]).collect()] == [0, 1, 2]
    found = {r.table: r for r in tables.integrity(spark, {"a": str(tmp_path / "one.csv"), "b": str(tmp_path / "no"), "c": str(tmp_path / "two.csv")}, {"a": 5000, "c": 4}).collect()}
    assert found["a"].ok and found["a"].rows == 5000 and found["a"].bytes > 0 and not found["b"].exists and not found["b"].ok and not found["c"].ok
    assert tables.source_dir("/x/", True) == "/x/data_sample" and tables.source_dir("/x", False) == "/x/data"


def test_streamed_best_sellers_equal_the_table(spark, tmp_path):
    rows = [(f"2021-03-{1 + i % 20:02d}", i * i % 7) for i in range(300)]
    tx = spark.createDataFrame(rows, "d string, article_id int").selectExpr("CAST(d AS date) AS t_dat", "article_id")
    tx.write.parquet(str(tmp_path / "tx.parquet"))
    stream = telemetry.sales_by_window(telemetry.stream(spark, str(tmp_path), "tx", tx.schema))
    closed = telemetry.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = {tuple(r) for r in telemetry.best_sellers(telemetry.sales_by_window(tx), 3).collect()}
    got = {tuple(r) for r in telemetry.best_sellers(closed, 3).collect()}
    assert got and got < want and {s for s, *_ in want} - {s for s, *_ in got}  # all but the open window


def test_entry_imports_without_the_pipeline(tmp_path):
    for name in ("__spark_entry__.py", "vitrina"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "vitrina" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_day_windows_reach_the_scan(spark, data_dir, capsys):
    r = tables.Retail(spark, data_dir)
    for df in (queries.recent(r), queries.parts(r).train):
        df.select("customer_idx").explain("formatted")
        plan = capsys.readouterr().out
        assert "GreaterThan(t_dat" in plan and "LessThanOrEqual(t_dat" in plan and "Join" not in plan and "struct<t_dat:date,customer_idx:int>" in plan


def test_a_kept_table_that_is_gone_is_made_again(spark, data_dir):
    r = tables.Retail(spark, data_dir)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert r.kept("three", make).count() == 3 == r.kept("three", make).count() and len(made) == 1
    shutil.rmtree(r.kept("three", make).vitrina_path.removeprefix("file://"))
    assert r.kept("three", make).count() == 3 and len(made) == 2


def test_entry_hides_no_broken_module(tmp_path):
    for name in ("__spark_entry__.py", "vitrina"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import there_is_no_such_module\n")
    (tmp_path / "vitrina" / "llm").mkdir(exist_ok=True)
    (tmp_path / "vitrina" / "llm" / "__init__.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=False)
    assert done.returncode and b"there_is_no_such_module" in done.stderr


def test_kept_tables_follow_their_inputs(spark, data_dir, tmp_path):
    """A table that is replaced between two calls is read anew by all that is kept, and what was kept of it goes."""
    where = tmp_path / "tables"
    shutil.copytree(data_dir, where)
    names = ("sparsity", "consolidated_pool", "ranker_labels")
    first = {n: normal(queries.QUERIES[n](spark, str(where)).toPandas()) for n in names}
    r = tables.Retail(spark, str(where))
    old, ranker = r.purchases.vitrina_path, r.once("ranker", object)
    assert r.once("ranker", object) is ranker and first["sparsity"] == normal(queries.QUERIES["sparsity"](spark, str(where)).toPandas())
    rows = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    more = rows.unionByName(rows.withColumn("l_partkey", rows.l_partkey % 50 + 1))
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    shutil.copy(next((tmp_path / "more").glob("part-*.parquet")), where / "lineitem.parquet")
    c = duckdb.connect()
    for f in os.listdir(where):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{where}/{f}'")
    for n in names:
        again = normal(queries.QUERIES[n](spark, str(where)).toPandas())
        assert again != first[n] and again == normal(c.execute(oracle.oracle()[n]).df())
    r = tables.Retail(spark, str(where))
    assert r.once("ranker", object) is not ranker and r.purchases.vitrina_path != old and not Path(old.removeprefix("file://")).exists()


def test_the_application_leaves_no_folder(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from vitrina.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
df = scratch.kept(spark.range(3), "three")
assert df.count() == 3 and df.vitrina_path.startswith(scratch.app_dir(spark))
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, capture_output=True)
    assert not list(tmp_path.glob("vitrina-*"))  # Spark makes a folder of its own
