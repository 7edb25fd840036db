"""Schemas, scans, sinks, and the adapter from the star-schema tables to the retail views."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.retail import by_shuffle
from vitrina.sources import scratch

# The columns of the raw files.
SCHEMAS = {
    "transactions": "t_dat date, customer_id string, article_id int, price double, sales_channel_id int",
    "customers": "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age int, postal_code string",
    "articles": "article_id int, product_code int, prod_name string, product_type_no int, product_type_name string, product_group_name string, graphical_appearance_no int, colour_group_code int, department_no int, department_name string, index_code string, index_group_no int, section_no int, garment_group_no int, garment_group_name string, detail_desc string",
}


def scan_csv(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A raw CSV file with its declared types; only ``columns`` are parsed if given."""
    df = spark.read.schema(SCHEMAS[table]).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sink_csv(df: DataFrame, path: str, gzip: bool = False, order_by: list[str] | None = None) -> None:
    """CSV files with a header.  With ``order_by`` the rows are sorted over all files: the files in the order of
    their names are the sorted table, and equal rows give equal files."""
    writer = (df.orderBy(*order_by) if order_by else df).write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """K5: ``(file, bytes, md5, sha256)`` of each data file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in the order of some columns: the same rows each time."""
    return df.orderBy(*order_by).limit(n)


def source_dir(base: str, sample: bool) -> str:
    """Where the tables are: those of the sample or all of them."""
    return f"{base.rstrip('/')}/{'data_sample' if sample else 'data'}"


def integrity(spark: SparkSession, paths: dict[str, str], expected: dict[str, int] | None = None, count: bool = True) -> DataFrame:
    """``(table, exists, bytes, rows, expected, ok)`` of CSV or Parquet tables; rows are counted unless not ``count``."""
    out = []
    for name, path in paths.items():
        try:
            size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0]
        except AnalysisException:  # there is no such path
            size = None
        rows = None
        if size is not None and count:
            rows = (spark.read.option("header", True).csv(path) if ".csv" in path else spark.read.parquet(path)).count()
        want = (expected or {}).get(name)
        out.append((name, size is not None, size, rows, want, size is not None and (not count or want is None or rows == want)))
    return spark.createDataFrame(out, "table string, exists boolean, bytes long, rows long, expected long, ok boolean")


def upsert(new: DataFrame, old: DataFrame | None, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, then ``new``; missing columns become null."""
    return new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the number of rows and an order-free fingerprint of their content."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def register_manifest(path: str, version: str, entry: dict) -> dict:
    """K6: insert or replace a version in a small JSON manifest, on any file system that Spark reaches."""
    spark = SparkSession.active()
    manifest = json.loads(scratch.read_text(spark, path) or '{"submissions": []}')
    manifest["submissions"] = sorted([e for e in manifest["submissions"] if e["version"] != version] + [{"version": version, **entry}], key=lambda e: e["version"])
    scratch.write_text(spark, path, json.dumps(manifest, indent=1))
    return manifest


def verify_manifest(path: str, version: str, df: DataFrame) -> bool:
    """K7: whether ``df`` has the rows and the fingerprint that the manifest has of a version (not one it doesn't know)."""
    known = json.loads(scratch.read_text(df.sparkSession, path) or '{"submissions": []}')["submissions"]
    entry = next((e for e in known if e["version"] == version), None)
    found = content_hash(df).first()
    return entry is not None and (entry["rows"], entry["fingerprint"]) == (found["rows"], found["fingerprint"])


class Retail:
    """The retail views over the star schema in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def state(self) -> str:
        """What the files of the tables behind the views are now."""
        return scratch.state(self.spark, [f"{self.sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "customer", "part")])

    def once(self, name: str, make):
        """What ``make`` gives for these tables, made once in the application while they stay as they are."""
        return scratch.once(self.spark, (self.sf_dir, name), self.state, make)

    def kept(self, name: str, make) -> DataFrame:
        """The table that ``make`` gives, written once."""
        return self.once(name, lambda: scratch.kept(make(), f"retail-{name}"))

    @property
    def purchases(self) -> DataFrame:
        """The purchases, written once in the order of their days, so that a window of days reads its own files and row
        groups."""

        def make() -> DataFrame:
            orders = self.table("orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("customer_idx"), F.col("o_orderdate").cast("date").alias("t_dat"))
            lines = self.table("lineitem").select("l_orderkey", F.col("l_partkey").cast("int").alias("article_id"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("sales_channel_id"))
            rows = lines.join(by_shuffle(orders), lines.l_orderkey == orders.o_orderkey).select("t_dat", "customer_idx", "article_id", "price", "sales_channel_id")
            return rows.repartitionByRange("t_dat", "customer_idx").sortWithinPartitions("t_dat")  # a day may fill many tasks

        return self.kept("tx", make)

    @property
    def tx(self) -> DataFrame:
        """The purchases with their age in days."""
        return self.dated("tx", self.purchases)

    def dated(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with their last day as a constant ``ref_date``, found once, and ``days_ago``."""
        last = self.once(f"{name}-last", lambda: rows.agg(F.max("t_dat")).first()[0])
        return rows.withColumn("ref_date", F.lit(last).cast("date")).withColumn("days_ago", F.datediff("ref_date", "t_dat"))

    @property
    def customers(self) -> DataFrame:
        # How market segments stand for membership.
        club = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "ACTIVE").when(F.col("c_mktsegment") == "BUILDING", "PRE-CREATE").when(F.col("c_mktsegment") == "FURNITURE", "LEFT CLUB").when(F.col("c_mktsegment") == "HOUSEHOLD", None).otherwise("OTHER")
        news = F.when(F.col("c_nationkey") % 3 == 0, "Regularly").when(F.col("c_nationkey") % 3 == 1, "Monthly").otherwise("NONE")
        age = F.when(F.col("c_acctbal") < 0, None).otherwise((F.lit(16) + F.floor(F.col("c_acctbal") / 10000 * 64)).cast("int"))
        return self.table("customer").select(F.col("c_custkey").cast("int").alias("customer_idx"), F.lpad(F.col("c_custkey").cast("string"), 64, "0").alias("customer_id"), age.alias("age"), club.alias("club_member_status"), news.alias("fashion_news_frequency"))

    @property
    def articles(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("int").alias("article_id"),
            F.substring("p_brand", 7, 10).cast("int").alias("department_no"),
            F.col("p_type").alias("garment_group_name"),
            F.pmod(F.length("p_type"), F.lit(7)).cast("int").alias("product_type_no"),
            F.col("p_size").cast("int").alias("graphical_appearance_no"),
            (F.col("p_size") % 10).cast("int").alias("colour_group_code"),
            F.col("p_name").alias("detail_desc"),
        )
