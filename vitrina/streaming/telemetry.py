"""Request telemetry and incremental best sellers, on a stream or a table alike (extensions: the batch operators
have no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.quantiles import quantiles
from vitrina.operators.recall import top


def windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Requests, users and value by tumbling window and type; late rows are dropped after ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "event_type", "events", "total", "most")


def percentiles(events: DataFrame, by: str = "event_type") -> DataFrame:
    """p50, p95 and p99 (interpolated) by type."""
    found = quantiles(events, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=(by,))
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("requests")).join(F.broadcast(found), by, "left")  # a row a type


def recent_percentiles(events: DataFrame, last: int = 10_000) -> DataFrame:
    """One row: all requests, those that failed (``event_type`` ``error``), and p50, p95 and p99 (interpolated) of the ``last`` ones."""
    all_ = events.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    near = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    p = lambda q, name: F.percentile("value", F.lit(q)).alias(name)
    return all_.crossJoin(F.broadcast(near.agg(F.count(F.lit(1)).alias("measured"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))))  # one row


def sales_by_window(tx: DataFrame, width: str = "7 days", late: str = "2 days") -> DataFrame:
    """Sales of each article by tumbling window of ``t_dat``: ``(start, article_id, n)``; on a stream a window is given
    once it is closed, so the best sellers of a day follow from what was written so far."""
    rows = tx.withColumn("ts", F.col("t_dat").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if tx.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "article_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "article_id", "n")


def best_sellers(windows_: DataFrame, top_k: int = 12) -> DataFrame:
    """The best ``top_k`` of each window of :func:`sales_by_window`: ``(start, article_id, n, rank)``."""
    return top(windows_, ["start"], [F.desc("n"), F.asc("article_id")], top_k, "rank")


def exposition(summary: DataFrame) -> str:
    """K9: the percentiles as metrics text."""
    return "".join(f'request_value{{type="{r["event_type"]}",quantile="{q}"}} {r[c]}\n' for r in summary.orderBy("event_type").collect() for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99")))


def stream(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now through the stream (closed windows only), and the table it wrote."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
