import zlib

from pyspark.sql import functions as F

from vitrina.llm import sharding
from vitrina.llm.queries import op9_sharding


def check(rows, shards, slack):
    for r in rows:
        data = (r.text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = sum(r.size for r in rows)
    most = max(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= most + slack * total / shards * 2


def test_bytes_near_equal_on_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = sharding.shard(docs)
    assert set(docs.columns) | {"size", "text_crc32", "shard", "slot"} == set(out.columns)
    rows = out.collect()
    assert len(rows) == docs.count()
    check(rows, 16, 0.001)


def test_hot_copies_are_split_and_neighbours(spark):
    rows = [(i, "same text over and over" if i % 3 else f"text {i}") for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, tolerance=0.01).collect()
    check(out, 8, 0.01)
    hot = [r.shard for r in out if r.text.startswith("same")]
    assert max(hot) - min(hot) + 1 == len(set(hot)) > 2


def test_pieces_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 10)
    rows = [(i, "x" * (i % 50)) for i in range(400)]
    check(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4, 0.001)


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(None, None, 1), (1, None, 2), (1, "", 3), (2, "a", 4), (2, "a", 5), (3, "é" * 5000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("slot", F.lit("x"))
    out = sharding.shard(docs, shards=3).collect()
    assert len(out) == 6
    check(out, 3, 1)
    assert len({r.shard for r in out if r.text == "a"}) == 1
    assert sharding.shard(docs.limit(0), shards=3).count() == 0
    assert sharding.shard(docs, shards=1).where("shard = 0").count() == 6


def test_query_contract(spark, data_dir):
    out = op9_sharding(spark, data_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
