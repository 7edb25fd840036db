"""Importance resampling towards a target distribution, in two Arrow passes.

The features of a text are its words and pairs of neighbouring words, hashed to ``BUCKETS``
buckets by crc32.  The first pass counts them: each partition adds ``np.bincount`` vectors of
one number per bucket, and ``treeReduce`` merges the partitions' vectors, so the driver sees
a few of them, whatever the data.  The counts of the corpus and of the target give each
bucket a gain.  The second pass gathers the broadcast gains of each document's features and
sums them by document with ``np.bincount`` weights.  A Gumbel key from the document's id is
added, and the highest scores are drawn.

Words are found and hashed on the bytes of whole Arrow batches: no Python object is made for
a word.  The crc32 of a pair follows from those of its words, as appending bytes is a linear map of the
checksum.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_rows, cut, drop_cut, text_slices, tree_merged

BUCKETS = 10_000
#: Words of more bytes are hashed one by one.
SHORT = 64

# A-Z become a-z; words are runs of digits, a-z and bytes beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC = _crc_table()


def _zero_bytes() -> np.ndarray:
    """``[n, lane, v]``: what ``n`` appended zero bytes make of the checksum whose byte ``lane`` is ``v``."""
    out = np.zeros((SHORT + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, SHORT + 2):
        out[n] = CRC[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_FLAT = _zero_bytes().ravel()
#: The checksum of a blank and ``n`` zero bytes.
_BLANK = np.array([zlib.crc32(b" " + bytes(n)) ^ zlib.crc32(bytes(n)) for n in range(SHORT + 1)], np.uint32)


def _appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums' part in those of texts that are ``n`` bytes longer."""
    out, row = np.zeros(len(crc), np.uint32), n.astype(np.int32) << 10
    for lane in range(4):
        out ^= _FLAT.take(row + ((crc >> np.uint32(8 * lane)) & np.uint32(255)).astype(np.int32) + 256 * lane)
    return out


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Crc32 of all features of texts whose UTF-8 bytes lie on end, the text each is of, and the words of each text."""
    low = LOWER[data]
    inside = IS_WORD[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins[offsets[full]] = inside[offsets[full]]  # words end with their text
    ends[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    doc = np.searchsorted(offsets, start, "right") - 1
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]  # long words first: each step works on a prefix
    more = len(size) - np.cumsum(np.bincount(short, minlength=SHORT + 2))  # words of more bytes
    at, crc = start[order], np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(SHORT):
        m = more[k]
        if not m:
            break
        own = crc[:m]
        crc[:m] = CRC.take((own ^ low.take(at[:m] + k)) & np.uint32(255)) ^ (own >> np.uint32(8))
    crc[order] = ~crc
    long = np.flatnonzero(size > SHORT)
    for i in long.tolist():
        crc[i] = zlib.crc32(low[start[i] : start[i] + size[i]])
    first = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    second = first + 1
    n = np.minimum(size[second], SHORT)
    pair = _appended(crc[first], n + 1) ^ _BLANK.take(n) ^ crc[second]
    for i in np.flatnonzero(size[second] > SHORT).tolist():
        s = second[i]
        pair[i] = zlib.crc32(low[start[s] : start[s] + size[s]], zlib.crc32(b" ", int(crc[s - 1])))
    return np.concatenate([crc, pair]), np.concatenate([doc, doc[first]]), np.bincount(doc, minlength=len(offsets) - 1)


def count_buckets(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, offsets, _ in text_slices(batch.column(0)):
                total += np.bincount(word_features(data, offsets)[0] % BUCKETS, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = texts.select(text).mapInArrow(run, "counts binary")
    return tree_merged(parts, lambda data: np.frombuffer(data, np.int64), np.add, np.zeros(BUCKETS, np.int64))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold logarithm of each bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` plus ``n_words, n_features`` and ``weight``, the floored mean of their features' gains."""
    docs = docs.drop("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if keep_text or c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number per bucket
    names = [*kept, "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, at in text_slices(batch.column(text)):
                crc, doc, words = word_features(data, offsets)
                n = np.bincount(doc, minlength=len(words))
                total = np.bincount(doc, shared.value[crc % BUCKETS], len(words)).astype(np.int64)  # whole numbers: exact in doubles
                own = [batch.column(c).slice(at, len(words)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=names)

    return docs.mapInArrow(run, fields + "n_words bigint, n_features bigint, weight bigint")


def gumbel(key: str = "doc_id", seed: int = 7):
    """The floored thousandfold Gumbel key of a row, from the sha256 of its seed and key (null key: empty)."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(word, "UTF-8"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """``rows`` plus their place (from 1) in the order of some columns.

    The rows are dealt by ranges of the order and written sorted, a file each; a row's place is that in
    its file after the rows of the files before.  Ties are dealt by their place in the input, so no value, however
    frequent, fills a task of its own.
    """
    spark = rows.sparkSession
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*order, F.col("_tie")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = cut(tie.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r["_part"], before))
        before += r.n
    offsets = broadcast_rows(spark, starts, "_part int, _before bigint")
    placed = table.select("*", F.col("_metadata.row_index").alias("_at")).join(offsets, "_part")
    return placed.withColumn(rank, F.col("_before") + F.col("_at") + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, of: int = 100, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``floor(share * N / of)`` of the ``N`` rows with ``least_words`` words are drawn, those of the highest scores
    (ties: the smaller key, null keys last); they are numbered from 1 in that order, other rows have a null
    rank.  Null texts have no features and weight 0, as empty ones; a repeated row is drawn as a row of its own
    (rows of one key and weight tie: any of them may come first); an empty
    target gives gains by the corpus alone; an empty table gives an empty result.  Clashing columns are
    replaced, and so is any whose name the operator needs on its way (``_part``, ``_tie``, ``_before``, ``_at``).
    """
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank", "_part", "_tie", "_before", "_at")
    gains = bucket_gains(count_buckets(docs, text), count_buckets(target, text))
    scored = weigh(docs, gains, text, keep_text).withColumn("score", F.col("weight") + gumbel(key, seed))
    table = cut(scored, "weights")
    fits = F.col("n_words") >= least_words
    drawn = share * table.where(fits).count() // of
    out = ranked(table, [(~fits).asc(), F.col("score").desc(), F.col(key).asc_nulls_last()])
    drop_cut(table)
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


#: DuckDB SQL of ``resample`` over ``documents`` and ``benchmark``; crc32 by its table of 256 values.
ORACLE = """
    WITH RECURSIVE step(v, c, k) AS (
        SELECT v, v, 0 FROM range(256) r(v)
        UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
    ), crc AS MATERIALIZED (
        SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8
    ), texts AS (
        SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
    ), words AS (
        SELECT side, id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
    ), features AS MATERIALIZED (
        SELECT side, id, f, COUNT(*) AS n FROM (
            SELECT side, id, UNNEST(w) AS f FROM words
            UNION ALL SELECT side, id, UNNEST(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        ) GROUP BY ALL
    ), hashed AS MATERIALIZED (
        SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
            lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) % 10000 AS bucket
        FROM (SELECT DISTINCT f FROM features), crc
    ), counts AS (
        SELECT bucket, SUM(n) FILTER (side = 'd') AS s, SUM(n) FILTER (side = 't') AS t FROM features JOIN hashed USING (f) GROUP BY bucket
    ), totals AS (
        SELECT COALESCE(SUM(s), 0)::DOUBLE AS s_all, COALESCE(SUM(t), 0)::DOUBLE AS t_all FROM counts
    ), gains AS MATERIALIZED (
        SELECT bucket, floor(1000 * ln((COALESCE(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((COALESCE(s, 0) + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM counts, totals
    ), sums AS (
        SELECT id, SUM(n) AS n_features, SUM(n * gain) AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
    ), scored AS (
        SELECT id AS doc_id, len(w) AS n_words, COALESCE(n_features, 0)::BIGINT AS n_features, COALESCE(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
            ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h
        FROM words LEFT JOIN sums USING (id) WHERE side = 'd'
    ), keyed AS (
        SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored
    ), placed AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, COUNT(*) FILTER (n_words >= 20) OVER () AS fit FROM keyed
    )
    SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM placed
"""
