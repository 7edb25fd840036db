import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vitrina.llm import resample as rs
from vitrina.llm.common import text_slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(f.encode()) for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def brute(rows, target, share, least, seed=7):
    count = lambda texts: np.bincount([f % rs.BUCKETS for t in texts for f in features(t)[0]], minlength=rs.BUCKETS)
    s, t = count([t for _, t in rows]).tolist(), count(target).tolist()
    gains = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t)]
    out = []
    for key, text in rows:
        own, words = features(text)
        weight = sum(gains[f % rs.BUCKETS] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), words))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {}
    for i, r in enumerate(fit[: share * len(fit) // 100]):
        ranks.setdefault(r[:4], []).append(i + 1)
    return out, ranks


@pytest.mark.parametrize("most", [40, 4_000_000])
def test_features_of_odd_texts(most):
    rng = random.Random(1)
    texts = [None, "", "A b C", "x" * 100 + " y " + "z" * 65 + " " + "q" * 64 + " k", "é ÀB 12-3_a", "   ", "[`{\x7f@/:" * 9]
    texts += ["".join(rng.choice("aB1 é-Z漢\t") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for column in (pa.array(texts), pa.array(texts).slice(3, 90)):
        seen = 0
        for data, offsets, at in text_slices(column, most):
            crc, doc, words = rs.word_features(data, offsets)
            for k in range(len(words)):
                own, n = features(column[at + k].as_py())
                assert sorted(own) == sorted(crc[doc == k].tolist()) and n == words[k]
            seen += len(words)
        assert seen == len(column)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "delta7", "été", "zz"] + [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 19, 20, 21, 60, 300]))) for i in range(300)] + [(900, None), (901, ""), (None, text(40))]
    target = [text(15) for _ in range(12)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = rs.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), keep_text=False).collect()
    want, ranks = brute(rows, target, 25, 20)
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score, r.n_words) for r in got) == sorted((k or -1, *rest) for k, *rest in want)
    found = {}
    for r in got:
        if r["rank"] is not None:
            found.setdefault((r.doc_id, r.n_features, r.weight, r.score), []).append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == ranks and ranks


def test_repeats_ties_and_one_key_with_most_rows(spark):
    text = " ".join(["same"] * 30)
    rows = [(5, text)] * 400 + [(i, text) for i in range(10, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "'x' AS rank", "1 AS _part", "doc_id AS other")
    got = rs.resample(docs, docs.limit(0)).collect()
    assert len(got) == 600 and got[0].asDict().keys() == {"doc_id", "text", "other", "n_words", "n_features", "weight", "score", "rank"}
    drawn = sorted(((-r.score, r.doc_id), r["rank"]) for r in got if r["rank"])
    assert [k for _, k in drawn] == list(range(1, 151))
    assert [k for k, _ in drawn] == sorted((-r.score, r.doc_id) for r in got)[:150]
    assert all(r.other == r.doc_id for r in got)


def test_empty_tables_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rs.resample(empty, empty).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + "x" * 3_000_000)], "doc_id long, text string")
    r = rs.resample(long, empty, share=100, keep_text=False).first()
    assert (r.n_words, r.n_features, r["rank"]) == (400_001, 800_001, 1)


def test_sorted_files_are_a_partition_each(spark):
    """The ranking has one exchange by ranges and no window that gathers all rows."""
    df = spark.range(1000).selectExpr("id % 7 AS score", "id")
    plan = rs.ranked(df, [df.score.desc()])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
