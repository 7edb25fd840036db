import zlib

import numpy as np

from vitrina.llm import quality
from vitrina.llm.queries import op1_quality


def test_word_features_do_not_depend_on_the_batch():
    a, b = quality.Words(), quality.Words()
    words = ["the", "cat", "é|$", "x" * 40, "a"]
    for ws in (words, words[::-1]):
        flat, counts, new = a.split([" ".join(ws)])
        if new:
            bucket, word = a.features(new)
            first = {w: sorted(bucket[word == i].tolist()) for i, w in enumerate(new)}
    for w in words:
        _, _, new = b.split([w])
        bucket, _ = b.features(new)
        assert sorted(bucket.tolist()) == first[w] and len(first[w]) == 1 + len(w) + 2 - 2 + len(w) + 2 - 3


def test_scorer_equals_the_average_of_vectors():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 1, quality.BUCKETS + 1), 0.2)
    texts = ["a b b c", "", None, "the the the", "b a\nc", "a b b c"]
    got = quality.Scorer(model).scores(texts)
    for text, score in zip(texts, got, strict=True):
        w = quality.Words()
        flat, counts, new = w.split([text])
        bucket, word = w.features(new)
        pair, _ = w.pairs(flat, counts)
        own = [bucket[word == n] for n in flat] + [pair]
        ids = np.concatenate(own)
        z = 0.2 + (model.weight[ids].mean() if len(ids) else 0)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy(spark, data_dir):
    sf = data_dir.replace("sf0.001", "sf0.01")
    rows = op1_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([(s >= 0.3) == y for s, y in test]) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else "|| ## bad") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, 1000, 10**6)
    assert {r.doc_id for r in rows} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(quality.training_rows(docs, labels, 7, 10**6)) == 14
    assert sum(len(r.text) for r in quality.training_rows(docs, labels, 1000, 300)) <= 300


def test_a_text_over_the_budget_leaves_room_for_others(spark):
    data = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else "|| ## bad") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    order = {r.doc_id: k for k, r in enumerate(data.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect())}
    first = min((i for i in range(1, 60, 2) if zlib.crc32(str(i).encode()) % 5), key=order.get)
    docs = data.selectExpr("doc_id", f"IF(doc_id = {first}, repeat('x', 2000), text) AS text")
    rows = quality.training_rows(docs, labels, 1000, 3000)
    assert {r.doc_id for r in rows} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5} - {first}


def test_nulls_ties_empty_and_clashes(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "", 1.0), (2, "good", 1.0), (3, "| |", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1), (2, None), (2, 1), (3, 0), (3, 1), (3, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_scores_equal_their_definition():
    """Features hashed one by one with whole numbers, without the vectorised code."""
    whole, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(h):
        h = h * whole & mask
        h ^= h >> 32
        return h * whole & mask

    def word_hash(w):
        return mix(sum(mix((((ord(c) + 1) << 24) + place) & mask) for place, c in enumerate(f"<{w}>")) & mask)

    def features(w):
        marked, out = f"<{w}>", [word_hash(w) >> 46]
        for n in quality.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = mix((h + ord(c) + 1) & mask)
                out.append(h >> 46)
        return out

    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS + 1).astype(np.float32), 0.25)
    texts = ["the cat sat on the mat", "buy buy buy now", "a", "", None, "é 漢字 naïve naïve"]
    for text, got in zip(texts, quality.Scorer(model).scores(texts), strict=True):
        ws = (text or "").split()
        ids = [b for w in ws for b in features(w)]
        ids += [quality.BUCKETS if a == b else mix((word_hash(a) * 31 + word_hash(b)) & mask) >> 46 for a, b in zip(ws, ws[1:])]
        z = 0.25 + sum(float(model.weight[b]) for b in ids) / max(len(ids), 1)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-6


def test_labels_of_one_class_only_know_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)] + [(20, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 21 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
