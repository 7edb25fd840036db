"""Quality classifier on supervised subword embeddings.

A text's features are its words, the character 3- and 4-grams of each word between word
marks, and its word pairs (a word that repeats the one before counts as the pair
``again``), all hashed to one table of learned vectors.  The vectors are averaged per
document and a softmax over the two labels follows.  The model is fitted by stochastic
gradient descent in numpy on a bounded sample of labelled rows; as the output is linear in
the average, scoring needs one number per hashed feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut, drop_cut, slices

BUCKETS = 1 << 18
GRAMS = (3, 4)
#: Words, and their characters, whose features one task remembers (some 150 bytes a word more).
KNOWN_WORDS, KNOWN_CHARS = 200_000, 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = BUCKETS  # the bucket of a repeated word


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes (wrap-around multiplication, xor of the high half)."""
    h = h * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


class Words:
    """Numbers the distinct words and hashes their features, each once while remembered."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.hash = np.zeros(0, np.uint64)

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Word numbers of all texts on end, the number of words of each, and the new words."""
        split = [(t or "").split() for t in texts]
        number = self.number
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in number))
        if len(number) + len(new) > KNOWN_WORDS or self.chars + sum(map(len, new)) > KNOWN_CHARS:
            self.clear()
            number, new = self.number, list(dict.fromkeys(w for ws in split for w in ws))
        self.chars += sum(map(len, new))
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        get = number.__getitem__
        counts = np.array([len(ws) for ws in split], np.int64)
        flat = np.fromiter((n for ws in split for n in map(get, ws)), np.int64, counts.sum())
        return flat, counts, new

    def features(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words' own features on end, and which word each is of; remembers
        the words' hashes."""
        text = "<" + "><".join(new) + ">" if new else ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = np.array([len(w) + 2 for w in new], np.int64)
        word = np.repeat(np.arange(len(new)), size)
        place = np.arange(len(points))
        end = np.cumsum(size)[word] if len(new) else place
        # A word's hash: the sum of its mixed (place, character) pairs.
        own = _mix((points << np.uint64(24)) + (place - (end - size[word] if len(new) else 0)).astype(np.uint64))
        first = np.cumsum(size) - size
        hashes = _mix(np.add.reduceat(own, first)) if len(new) else np.zeros(0, np.uint64)
        self.hash = np.r_[self.hash, hashes]
        buckets, words = [_bucket(hashes)], [np.arange(len(new))]
        for n in GRAMS:
            starts = np.flatnonzero(place + n <= end)
            h = np.full(len(starts), n, np.uint64)
            for k in range(n):
                h = _mix(h + points[starts + k])
            buckets.append(_bucket(h))
            words.append(word[starts])
        return np.concatenate(buckets), np.concatenate(words)

    def pairs(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the word pairs inside texts, and which text each is in."""
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else doc
        a, b = flat[inside], flat[inside + 1]
        h = _bucket(_mix(self.hash[a] * np.uint64(31) + self.hash[b]))
        return np.where(a == b, _AGAIN, h), doc[inside]


@dataclass
class Model:
    """``weight``: each bucket's share of the log-odds of label 1; ``bias``: of no features."""

    weight: np.ndarray
    bias: float


def fit(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.2, seed: int = 7) -> Model:
    """Fit vectors and softmax by gradient descent, one document a step; both labels count
    alike in total.  With no rows of one label the model knows nothing and scores 0.5."""
    labels_ = np.array(labels, np.int64)
    by_label = np.bincount(labels_, minlength=2)
    if not by_label.all():
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    words = Words()
    docs = []
    for a, b in slices(texts):
        words.clear()
        flat, counts, new = words.split(texts[a:b])
        bucket, word = words.features(new)
        order = np.argsort(word, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(word, minlength=len(new)))
        pair, pair_doc = words.pairs(flat, counts)
        at, pair_at = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(np.bincount(pair_doc, minlength=b - a))]
        for k in range(b - a):
            numbers, n = np.unique(flat[at[k] : at[k + 1]], return_counts=True)
            size = ends[numbers] - np.r_[0, ends][numbers]
            where = np.arange(size.sum()) + np.repeat(ends[numbers] - np.cumsum(size), size)
            ids = np.r_[bucket[where], pair[pair_at[k] : pair_at[k + 1]]]
            weight = np.r_[np.repeat(n, size), np.ones(pair_at[k + 1] - pair_at[k])]
            ids, back = np.unique(ids, return_inverse=True)
            weight = np.bincount(back, weight, len(ids))
            docs.append((ids.astype(np.int32), (weight / max(weight.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS + 1, dim), np.float32) - 0.5) / dim
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    out[1] = rng.normal(0, 0.1, dim)
    share = len(labels_) / (2 * by_label)
    touched = np.zeros(BUCKETS + 1, bool)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            ids, weight = docs[k]
            touched[ids] = True
            lr = rate * (1 - done / steps)
            done += 1
            mean = weight @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels_[k]] -= 1
            p *= share[labels_[k]]
            back = p @ out
            out -= lr * p[:, None] * mean
            bias -= np.float32(0.1 * lr) * p
            if len(ids):  # the weights sum to 1: scaled up to the size of a sparse step
                vectors[ids] -= (lr * np.minimum(weight * len(ids), 20.0))[:, None] * back
    vectors[~touched] = 0  # unseen features say nothing
    return Model(((vectors @ out[1]) - (vectors @ out[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores slices of texts with one model."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.sum = np.zeros(0)
        self.count = np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = len(self.words.number)
        flat, counts, new = self.words.split(texts)
        if len(self.words.number) != known + len(new):  # the memory was emptied
            self.sum, self.count = np.zeros(0), np.zeros(0)
        bucket, word = self.words.features(new)
        self.sum = np.r_[self.sum, np.bincount(word, self.model.weight[bucket], len(new))]
        self.count = np.r_[self.count, np.bincount(word, minlength=len(new))]
        doc = np.repeat(np.arange(len(texts)), counts)
        pair, pair_doc = self.words.pairs(flat, counts)
        total = np.bincount(doc, self.sum[flat], len(texts)) + np.bincount(pair_doc, self.model.weight[pair], len(texts))
        n = np.bincount(doc, self.count[flat], len(texts)) + np.bincount(pair_doc, minlength=len(texts))
        z = self.model.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def held_out(key: str = "doc_id"):
    """Rows never learned from: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, most_bytes: int) -> list:
    """A bounded sample of labelled rows: of each label the ``per_label`` rows of smallest
    hash, without those whose texts don't fit in what is left of ``most_bytes``.  Rows with null keys or labels or both
    labels at once (the lower counts) and held-out rows follow these rules, not chance."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(per_label).unionByName(known.where("quality = 1").orderBy(*order).limit(per_label))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most 2 * per_label rows
    found = cut(found, "quality-sample")
    fits, used = [], {0: 0, 1: 0}
    for r in found.select("doc_id", "quality", F.octet_length("text").alias("size")).orderBy(*order).collect():
        if used[r.quality] + r.size <= most_bytes // 2:  # a row that doesn't fit leaves its room to later ones
            used[r.quality] += r.size
            fits.append(r.doc_id)
    rows = found.where(F.col("doc_id").isin(fits)).orderBy("doc_id").collect()
    drop_cut(found)
    return rows


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 1000, most_bytes: int = 32_000_000) -> DataFrame:
    """All rows and columns of ``docs`` plus ``held_out``, ``score`` (0 to 1, higher: label 1 is
    likelier) and ``predicted``.

    Fitted on at most ``2 * per_label`` labelled rows of at most ``most_bytes`` text on the
    driver (both are bounds of memory, not of what is scored); every whole text is scored.
    Null texts count as empty; empty texts score by the bias alone; a null key is not held
    out; repeated rows score alike; with no usable labels every score is 0.5.  Columns that
    clash with the added ones are replaced; an empty table gives an empty result.
    """
    rows = training_rows(docs, labels, per_label, most_bytes)
    model = fit([r.text for r in rows], [r.quality for r in rows])
    return score(docs, model, threshold)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    docs = docs.drop("held_out", "score", "predicted")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per bucket, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                own = [batch.column(c).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scorer.scores(texts[a:b]), pa.float64())], names=[*kept, "score"])

    scored = docs.mapInArrow(run, f"{fields}, score double")
    return scored.select(*kept, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
