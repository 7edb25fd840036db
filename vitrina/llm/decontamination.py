"""Benchmark decontamination: BM25 retrieval of test items by training passages.

The test items are an inverted index whose postings hold each item's BM25 contribution as a
share of the score it gives itself, with the maxima of each term by blocks of items.  Every
document is read in overlapping passages, long enough that any item lies whole in one; each
passage is a query.  Passages no block of which could reach the threshold are set aside in
bulk; block-max WAND finds all items above the threshold for the others; the question and
answer of each item found are compared with the passage.  Items of like lengths share an
index, so that short ones are not sought in the long passages of long ones.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut, drop_cut, slices

K1, B = 1.2, 0.75
#: Items of a block.
BLOCK_ITEMS = 4
#: Items and words of one index, and indexes of one pass over the documents.  A word takes at most some 200 bytes
#: (its postings, and its place in the vocabulary if it is new), so an index has 20 MB at most, but for a longer single
#: item.  The statistics are those of all items, so the results do not depend on any of the three.
INDEX_ITEMS, INDEX_WORDS, INDEXES = 20_000, 100_000, 10
#: Words of the items of the first index of lengths; each later one has items of up to four times as many.
LENGTHS = 64
#: Items of fewer words say nothing; items of fewer than ``WHOLE`` must stand in a text word for word.
LEAST, WHOLE = 3, 8
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(ws: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last quarter, of three words at least, answers."""
    n = min(len(ws), max(3, len(ws) // 4))
    return ws[: len(ws) - n], ws[len(ws) - n :]


def grams(ws: list[str], n: int = 3) -> set[tuple]:
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def overlap(passage: list[str], item: list[str]) -> tuple[float, float]:
    """Shares of the question's word triples (words, if it has under three) and of the
    answer's words that the passage has; of an item under ``WHOLE`` words all or nothing."""
    n = len(item)
    if n < WHOLE:
        whole = float(n >= LEAST and any(passage[i : i + n] == item for i in range(len(passage) - n + 1)))
        return whole, whole
    question, answer = parts(item)
    have = set(passage)
    a = sum(w in have for w in answer) / len(answer)
    if len(question) < 3:
        return (sum(w in have for w in question) / len(question) if question else a), a
    asked = grams(question)
    return len(asked & grams(passage)) / len(asked), a


def group(words_: int) -> int:
    """The group of lengths of an item: up to 64 words, up to 256, ..."""
    k, most = 0, LENGTHS
    while words_ > most:
        k, most = k + 1, most * 4
    return k


class Index:
    """BM25 postings of the items in flat arrays, with maxima by term and by block of postings."""

    def __init__(self, items: list[tuple], whole: tuple[dict[str, int], int, float, int] | None = None):
        """``items``: (id, text); those without words are left out.  ``whole``: if they are a part
        of the benchmark, its document frequencies (of the part's words), its number of items, their
        mean length, and the greatest length in the group."""
        split = sorted(((i, ws) for i, t in items if (ws := words(t))), key=lambda x: (x[0] is None, x[0]))
        self.ids = [i for i, _ in split]
        lengths = [len(ws) for _, ws in split]
        df, number, mean, self.longest = whole or (Counter(w for _, ws in split for w in set(ws)), len(split), sum(lengths) / max(1, len(split)), max(lengths, default=1))
        idf = {w: math.log(1 + (number - k + 0.5) / (k + 0.5)) for w, k in df.items()}
        self.vocabulary = {w: k for k, w in enumerate(df)}
        # The items' words as numbers on end, and where each item's begin.
        self.tokens = np.array([self.vocabulary[w] for _, ws in split for w in ws], np.int32)
        self.token_at, self.names = np.r_[0, np.cumsum(lengths, dtype=np.int64)], list(self.vocabulary)
        terms, items_, shares = [], [], []
        for item, (_, ws) in enumerate(split):
            weight = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for w, tf in Counter(ws).items()}
            own = sum(weight.values())
            terms.append(np.array([self.vocabulary[w] for w in weight], np.int32))
            items_.append(np.full(len(weight), item, np.int32))
            shares.append(np.array([x / own for x in weight.values()], np.float64))
        term, self.items, self.shares = (np.concatenate([none, *own]) for none, own in ((np.zeros(0, np.int32), terms), (np.zeros(0, np.int32), items_), (np.zeros(0), shares)))
        order = np.lexsort((self.items, term))
        term, self.items, self.shares = term[order], self.items[order].astype(np.int32), self.shares[order]
        self.at = np.searchsorted(term, np.arange(len(df) + 1))
        # A term's blocks and the largest share in each, rounded up.
        block = self.items // BLOCK_ITEMS
        new = np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])] if len(term) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.blocks = block[starts]
        most = np.maximum.reduceat(self.shares, starts) if len(starts) else np.zeros(0)
        self.block_most = np.nextafter(most.astype(np.float32), np.float32(2))
        self.block_at = np.searchsorted(term[starts], np.arange(len(df) + 1))
        self.most = np.maximum.reduceat(self.block_most, self.block_at[:-1]) if len(df) else np.zeros(0, np.float32)

    def item_words(self, item: int) -> list[str]:
        return [self.names[t] for t in self.tokens[self.token_at[item] : self.token_at[item + 1]].tolist()]

    def posting(self, term: int) -> list[tuple[int, float]]:
        own = slice(self.at[term], self.at[term + 1])
        return list(zip(self.items[own].tolist(), self.shares[own].tolist(), strict=True))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose share by ``terms`` is at least ``threshold``, by block-max WAND."""
        cursors = []  # next item, place in the list, items, shares, blocks, their maxima, the term's maximum
        for t in terms:
            own, of = slice(self.at[t], self.at[t + 1]), slice(self.block_at[t], self.block_at[t + 1])
            items = self.items[own].tolist()
            if items:
                cursors.append([items[0], 0, items, self.shares[own].tolist(), self.blocks[of].tolist(), self.block_most[of].tolist(), float(self.most[t])])

        def forward(c: list, item: int) -> bool:
            c[1] = bisect_left(c[2], item, c[1])
            if c[1] < len(c[2]):
                c[0] = c[2][c[1]]
                return True
            return False

        def most_in(c: list, block: int) -> float:
            k = bisect_left(c[4], block)
            return c[5][k] if k < len(c[4]) and c[4][k] == block else 0.0

        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[6]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(most_in(c, block) for c in cursors[: pivot + 1]) < threshold - 1e-6:
                # No item before the next block or the next cursor can reach it.
                then = min([(block + 1) * BLOCK_ITEMS, *(c[0] for c in cursors[pivot + 1 : pivot + 2])])
                cursors = [c for k, c in enumerate(cursors) if k > pivot or forward(c, then)]
            elif cursors[0][0] == item:
                score = math.fsum(c[3][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                cursors = [c for k, c in enumerate(cursors) if k > pivot or forward(c, item + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= item or forward(c, item)]
        return found

    def passages(self, split: list[list[str]], threshold: float) -> Iterator[tuple[int, int, list[int]]]:
        """(document, first word, terms) of each passage with a block whose maxima reach the
        threshold.  Passage k of a document has 2 x ``longest`` words from k x ``longest``."""
        if not len(self.most):
            return
        get, step = self.vocabulary.get, self.longest
        counts = np.array([len(ws) for ws in split], np.int64)
        terms = np.fromiter((get(w, -1) for ws in split for w in ws), np.int64, counts.sum())
        doc = np.repeat(np.arange(len(split)), counts)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = terms >= 0
        terms, doc, window = terms[known], doc[known], place[known] // step
        first = np.r_[0, np.cumsum(counts // step + 1)]
        later = window > 0
        at = np.r_[first[doc] + window, (first[doc] + window - 1)[later]]
        key = np.unique(at * len(self.most) + np.r_[terms, terms[later]])
        at, terms = key // len(self.most), key % len(self.most)
        enough = np.bincount(at, self.most[terms], first[-1]) >= threshold - 1e-6
        keep = enough[at]
        at, terms = at[keep], terms[keep]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        ends = np.r_[starts[1:], len(at)] if len(at) else at
        blocks = int(self.blocks.max()) + 1 if len(self.blocks) else 1
        size = self.block_at[terms + 1] - self.block_at[terms]
        work = np.r_[0, np.cumsum(size)]
        a = 0
        while a < len(starts):  # sums of maxima by passage and block, of a bounded number of cells and terms at once
            b = max(a + 1, min(a + max(1, 2_000_000 // blocks), int(np.searchsorted(work[ends], work[starts[a]] + 2_000_000, "right"))))
            own, n = terms[starts[a] : ends[b - 1]], size[starts[a] : ends[b - 1]]
            row = np.repeat(np.repeat(np.arange(b - a), ends[a:b] - starts[a:b]), n)
            which = np.arange(n.sum()) + np.repeat(self.block_at[own] - (np.cumsum(n) - n), n)
            bounds = np.bincount(row * blocks + self.blocks[which], self.block_most[which], (b - a) * blocks).reshape(b - a, blocks)
            for k in np.flatnonzero(bounds.max(1) >= threshold - 1e-4).tolist():
                w = int(at[starts[a + k]])
                d = int(np.searchsorted(first, w, "right")) - 1
                yield d, (w - int(first[d])) * step, terms[starts[a + k] : ends[a + k]].tolist()
            a = b

    def matches(self, split: list[list[str]], threshold: float, question: float, answer: float) -> list[tuple]:
        """(text, item id, score, question overlap, answer overlap) of all verified matches of texts
        in words, one for each text and item (the best passage)."""
        best: dict[tuple, tuple] = {}
        for d, start, terms in self.passages(split, threshold):
            for item, score in self.search(terms, threshold):
                q, a = overlap(split[d][start : start + 2 * self.longest], self.item_words(item))
                if q >= question and a >= answer:
                    best[d, item] = max(best.get((d, item), (0, 0, 0)), (q, a, score))
        return [(d, self.ids[item], score, q, a) for (d, item), (q, a, score) in sorted(best.items())]


def indexes(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Indexes over all items with the statistics of the whole benchmark, by passes over the documents: ``INDEXES`` a pass, one pass as a
    rule.  Tasks build them, each from the items of its part and the frequencies of their words; the driver gets
    those of one pass at a time, as bytes, and broadcasts them as ``(name, bytes)``."""
    spark = benchmark.sparkSession
    split = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [words(t) for t in batch.column("text").to_pylist()]
            cols = [batch.column("item_id"), batch.column("text"), pa.array([group(len(w)) for w in ws], pa.int32()), pa.array(map(len, ws), pa.int64()), pa.array([list(set(w)) for w in ws], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "text", "length", "size", "words"])

    fields = f"item_id {split.schema['item_id'].dataType.simpleString()}, text string, length int, size bigint, words array<string>"
    counted = cut(split.mapInArrow(count, fields).where("size > 0"), "items")
    groups = counted.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("size").alias("longest")).orderBy("length").collect()  # a row a group of lengths
    number, total = sum(g.n for g in groups), sum(g.size for g in groups)
    mean, longest = total / max(1, number), {g.length: g.longest for g in groups}
    parts = {g.length: max(1, -(-g.n // INDEX_ITEMS), -(-g.size // INDEX_WORDS)) for g in groups}
    part = F.lit(0)
    for length, k in parts.items():
        part = F.when(F.col("length") == length, F.pmod(F.xxhash64("item_id", "text"), F.lit(k))).otherwise(part)
    own = counted.withColumn("part", part.cast("int"))
    frequencies = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    of_part = own.select(F.col("length").alias("_length"), F.col("part").alias("_part"), F.explode("words").alias("word")).distinct().join(frequencies, "word")

    def build(items: pa.Table, known: pa.Table) -> pa.Table:
        rows = list(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True))
        df = dict(sorted(zip(known.column("word").to_pylist(), known.column("n").to_pylist(), strict=True)))
        index = Index(rows, (df, number, mean, longest[items.column("length")[0].as_py()]))
        return pa.table({"length": items.column("length")[:1], "part": items.column("part")[:1], "data": pa.array([pickle.dumps(index)], pa.binary())})

    if groups:
        both = own.select("length", "part", "item_id", "text").groupBy("length", "part").cogroup(of_part.groupBy("_length", "_part"))
        built = cut(both.applyInArrow(build, "length int, part int, data binary"), "indexes")
        keys = [(length, k) for length, n in parts.items() for k in range(n)]
        for a in range(0, len(keys), INDEXES):
            wanted = keys[a : a + INDEXES]
            some = built.where(F.struct("length", "part").isin([F.struct(F.lit(g), F.lit(k)) for g, k in wanted])).orderBy("length", "part").collect()
            yield [(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(r.data))) for r in some]
        drop_cut(built)
    else:
        yield []
    drop_cut(counted)


_opened: dict[str, Index] = {}


def opened(shared: list[tuple]) -> list[Index]:
    """The indexes of a pass, read from their bytes once in a worker; those of other passes are left."""
    names = {name for name, _ in shared}
    for name in [n for n in _opened if n not in names]:
        del _opened[name]
    for name, data in shared:
        if name not in _opened:
            _opened[name] = pickle.loads(data.value)
    return [_opened[name] for name, _ in shared]


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """A row for each document and test item it holds: all columns of ``docs`` but the text,
    ``item_id, score`` (share of the item's own BM25 score), ``question_overlap`` and ``answer_overlap``.

    Null and empty texts and items match nothing; repeated rows match alike; items of equal
    text are all reported; clashing columns are replaced; empty tables give an empty result.
    Items of fewer than ``LEAST`` words match nothing, those of fewer than ``WHOLE`` only word for word.
    The documents are read once for each ``INDEXES`` indexes, of ``INDEX_ITEMS`` items and about ``INDEX_WORDS`` words each; the
    result is the same for any number.  The driver holds the bytes of the indexes of a pass, a few dozen MB, and a worker
    the indexes.
    """
    added = ["item_id", "score", "question_overlap", "answer_overlap"]
    docs = docs.drop(*added)
    kept = [c for c in docs.columns if c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    out = None
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_indexes = opened(shared)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in slices(texts):
                    split = [words(t) for t in texts[a:b]]
                    found = [m for index in own_indexes for m in index.matches(split, threshold, question, answer)]
                    if found:
                        at = pa.array([a + m[0] for m in found])
                        own = [batch.column(c).take(at) for c in kept]
                        new = [pa.array([m[k] for m in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                        yield pa.RecordBatch.from_arrays([*own, *new], names=[*kept, *added])

        some = docs.mapInArrow(run, f"{fields}item_id bigint, score double, question_overlap double, answer_overlap double")
        out = some if out is None else out.unionByName(some)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns; options as for :func:`find`."""
    rows = docs
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            options, own_indexes = {"threshold": 0.5, "question": 0.5, "answer": 0.5} | limits, opened(shared)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                keep = np.ones(len(texts), bool)
                for a, b in slices(texts):
                    split = [words(t) for t in texts[a:b]]
                    keep[[a + m[0] for index in own_indexes for m in index.matches(split, **options)]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows
