"""Document fingerprints from prefix polynomial hashes.

A text of code points ``c`` has the prefix array ``h[i] = sum((c[j] + 1) * B**j for j < i)``
modulo two primes.  From it the hash of any span follows in a few steps, ``(h[j] - h[i]) / B**i``, so
any two spans are compared without reading them, and the longest common extension of two
places is found by binary search.

A fingerprint holds of a text: its length; samples of its prefix array, the hashes of its beginnings and ends of
1, 2, ... steps, where a step is the smallest power of two that gives at most ``GRID`` of
them (so the steps of two texts nest); and the ``KEPT`` smallest hashes of its spans of
``WIDTH`` code points.  Two fingerprints tell how long the beginnings and ends are that their texts share, by
binary search over the samples, and estimate what they share in other places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_rows, cut, slices

GRID, KEPT, WIDTH = 16, 32, 20
#: Hex digits of a sample and of a span in a fingerprint.
SAMPLE, SPAN = 10, 8
#: Code points hashed at once; powers are kept for so many.
BLOCK = 1 << 16
#: Primes below 2**31 and bases above all code points: products fit 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (1318699937, 911382323)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, p: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < BLOCK:
        out = np.r_[out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)]
    return out


UP = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
DOWN = [_powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True)]


class Prefixes:
    """The prefix arrays of a sequence of code points; 8 bytes a code point."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.h = np.zeros((2, self.n + 1), np.uint32)
        #: ``B**(-BLOCK * k)`` for each block.
        self.blocks = [np.array([pow(b, -BLOCK * k, p) for k in range(self.n // BLOCK + 1)], np.uint64) for b, p in zip(BASES, PRIMES, strict=True)]
        sums, scale = [0, 0], [1, 1]
        for a in range(0, self.n, BLOCK):
            own = codes[a : a + BLOCK].astype(np.uint64) + np.uint64(1)
            for m, p in enumerate(PRIMES):
                q = np.uint64(p)
                up_to = np.cumsum(own * UP[m][: len(own)] % q) % q
                self.h[m, a + 1 : a + 1 + len(own)] = (up_to * np.uint64(scale[m]) + np.uint64(sums[m])) % q
                sums[m], scale[m] = int(self.h[m, a + len(own)]), scale[m] * pow(BASES[m], BLOCK, p) % p

    def span(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans ``[i, j)``: equal spans have equal ones wherever they stand."""
        out = np.zeros(len(i), np.uint64)
        for m, p in enumerate(PRIMES):
            q = np.uint64(p)
            down = DOWN[m][i % BLOCK] * self.blocks[m][i // BLOCK] % q
            out = (out << np.uint64(31)) | (self.h[m, j] + q - self.h[m, i]) * down % q
        return out

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the texts from ``i`` and ``j`` on agree (``back``: up to ``i`` and ``j``), at most ``most`` code points."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.span(i - mid, i) == self.span(j - mid, j)) if back else (self.span(i, i + mid) == self.span(j, j + mid))
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Spread 63-bit hashes of all spans of ``WIDTH``, in blocks with their first place."""
        for a in range(0, self.n - WIDTH + 1, BLOCK):
            size = min(BLOCK, self.n - WIDTH + 1 - a)
            out = np.zeros(size, np.uint64)
            for m, p in enumerate(PRIMES):
                q = np.uint64(p)
                down = DOWN[m][:size] * self.blocks[m][a // BLOCK] % q
                out = (out << np.uint64(31)) | (self.h[m, a + WIDTH : a + WIDTH + size] + q - self.h[m, a : a + size]) * down % q
            yield a, _spread(out)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return (x * _MIX) >> np.uint64(1)


def _short(x: np.ndarray) -> np.ndarray:
    return x >> np.uint64(63 - 4 * SPAN)


def smallest(codes: np.ndarray) -> np.ndarray:
    """The ``KEPT`` smallest distinct span hashes of one text, in memory of a block."""
    kept = np.zeros(0, np.uint64)
    for _, x in Prefixes(codes).windows():
        kept = np.unique(np.r_[kept, _short(x)])[:KEPT]
    return kept


def sketches(all_: Prefixes, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``KEPT`` smallest distinct span hashes of each text on end, and how many each has.

    Only hashes below a bound that about four times as many fall under are sorted; a text with too few of
    them (it repeats itself) is looked at whole.
    """
    size = np.diff(at)
    count = np.maximum(size - WIDTH + 1, 0)
    bound = (np.minimum(1.0, 4 * KEPT / np.maximum(count, 1)) * 2.0**63).astype(np.uint64)
    edges = np.stack([at[:-1], at[:-1] + count], 1).ravel()  # where spans of a text begin, and where they would leave it
    bounds = np.stack([bound, np.zeros(len(size), np.uint64)], 1).ravel()
    docs, values = [], []
    for a, x in all_.windows():
        first, last = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, a + len(x), "left")
        own = np.clip(np.r_[edges[first:last], a + len(x)], a, a + len(x))
        place = np.flatnonzero(x < np.repeat(bounds[first:last], np.diff(own)))
        docs.append(np.searchsorted(at, a + place, "right") - 1)
        values.append(_short(x[place]))
    whole = np.flatnonzero((size > 0) & (size < WIDTH))  # shorter texts are one span
    docs.append(whole)
    values.append(_short(_spread(all_.span(at[whole], at[whole + 1]))))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])][: len(doc)]
    doc, value = doc[new], value[new]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    doc, value = doc[rank < KEPT], value[rank < KEPT]
    few = np.flatnonzero((np.bincount(doc, minlength=len(size)) < KEPT) & (bound < np.uint64(1 << 63)))
    if len(few):
        fits = ~np.isin(doc, few)
        own = [smallest(codes[at[k] : at[k + 1]]) for k in few.tolist()]
        doc, value = np.r_[doc[fits], np.repeat(few, [len(x) for x in own])], np.concatenate([value[fits], *own])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return value, np.bincount(doc, minlength=len(size))


def _hex(values: np.ndarray, digits: int) -> str:
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - digits // 2 :]).tobytes().hex()


def step_of(n: int) -> int:
    """The smallest power of two of which ``n`` holds at most ``GRID``."""
    step = 1
    while n // step > GRID:
        step *= 2
    return step


class Texts:
    """Prefix arrays and fingerprints of many texts on end."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.all = Prefixes(self.codes)

    def fingerprints(self) -> list[str]:
        step = np.array([step_of(n) for n in self.size.tolist()], np.int64)
        n = self.size // step
        text = np.repeat(np.arange(len(n)), n)
        part = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + 1) * step[text]
        drop = np.uint64(62 - 4 * SAMPLE)
        begins = _hex(self.all.span(self.at[text], self.at[text] + part) >> drop, SAMPLE)
        ends = _hex(self.all.span(self.at[text + 1] - part, self.at[text + 1]) >> drop, SAMPLE)
        value, kept = sketches(self.all, self.codes, self.at)
        spans = _hex(value, SPAN)
        s, k = (np.r_[0, np.cumsum(n)] * SAMPLE).tolist(), (np.r_[0, np.cumsum(kept)] * SPAN).tolist()
        return [f"{size:x}.{begins[s[i] : s[i + 1]]}.{ends[s[i] : s[i + 1]]}.{spans[k[i] : k[i + 1]]}" for i, size in enumerate(self.size.tolist())]


def _shared_steps(a: str, b: str, times_a: int, times_b: int, most: int) -> int:
    """The largest number of common steps whose samples agree, by binary search."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        i, j = (mid * times_a - 1) * SAMPLE, (mid * times_b - 1) * SAMPLE
        low, high = (mid, high) if a[i : i + SAMPLE] == b[j : j + SAMPLE] else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1 (1 for equal ones): the share of both texts that is a common
    beginning or end, or (if larger) in common spans; of halves exchanged, about a half."""
    if a == b:
        return 1.0
    size_a, begin_a, end_a, spans_a = a.split(".")
    size_b, begin_b, end_b, spans_b = b.split(".")
    n, m = int(size_a, 16), int(size_b, 16)
    if not n or not m:
        return 0.0
    own, other, least = step_of(n), step_of(m), min(n, m)
    step = max(own, other)
    steps = sum(_shared_steps(x, y, step // own, step // other, least // step) for x, y in ((begin_a, begin_b), (end_a, end_b)))
    at_ends = 2 * min(steps * step, least) / (n + m)
    x, y = ({s[i : i + SPAN] for i in range(0, len(s), SPAN)} for s in (spans_a, spans_b))
    least_of_both = sorted(x | y)[:KEPT]
    shared = sum(s in x and s in y for s in least_of_both) / len(least_of_both)
    return max(at_ends, 2 * shared / (1 + shared))


def edited(text: str, following: str) -> str:
    """``text`` with the last half of its code points replaced by as many of the first of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULTS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start bigint, same_end bigint"
NAMES = [f.split()[0] for f in RESULTS.split(", ")]


def compare(texts: list[str]) -> list[pa.Array]:
    """The results of all texts but the last, each with the one after it."""
    n = len(texts) - 1
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    both = Texts(texts + changed)
    prints = both.fingerprints()
    own, after, other = prints[:n], prints[1 : n + 1], prints[n + 1 :]
    k = np.arange(n)
    least = np.minimum(both.size[:n], both.size[1 : n + 1])
    start = both.all.extension(both.at[k], both.at[k + 1], least)
    end = both.all.extension(both.at[k + 1], both.at[k + 2], least, back=True)
    near = [[likeness(a, b) for a, b in zip(own, c, strict=True)] for c in (other, after)]
    hashes = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [pa.array(both.size[:n]), pa.array(hashes, pa.string()), pa.array(own, pa.string()), pa.array(other, pa.string()), pa.array(near[0], pa.float64()), pa.array(near[1], pa.float64()), pa.array(start), pa.array(end)]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_chars``, ``fingerprint``, those of the text whose last half is replaced by the first
    of the next document (``edited_sha256, edited_fingerprint``), the likeness of its fingerprint to both (``near_edited,
    near_next``), and the code points that the text and the next have in common at their beginnings and ends (``same_start,
    same_end``, exact up to collisions of 62-bit hashes).

    The next document is that of the next smaller key (null keys are the smallest), after the last the first; rows of
    one key follow the hash of their text, then any order; a single row is its own next.  Null texts count as empty.  The rows are dealt by ranges of the
    key, a row's place breaking ties, so no key fills a task; what a partition's last row needs of the next
    partition is joined afterwards, two rows a partition.  Clashing columns are replaced; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NAMES, "_t", "_h", "_tie", "_part", "_role", "_text", "_next")
    kept = [c for c in docs.columns if keep_text or c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    by = [F.col(key).desc_nulls_last(), F.col("_h"), F.col("_tie")]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumns({"_h": F.xxhash64("_t"), "_tie": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select(*kept, "_t")
    names = [*kept, *NAMES, "_part", "_role", "_text"]
    schema = f"{fields}{RESULTS}, _part int, _role int, _text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def row(own: list[pa.Array], results: list[pa.Array] | None, role: int, texts: list[str | None]) -> pa.RecordBatch:
            n = len(texts)
            results = results or [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*own, *results, pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32()), pa.array(texts, pa.string())], names=names)

        last = None  # a row whose next is not known yet: its own columns and its text
        for batch in batches:
            if not batch.num_rows:
                continue
            own, texts = [batch.column(c) for c in kept], batch.column("_t").to_pylist()
            if last is None:
                yield row([pa.nulls(1, c.type) for c in own], None, 1, texts[:1])
            else:
                yield row(last[0], compare([last[1], texts[0]]), 0, [None])
            for a, b in slices(texts[:-1], 500_000):
                yield row([c.slice(a, b - a) for c in own], compare(texts[a : b + 1]), 0, [None] * (b - a))
            last = [c.slice(len(texts) - 1) for c in own], texts[-1]
        if last:
            yield row(last[0], None, 2, [last[1]])

    table = cut(ordered.mapInArrow(run, schema), "fingerprints")
    parts = sorted(r["_part"] for r in table.where("_role = 1").select("_part").collect())  # a number a partition
    following = broadcast_rows(spark, list(zip(parts, parts[1:] + parts[:1], strict=True)), "_part int, _next int")
    first = table.where("_role = 1").select(F.col("_part").alias("_next"), F.col("_text").alias("_t"))
    open_ = table.where("_role = 2").select(*kept, "_part", "_text").join(following, "_part").join(first, "_next").select(*kept, "_text", "_t")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (a, b) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_t").to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in kept), *compare([a, b])], names=[*kept, *NAMES])

    return table.where("_role = 0").select(*kept, *NAMES).unionByName(open_.mapInArrow(close, fields + RESULTS))
