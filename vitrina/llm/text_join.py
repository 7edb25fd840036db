"""N-gram Jaccard join on count vectors.

A text's distinct word n-grams are hashed to groups; how many fall in each group is its point.
Of two linked texts of sizes n <= m at most ``D = (1 - t) / t * n`` n-grams are in one only, and
the sum of the smaller counts over the groups is no less than what they share.

* **Blocks.**  The groups are dealt to more than D blocks, so the sub-points of linked texts
  agree in all but D blocks.  A text is entered with its D + 1 fullest blocks only (and those
  as full as the last), D being that of its own size or of the largest smaller partner in the
  class, whichever is less: blocks that agree are equally full, so the fullest of them is
  entered by both.  Rows that agree in a block meet by a shuffle on block and sub-point; no
  text is compared with all of its size, and shared passages rarely fill such blocks.
* **First links.**  In each meeting every text is held against the one first numbered only:
  the bound by summed minima, then the exact sets.  A group of copies thus costs its size.
* **R-tree.**  Meetings that are not yet of one component get an R-tree of their points:
  a search descends where the summed minima with the upper corner of a box still allow a
  link.  What comes of a meeting is its texts that have a partner left, never the pairs.
* **Verification.**  Only those texts meet again, all at once that hang together by meetings,
  with their sets: texts that share no rare n-gram are left out, a second search verifies the pairs that are not connected yet and keeps a
  forest of the links, so no more than ``n - 1`` rows come out of ``n``.  Meetings are dealt to
  tasks by bytes.

Sets of n-grams are 64-bit hashes, equal sets are told by 128 bits and numbered, so two
classes never share a name.  Nothing is dropped: all pairs that can link are verified or
known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import broadcast_if_small, components, cut, drop_cut, slices

#: Size classes: a class ends at this multiple of its start.
CLASS_RATIO = 1.6
#: Dimensions of the points that bound overlaps, texts in an R-tree leaf, children of a node.
DIMENSIONS, LEAF = 256, 16
#: Meetings of so few texts are searched at once.
FEW = 16
#: Bytes of one meeting that one task compares with as many others at once, bytes of meetings
#: that are searched in one task at a time, and pairs bounded at a time.
PART_BYTES, BIN_BYTES, STEP = 2 << 20, 6 << 20, 4096
#: Bytes of a row without its set, or with its point.
ROW_BYTES, POINT_BYTES = 100, 1100
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective spread of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A number for each group of n-grams.
_GROUPS = mix(np.arange(1 << 16, dtype=np.uint64) + _MULTIPLY) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_SPACE = " \t\n\v\f\r"


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: words are runs without ASCII white space,
    A-Z lower-cased; with fewer than n words the whole sequence is one; none without words."""
    split = pc.ascii_split_whitespace(pa.array([(t or "").encode().lower().strip() for t in texts], pa.binary()).cast(pa.string()))
    words = split.flatten().dictionary_encode()
    flat = word_hashes(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
    start = split.offsets.to_numpy()[:-1].astype(np.int64)
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    counts[[not (t and t.strip(_SPACE)) for t in texts]] = 0  # such a text is split to one empty word
    grams = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for k in range(n):
        grams = mix(grams + flat[k : k + len(grams)] * _MULTIPLY + np.uint64(k))
    out = []
    for a, c in zip(start.tolist(), counts.tolist(), strict=True):
        if c >= n:
            h = np.sort(grams[a : a + c - n + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif c:
            h = np.full(1, c, np.uint64)
            for w in flat[a : a + c]:
                h = mix(h * _MULTIPLY + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: two sums of its mixed members."""
    with np.errstate(over="ignore"):
        a = int(mix(s).sum(dtype=np.uint64))
        b = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a - (1 << 64 if a >> 63 else 0), b - (1 << 64 if b >> 63 else 0)


class Blocks:
    """Size classes and the blocks of each, for a threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * CLASS_RATIO)))

    def differ(self, n: int) -> int:
        """The most n-grams in one set only, of linked sets the smaller of which has ``n``."""
        return (self.den - self.num) * n // self.num

    def blocks(self, size_class: int) -> int:
        """More blocks than linked sets can differ in, the smaller one of this class; a quarter
        more, so that the fullest are well filled."""
        d = self.differ(self.starts[size_class + 1] - 1)
        return d + 1 + d // 4

    def classes(self, n: int) -> list[int]:
        """The classes a set of ``n`` meets in: its own, and those of smaller partners."""
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        least = -(-self.num * n // self.den)
        return [c for c in range(own + 1) if c == own or self.starts[c + 1] > least]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One number for each class, block and sub-point of the sorted set.  Its upper bits
        deal an n-gram to a block, so blocks are runs.  A sub-point has the counts of the 2^16
        groups of its block, given by the sum of the groups' mixed numbers."""
        out = []
        n, upper, group = len(s), s >> np.uint64(32), _GROUPS[s & np.uint64(0xFFFF)]
        for c in self.classes(n):
            b = self.blocks(c)
            if b == 1:  # linked sets are equal here
                continue
            size = np.bincount(((upper * np.uint64(b)) >> np.uint64(32)).astype(np.int64), minlength=b)
            held = np.flatnonzero(size)
            sums = np.zeros(b, np.uint64)
            sums[held] = np.add.reduceat(group, (np.cumsum(size) - size)[held])
            # Blocks that may disagree: the smaller set is of class c and no larger than this one,
            # so fewer than b, also where this set is the larger one and alone could differ in more.
            most = min(self.differ(n), self.differ(self.starts[c + 1] - 1))
            named = np.flatnonzero(size >= np.partition(size, b - 1 - most)[b - 1 - most])
            sums = sums[named]
            salt = np.uint64(c * 1_000_003 + 7)
            out.append(mix(sums + mix(named.astype(np.uint64) * _MULTIPLY + mix(np.full(1, salt, np.uint64)))))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the set's n-grams in ``DIMENSIONS`` groups."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=DIMENSIONS).astype(np.int32)


def may_link(a: np.ndarray, b: np.ndarray, na, nb, num: int, den: int):
    """Whether the summed minima of points leave room for a link (also for box corners ``b``,
    with the least size ``nb`` in the box)."""
    return (num + den) * np.minimum(a, b).sum(-1, dtype=np.int64) >= num * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both) and both > 0


class RTree:
    """A bulk-loaded R-tree of points: leaves of ``LEAF`` neighbours in sorted order, boxes by
    their upper corners and least sizes, nodes of ``LEAF`` boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            p, n = self.levels[-1]
            at = np.arange(0, len(n), LEAF)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(n, at)))

    def search(self, num: int, den: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions ``(i, j)`` of pairs of points that the bound leaves, of those for which
        ``wanted(i, j)`` holds, few at a time.  All points descend together, ``STEP`` at a time."""
        points, sizes = self.points, self.sizes
        todo = [(len(self.levels) - 1, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while todo:
            depth, i, at = todo.pop()
            if len(i) > STEP:
                todo += [(depth, i[k : k + STEP], at[k : k + STEP]) for k in range(0, len(i), STEP)]
                continue
            if not depth:
                keep = wanted(i, self.order[at])
                i, at = i[keep], at[keep]
            corners, least = self.levels[depth]
            keep = may_link(corners[at], points[i], least[at], sizes[i], num, den)
            i, at = i[keep], at[keep]
            if not len(i):
                continue
            if not depth:
                yield i, self.order[at]
                continue
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            i = np.repeat(i, LEAF)
            keep = at < len(self.levels[depth - 1][1])
            todo.append((depth - 1, i[keep], at[keep]))


def across(side: np.ndarray):
    """Which pairs of a meeting are its own: those of two sides of a split meeting, all if it
    has one side (pairs within a side are found by the task of that side)."""
    one = bool((side == side[0]).all())
    return lambda i, j: (j < i) if one else (j < i) & (side[j] != side[i])


def partnered(groups: np.ndarray, sizes: np.ndarray, points: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each row of a meeting has a partner that the R-tree leaves: both rows of each
    pair that is not connected already (equal ``groups``).  Once both rows of a pair are marked it
    is not looked at any more."""
    marked, own = np.zeros(len(sizes), bool), across(side)

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return own(i, j) & (groups[j] != groups[i]) & ~(marked[i] & marked[j])

    for i, j in RTree(points, sizes).search(num, den, wanted):
        marked[i] = marked[j] = True
    return marked


def promising(groups: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Positions of the rows of a meeting that can link at all.  With each set's members in the order of how many sets of the meeting
    have them, rarest first, one of the first ``n - ceil(2 t / (1 + t) * n) + 1`` of the smaller of two linked sets is among the first
    ``m - ceil(t * m) + 1`` of the larger: so texts that only have a template in common, whose rare members are their
    own, are left out together."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((member, times[member], row))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    group, out = np.unique(groups, return_inverse=True)[1], np.zeros(len(sets), bool)
    held = []
    for needed in (-(-num * size // den), -(-2 * num * size // (num + den))):
        first = order[place < np.repeat(size - needed + 1, size)]
        x, r = member[first], row[first]
        least, most = np.full(len(times), len(sets), np.int64), np.full(len(times), -1, np.int64)
        np.minimum.at(least, x, group[r])
        np.maximum.at(most, x, group[r])
        held.append((x, r, least, most))
    for (x, r, _, _), (_, _, least, most) in (held, held[::-1]):  # a member of one kind that another group has of the other kind
        other = (most[x] >= 0) & ((least[x] != group[r]) | (most[x] != group[r]))
        out[r[other]] = True
    return np.flatnonzero(out)


def linking(groups: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links of a meeting: positions of linked pairs that connect all that its
    links connect, ``groups`` being connected already."""
    root = np.unique(groups, return_inverse=True)[1].tolist()
    own, kept = across(side), []
    tops = list(range(max(root) + 1))

    def top(k: int) -> int:
        while tops[k] != k:
            tops[k] = tops[tops[k]]
            k = tops[k]
        return k

    now = np.array(root)

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return own(i, j) & (now[j] != now[i])

    some = promising(groups, sets, num, den) if len(sets) > FEW else np.arange(len(sets))
    if len(some) < 2:
        return kept
    points, sizes = np.stack([point(sets[k]) for k in some.tolist()]), np.array([len(sets[k]) for k in some.tolist()])
    for i, j in RTree(points, sizes).search(num, den, lambda i, j: wanted(some[i], some[j])):
        i, j = some[i], some[j]
        links = len(kept)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(root[a]), top(root[b])
            if p != q and linked(sets[a], sets[b], num, den):
                tops[max(p, q)] = min(p, q)
                kept.append((a, b))
        if len(kept) > links:
            now = np.array([top(r) for r in root])
    return kept


def meeting_ends(table: pa.Table) -> list[tuple[int, int]]:
    """The ranges of the meetings in a table sorted by them."""
    names = np.stack([table.column(c).to_numpy() for c in ("key", "part_p", "part_q")])
    ends = [*(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
    return list(zip([0, *ends], ends))


def once(rows: DataFrame) -> DataFrame:
    """``(key)``: one meeting of ``rows(key, c, ...)`` for each set of members (told by 128 bits)."""
    sums = [F.sum(F.xxhash64("c", F.lit(k)).cast("decimal(38,0)")).alias(f"_{k}") for k in (0, 1)]
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *sums).groupBy("_n", "_0", "_1").agg(F.min("key").alias("key")).select("key")


def dealt(rows: DataFrame, weight: Column, total: int) -> DataFrame:
    """``rows(key, c, ...)`` of meetings with ``part, part_p, part_q`` and a ``bin`` of bounded bytes: a meeting of more than ``PART_BYTES``
    is split by row, and every two parts of it meet in a task of their own; small ones share a bin.
    ``total``: bytes of all."""
    weighed = rows.groupBy("key").agg(F.ceil(F.sum(weight) / PART_BYTES).cast("int").alias("_parts"))
    rows = rows.join(weighed, "key").withColumn("part", F.pmod(F.xxhash64("c"), F.col("_parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("p"), F.greatest(k, F.col("part")).alias("q")))
    rows = rows.withColumn("_m", F.explode(meets)).withColumns({"part_p": F.col("_m.p"), "part_q": F.col("_m.q")}).drop("_m", "_parts")
    return rows.withColumn("bin", F.pmod(F.xxhash64("key", "part_p", "part_q"), F.lit(total // BIN_BYTES + 1)))


def classify(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, text_hash`` (xxhash64) for every row of ``docs``.

    Rows link if ``den * intersection >= num * union`` of their sets of word n-grams (see
    :func:`shingle_sets`); ``component_id`` is the smallest key reachable by links.  Null and
    empty texts, and texts without words, have no n-grams and link with nothing (a null key
    among them is its own component, null).  Null keys count as larger than any in components;
    rows of one key are rows of their own with the smallest key of their component; other
    columns are not read; an empty table gives an empty result.
    """
    spec = Blocks(num, den)
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                f, g = zip(*map(fingerprint, sets), strict=True)
                cols = [batch.column("k").slice(a, b - a), batch.column("h").slice(a, b - a), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], f, g)), pa.array([spec.keys(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "h", "size", "f", "g", "keys"])

    marked = cut(rows.mapInArrow(mark, "k bigint, h bigint, size bigint, f bigint, g bigint, keys array<bigint>"), "text-keys")
    # Keys that more than one row has, by 32 of their bits: a superset in rows of half the width.
    own = marked.select(F.xxhash64("f", "g").alias("x"), F.explode("keys").alias("key")).withColumn("short", F.col("key").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    often = cut(own.groupBy("short").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("short"), "text-often")
    members = cut(own.join(often, "short", "left_semi").select("key", "x").distinct(), "text-members")
    # Equal sets are one class, numbered, with its smallest key.  Members find their class by 64
    # bits: should two classes share them, both meet for each other, which links nothing falsely.
    base = cut(marked.select("k", "h", "size", "f", "g"), "text-rows")
    drop_cut(marked)
    drop_cut(often)
    classes = base.where("size > 0").groupBy("f", "g").agg(F.min(F.struct(F.col("k").isNull().alias("z"), "k", "h")).alias("first"), F.min("size").alias("size"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("c"), "f", "g", F.col("first.k").alias("rep"), F.col("first.h").alias("rep_h"), "size"), "text-classes")
    met = cut(members.join(classes.select(F.xxhash64("f", "g").alias("x"), "c", "size"), "x").select("key", "c", "size"), "text-met")
    drop_cut(members)
    meetings = met.groupBy("key").agg(F.min(F.struct("c", "size")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(met.join(meetings, "key"), "text-members")
    drop_cut(met)
    star = members.where("c != a.c").where(f"least(size, a.size) * {den} >= greatest(size, a.size) * {num}")
    edges = cut(star.select(F.col("c").alias("x"), F.col("a.c").alias("a")).distinct(), "text-edges")

    # The sets of the classes that meet any other, made again from one of their rows.
    wanted = cut(members.select("c").distinct().join(classes, "c").select("c", "rep", "rep_h"), "text-wanted")
    reps = broadcast_if_small(wanted, wanted.count(), 56)
    again = rows.join(reps, F.col("k").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")))
    again = again.groupBy("c").agg(F.any_value("t").alias("t"))  # repeated rows once

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                points = [point(s).astype("<i4").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(points, pa.binary())], names=["c", "s", "p"])

    sets = cut(again.mapInArrow(remake, "c bigint, s array<bigint>, p binary").withColumn("size", F.size("s").cast("bigint")), "text-sets")
    drop_cut(wanted)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                b = batch.slice(k, STEP)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<i4").reshape(-1, DIMENSIONS) for c in ("px", "pa"))
                yield b.select(["x", "a"]).filter(pa.array(may_link(x, y, b.column("nx").to_numpy(), b.column("na").to_numpy(), num, den)))

    points = edges.join(sets.select(F.col("c").alias("x"), F.col("p").alias("px"), F.col("size").alias("nx")), "x")
    points = points.join(sets.select(F.col("c").alias("a"), F.col("p").alias("pa"), F.col("size").alias("na")), "a")
    left = cut(points.select("x", "a", "px", "pa", "nx", "na").mapInArrow(bounded, "x bigint, a bigint"), "text-edges")
    drop_cut(edges)
    # Two sets in a row at a time: the intersection is taken in the row.
    both = left.join(sets.select(F.col("c").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sx", "sa")).cast("bigint")
    both = both.select("x", "a", shared.alias("shared"), (F.size("sx") + F.size("sa")).cast("bigint").alias("sum"))
    links = cut(both.where(f"shared > 0 and {den} * shared >= {num} * (sum - shared)").select("x", "a"), "text-links")
    drop_cut(left)

    # Meetings of three and more that the first links did not connect: one of those that have
    # the same rows.
    first = components(links, "x", "a")
    joined = first.select(F.col("node").alias("c"), "component")
    split = members.where("n > 2").select("key", "c", "n").join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    split = cut(split, "text-split")
    drop_cut(members)
    drop_cut(first)
    open_ = split.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p != q").select("key")
    split = cut(split.join(open_, "key").select("key", "c", "component"), "text-open")
    asked = cut(split.join(once(split), "key"), "text-asked")
    drop_cut(split)
    asked_of = dealt(asked, F.lit(POINT_BYTES), asked.count() * POINT_BYTES).join(sets.select("c", "p", "size"), "c")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("part_p", "ascending"), ("part_q", "ascending")])
        col = lambda name: table.column(name).to_numpy()
        points = np.frombuffer(b"".join(table.column("p").to_pylist()), "<i4").reshape(-1, DIMENSIONS)
        component, size, part = col("component"), col("size"), col("part")
        keep = [partnered(component[a:b], size[a:b], points[a:b], part[a:b], num, den) for a, b in meeting_ends(table)]
        return table.select(["key", "c", "component"]).filter(pa.array(np.concatenate(keep)))

    found = asked_of.groupBy("bin").applyInArrow(search, "key bigint, c bigint, component bigint").distinct()
    marked = cut(found, "text-marked")
    drop_cut(asked)
    # What has a partner is verified once: all that hangs together by meetings is one meeting now.
    hubs = marked.groupBy("key").agg(F.min("c").alias("m"))
    together = components(marked.join(hubs, "key").select("c", "m"), "c", "m")
    found = marked.select("c", "component").distinct().join(together.select(F.col("node").alias("c"), F.col("component").alias("key")), "c")
    found = cut(found.join(sets.select("c", "size"), "c").select("key", "c", "component", "size"), "text-found")
    drop_cut(marked)
    drop_cut(together)
    weight = F.col("size") * 8 + ROW_BYTES
    again = dealt(found, weight, found.agg(F.sum(weight)).first()[0] or 0).drop("size").join(sets.select("c", "s"), "c")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("part_p", "ascending"), ("part_q", "ascending")])
        c, component, part = (table.column(x).to_numpy() for x in ("c", "component", "part"))
        s = table.column("s").combine_chunks()
        values, at = s.values.to_numpy().view(np.uint64), s.offsets.to_numpy()
        x, y = [], []
        for a, b in meeting_ends(table):
            kept = linking(component[a:b], [values[at[k] : at[k + 1]] for k in range(a, b)], part[a:b], num, den)
            x += [c[a + i] for i, _ in kept]
            y += [c[a + j] for _, j in kept]
        return pa.table({"x": pa.array(x, pa.int64()), "a": pa.array(y, pa.int64())})

    more = cut(again.groupBy("bin").applyInArrow(verify, "x bigint, a bigint"), "text-links")
    drop_cut(found)
    drop_cut(sets)
    last = components(links.unionByName(more), "x", "a")
    joined = last.select(F.col("node").alias("c"), "component")
    drop_cut(links)
    drop_cut(more)

    # The smallest key of each component of several classes; another class has its own.
    least = cut(joined.join(classes, "c").groupBy("component").agg(F.min("rep").alias("component_id")), "text-least")
    joined = joined.join(broadcast_if_small(least, least.count(), 48), "component").select("c", "component_id")
    named = cut(classes.join(joined, "c", "left").select("f", "g", F.coalesce("component_id", "rep").alias("component_id")), "text-named")
    drop_cut(least)
    drop_cut(classes)
    drop_cut(last)
    out = base.join(broadcast_if_small(named, named.count(), 64), ["f", "g"], "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("h").alias("text_hash"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component, all columns: that of the smallest ``doc_id``.

    Rows without words stay; of rows that agree in ``doc_id`` and text one stays (of those the
    one with the smallest other columns); a component of null keys only keeps all its texts.
    """
    rows = classify(docs, n, num, den)
    found = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    found = cut(found.select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_hk"), "copies"), "text-kept")
    hashed = docs.withColumn("_h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_hk"))
    single, many = found.where("copies = 1"), found.where("copies > 1")
    out = hashed.join(broadcast_if_small(single, found.count(), 48), same, "left_semi").drop("_h")
    return out.unionByName(hashed.join(many, same, "left_semi").groupBy("doc_id", "_h").agg(F.min(F.struct(*[c for c in docs.columns])).alias("row")).select("row.*"))
