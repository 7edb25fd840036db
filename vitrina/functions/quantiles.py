"""Exact quantiles by distributed selection.

No task holds the values of a group.  Each pass counts the rows between some cuts over all partitions, finds
the cell that holds the wanted rank, and takes the next cuts from sketches of the cells, so that a cell has about a
sixty-fourth of the rows of the one before; a value that equals a cut has a cell of its own, so frequent
values end the search.  The driver gets counts and cuts of the cells, and in the end at most ``FEW`` values a quantile.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.sources.scratch import drop, kept

#: Cuts of a pass, and values that the driver may get for a quantile.
CUTS, FEW = 64, 500
#: Groups are few: cohorts, types, channels.
GROUPS = 1000


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """The interpolated quantiles of a column, a row a group: ``by`` and a double for each name of ``shares``.

    Null values are left out; without any the result has no row for the group (without ``by``: a row of nulls).  ``by`` names columns of at most
    ``GROUPS`` combinations.  ``counted``: the column has few distinct values (days, numbers of purchases) or is dear to compute; it is
    counted by value first, which one pass with partial sums does."""
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(column).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(column).cast("double").alias("v"))
    rows = rows.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("w")) if counted else rows.withColumn("w", F.lit(1).cast("bigint"))
    spent = []
    if counted:
        rows = kept(rows, "counted")
        spent = [rows]
    found = _search(rows, names, shares)
    drop(*spent)
    if not by and not found:
        found = {(): {}}
    fields = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] + [f"`{n}` double" for n in shares]
    return df.sparkSession.createDataFrame([(*g, *(own.get(n) for n in shares)) for g, own in found.items()], ", ".join(fields))


def _search(rows: DataFrame, names: list[str], shares: dict[str, float]) -> dict[tuple, dict[str, float]]:
    few = rows.limit(FEW + 1).collect()
    if len(few) <= FEW:
        groups = defaultdict(list)
        for r in few:
            groups[tuple(r[n] for n in names)].append((r.v, r.w))
        return {g: {n: _pick(values, *_ranks(sum(w for _, w in values), q), 0) for n, q in shares.items()} for g, values in groups.items()}
    grid = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cell = [F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", grid, 10 * CUTS).alias("cuts")]
    groups = rows.groupBy(*names).agg(*cell).limit(GROUPS + 1).collect()
    if len(groups) > GROUPS:
        raise ValueError(f"quantiles of more than {GROUPS} groups: {names}")
    out: dict[tuple, dict[str, float]] = {tuple(r[n] for n in names): {} for r in groups}
    open_ = {(tuple(r[n] for n in names), name): (*_ranks(r.n, q), 0, r) for r in groups for name, q in shares.items()}
    while open_:
        gathered = {k: b for k, b in open_.items() if b[4].n <= FEW}
        if gathered:
            values = defaultdict(list)
            for r in _inside(rows, names, gathered).groupBy("b", "v").agg(F.sum("w").alias("w")).collect():
                values[r.b].append((r.v, r.w))
            for i, ((group, name), (lo, hi, part, below, _)) in enumerate(gathered.items()):
                out[group][name] = _pick(values[i], lo, hi, part, below)
                del open_[group, name]
        if not open_:
            break
        at = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        cells = defaultdict(list)
        for r in _inside(rows, names, open_).groupBy("b", at.alias("cell")).agg(*cell).collect():
            cells[r.b].append(r)
        for i, ((group, name), (lo, hi, part, below, _)) in enumerate(list(open_.items())):
            ends = {}
            for r in sorted(cells[i], key=lambda r: r.cell):
                for rank in (lo, hi):
                    if below <= rank < below + r.n:
                        ends[rank] = r, below
                below += r.n
            (first, start), (last, _) = ends[lo], ends[hi]
            if first is last and first.low < first.high:
                open_[group, name] = lo, hi, part, start, first
            else:  # the cell has one value, or the ranks are its last and the next one's first
                a, b = (first.low, first.low) if first is last else (first.high, last.low)
                out[group][name] = a + (b - a) * part
                del open_[group, name]
    return out


def _ranks(n: int, share: float) -> tuple[int, int, float]:
    """The ranks (from 0) beside a share, and how far it is from the first."""
    at = (n - 1) * share
    return int(at), min(int(at) + 1, n - 1), at - int(at)


def _pick(values: list[tuple[float, int]], lo: int, hi: int, part: float, below: int) -> float:
    ends = {}
    for v, w in sorted(values):
        for rank in (lo, hi):
            if below <= rank < below + w:
                ends[rank] = v
        below += w
    return ends[lo] + (ends[hi] - ends[lo]) * part


def _inside(rows: DataFrame, names: list[str], brackets: dict) -> DataFrame:
    """The rows in each bracket ``b`` of their group, with its cuts."""
    listed = [(i, *group, r.low, r.high, sorted({*r.cuts, r.low, r.high})) for i, ((group, _), (*_, r)) in enumerate(brackets.items())]
    fields = ["b int", *[f"_{n} {rows.schema[n].dataType.simpleString()}" for n in names], "low double", "high double", "cuts array<double>"]
    side = F.broadcast(rows.sparkSession.createDataFrame(listed, ", ".join(fields)))  # a row a group and quantile
    on = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    return rows.join(side, on).select("b", "cuts", "v", "w")
