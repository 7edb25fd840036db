"""Sharding by histogram sort (DataFrame functions only).

Rows are ordered by ``(hash of the text, hash of the key)``, so equal texts are neighbours.
The splitters of that order are found by counting: each round counts the exact bytes in the
cells of the current brackets over all partitions (partial sums, then at most
``CELLS x (shards - 1)`` rows to the driver), narrows every bracket to the one cell that
holds its splitter, and ends when each splitter is within the tolerance.  Only then are the
rows exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import cut, drop_cut

CELLS = 256
KEY_BITS = 62
#: Rows and bytes numbered by one task; a shard with more of them is numbered in several pieces.
PIECE_ROWS, PIECE_BYTES = 1_000_000, 256_000_000


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add the size (UTF-8 bytes plus 1; null text: 1) and the two sort keys."""
    mask = F.lit((1 << KEY_BITS) - 1).cast("bigint")
    return docs.withColumns({
        "_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1,
        "_h": F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(mask),
        "_t": F.xxhash64(key).bitwiseAND(mask),
    })


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """The ``shards - 1`` boundaries ``(h, t)`` of ``keys(_h, _t, _size)``: a row is below one if
    ``_h < h or (_h = h and _t < t)``.  Every boundary has its share of the bytes below it to
    within ``tolerance`` of a shard, or as near as whole rows allow."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    # A bracket: (column, fixed h or None, low, high); bytes below it are known exactly.
    top = ("_h", None, 0, 1 << KEY_BITS)
    at = {j: (top, 0) for j in range(1, shards)}
    out: dict[int, tuple[int, int]] = {}
    while at:
        brackets = sorted({b for b, _ in at.values()}, key=lambda b: (b[1] if b[1] is not None else b[2], b[2]))
        sums = _count(keys, brackets)
        for j, (bracket, below) in list(at.items()):
            target, (column, fixed, low, high) = total * j / shards, bracket
            width = _width(low, high)
            for cell in range(CELLS):
                size = sums.get((bracket, cell), 0)
                if below + size >= target:
                    break
                below += size
            start, end = low + cell * width, min(low + (cell + 1) * width, high)
            near, far = target - below, below + size - target
            if min(near, far) <= slack or width == 1 and column == "_t":
                cut_at = start if near <= far else end
                out[j] = (cut_at, 0) if column == "_h" else (fixed, cut_at)
                del at[j]
            elif width == 1:
                at[j] = (("_t", start, 0, 1 << KEY_BITS), below)
            else:
                at[j] = ((column, fixed, start, end), below)
    return [out[j] for j in sorted(out)]


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low) // CELLS))


def _count(keys: DataFrame, brackets: list) -> dict:
    """Exact bytes in each cell of each bracket."""
    which = where = None
    for i, (column, fixed, low, high) in enumerate(brackets):
        c = F.col(column)
        inside = (c >= F.lit(low)) & (c < F.lit(high))
        inside = inside if fixed is None else inside & (F.col("_h") == F.lit(fixed))
        cell = F.expr(f"({column} - {low}L) div {_width(low, high)}L")
        which = F.when(inside, i) if which is None else which.when(inside, i)
        where = F.when(inside, cell) if where is None else where.when(inside, cell)
    found = keys.select(which.alias("b"), where.cast("int").alias("c"), "_size").where("b is not null").groupBy("b", "c").agg(F.sum("_size").alias("s"))
    return {(brackets[r.b], r.c): r.s for r in found.collect()}


def shard_of(splitters: list[tuple[int, int]]):
    """The shard of a row of :func:`keyed`: how many splitters are at or below it."""
    points = F.array(*[F.struct(F.lit(h).cast("bigint").alias("h"), F.lit(t).cast("bigint").alias("t")) for h, t in splitters])
    return F.size(F.filter(points, lambda p: (p["h"] < F.col("_h")) | ((p["h"] == F.col("_h")) & (p["t"] <= F.col("_t"))))).cast("int")


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` plus ``size``, ``text_crc32``, ``shard`` and ``slot``.

    The bytes of the shards are near equal (law ``bytes``); slots count from 0 in each shard
    without gaps, in sort order within each piece.  Null texts count as empty (size 1, crc 0), null keys as any
    other value; rows that agree in text and key stay in one shard, as nothing tells them
    apart.  Columns of the input that clash with the added ones are replaced.  An empty
    table gives an empty result.
    """
    rows = keyed(docs.drop("size", "text_crc32", "shard", "slot"), text, key)
    narrow = cut(rows.select("_h", "_t", "_size"), "shard-keys")
    splitters = find_splitters(narrow, shards, tolerance) if shards > 1 else []
    shard_col = shard_of(splitters) if splitters else F.lit(0)
    placed = narrow.withColumn("shard", shard_col)
    n, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    pieces = max(1, -(-n // (shards * PIECE_ROWS)), -(-size // (shards * PIECE_BYTES)))
    piece = F.pmod("_t", F.lit(pieces)).cast("int")
    counts = placed.groupBy("shard", piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "shard-offsets")
    drop_cut(narrow)
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    full = rows.withColumns({"size": F.col("_size"), "text_crc32": crc, "shard": shard_col, "_piece": piece})
    ranked = full.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_h", "_t")))
    out = ranked.join(offsets, ["shard", "_piece"], "left") if pieces > 1 else ranked.withColumn("_before", F.lit(0))
    return out.withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("bigint")).drop("_h", "_t", "_size", "_piece", "_rank", "_before")
