"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns some virtual nodes on a ring of 2^63 points; a row belongs to the first virtual node clockwise of its
own hash. No shard may hold more than (1 + epsilon) times the mean of the sizes: what a full shard can't take goes on
clockwise to the next shard that has room.

How it is spread out: rows are sorted by arc of the ring and position over many tasks, each task sums up its part of each
arc, and only those sums (one a task, and one more for each arc) reach the driver, which decides for each arc what ranges
of its cumulative size go to which shard. Rows above 1/GRAIN of a shard's mean, of which there can be n_shards * GRAIN at
most whatever the input, are placed one by one; every other row is so small that a range's ragged end can't matter. The
law kept is `bytes`: no shard is above (1 + epsilon) of the mean while any row fits, and hence none is far below.

Null texts have size 8 and crc32 0. A null key has the place of its text, so that such rows don't meet in one arc. Equal
rows are rows of their own: each gets a slot. An empty table gives no rows. Carried columns keep their values.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import stage

VNODES = 64
#: Rows above mean / GRAIN count as large; at most n_shards * GRAIN rows can.
GRAIN = 2000
EPSILON = 2 / GRAIN
RING_MASK = (1 << 63) - 1


def ring(n_shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Ascending points of the virtual nodes, and the shard that owns each."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") & RING_MASK, s) for s in range(n_shards) for v in range(vnodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def ring_position(key: Column, text: Column) -> Column:
    return F.coalesce(F.when(key.isNotNull(), F.xxhash64(key, F.lit(0x5EED))), F.xxhash64(text, F.lit(0x5EED))).bitwiseAND(F.lit(RING_MASK))


def arc_of(position: Column, points: list[int]) -> Column:
    at = np.array(points, dtype=np.int64)

    @F.pandas_udf("int")
    def find(p: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, p.to_numpy(dtype=np.int64), side="left") % len(at)).astype(np.int32))

    return find(position)


class Plan:
    """What goes where: the large rows one by one, and ranges of cumulative size for the others of each arc."""

    def __init__(self, owners: list[int], n_shards: int, total: int, epsilon: float, grain: int):
        self.owners, self.n = owners, n_shards
        self.cap = max(1, -(-int(total * (1 + epsilon)) // n_shards))
        self.small = max(1, total // (n_shards * grain))
        self.load = [0] * n_shards

    def clockwise(self, arc: int):
        """Shards as met from an arc on, each once."""
        seen: set[int] = set()
        for i in range(len(self.owners)):
            s = self.owners[(arc + i) % len(self.owners)]
            if s not in seen:
                seen.add(s)
                yield s
                if len(seen) == self.n:
                    return

    def put(self, arc: int, size: int) -> int:
        shard = next((s for s in self.clockwise(arc) if self.load[s] + size <= self.cap), None)
        if shard is None:  # nothing has room for a row this large
            shard = min(range(self.n), key=lambda s: (self.load[s], s))
        self.load[shard] += size
        return shard

    def pour(self, arc: int, size: int) -> list[tuple[int, int, int]]:
        """(from, to, shard) ranges of an arc's cumulative size; room for a ragged end of one small row is kept back."""
        ranges, at = [], 0
        for s in self.clockwise(arc):
            room = self.cap - self.small - self.load[s]
            if room > 0 and at < size:
                take = min(room, size - at)
                ranges.append((at, at + take, s))
                self.load[s] += take
                at += take
        if at < size:  # only by rounding, or with rows larger than a shard
            s = min(range(self.n), key=lambda s: (self.load[s], s))
            self.load[s] += size - at
            ranges.append((at, size, s))
        return ranges


def place(docs: DataFrame, n_shards: int = 24, vnodes: int = VNODES, epsilon: float = EPSILON, grain: int = GRAIN, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: key, size, text_crc32, shard, slot (gapless from 0 in a shard), and carried columns."""
    spark = docs.sparkSession
    points, owners = ring(n_shards, vnodes)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    rows = docs.select(F.col(key).alias("k"), size.alias("size"), F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("crc"), ring_position(F.col(key), F.col(text)).alias("pos"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rows = stage(rows.withColumn("arc", arc_of(F.col("pos"), points)), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    plan = Plan(owners, n_shards, total, epsilon, grain)

    order = [F.col("pos"), F.col("k"), F.col("crc"), F.col("size")]
    large = rows.where(F.col("size") > plan.small).withColumn("nth", F.row_number().over(Window.partitionBy("k", "size", "crc", "pos").orderBy(*[f"c_{c}" for c in carry], "pos")))
    found = large.select("k", "size", "crc", "pos", "arc", "nth").collect()  # n_shards * grain rows at most: their sizes add up to total
    found.sort(key=lambda r: (-r["size"], r["pos"], r["crc"], r["nth"]))
    counts = [0] * n_shards
    planned = []
    for r in found:
        s = plan.put(r["arc"], r["size"])
        planned.append((r["k"], r["size"], r["crc"], r["nth"], s, counts[s]))
        counts[s] += 1
    kind = rows.schema["k"].dataType.simpleString()
    by_plan = spark.createDataFrame(planned, f"k {kind}, size long, crc long, nth int, shard int, slot long")
    same = [large[c].eqNullSafe(by_plan[c]) for c in ("k", "size", "crc", "nth")]
    large_out = large.join(F.broadcast(by_plan), on=same).select(large["k"], large["size"], large["crc"], *[large[f"c_{c}"] for c in carry], "shard", "slot")

    sort = ["arc", *order]
    small = rows.where(F.col("size") <= plan.small).repartitionByRange(*sort).sortWithinPartitions(*sort)
    small = stage(small.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int")).drop("pos"), "shard-sorted")
    w = Window.partitionBy("part", "arc").orderBy("at")
    summed = small.withColumn("inside", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("rank", F.row_number().over(w))
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in small.groupBy("arc", "part").agg(F.sum("size").alias("s")).collect():  # a row a task, and one more for each arc
        parts.setdefault(r["arc"], []).append((r["part"], r["s"]))
    pieces = []
    for arc in sorted(parts):
        begins, total_of_arc = [], 0
        for part, n in sorted(parts[arc]):
            begins.append((part, total_of_arc, total_of_arc + n))
            total_of_arc += n
        for i, (lo, hi, s) in enumerate(plan.pour(arc, total_of_arc)):
            pieces += [(arc, part, lo - begin, hi - begin, s, i) for part, begin, end in begins if lo < end and hi > begin]
    by_piece = spark.createDataFrame(pieces, "arc int, part int, lo long, hi long, shard int, nth int")
    at = stage(summed.join(F.broadcast(by_piece), ["arc", "part"]).where((F.col("inside") >= F.col("lo")) & (F.col("inside") < F.col("hi"))).drop("at", "lo", "hi", "inside"), "shard-ranks")
    spans = at.groupBy("arc", "nth", "part", "shard").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row a piece
    offsets = []
    for r in sorted(spans, key=lambda r: (r["arc"], r["nth"], r["part"])):
        offsets.append((r["arc"], r["nth"], r["part"], counts[r["shard"]] - r["first"]))
        counts[r["shard"]] += r["n"]
    by_offset = spark.createDataFrame(offsets, "arc int, nth int, part int, off long")
    small_out = at.join(F.broadcast(by_offset), ["arc", "nth", "part"]).select("k", "size", "crc", *[f"c_{c}" for c in carry], "shard", (F.col("off") + F.col("rank")).alias("slot"))
    out = large_out.unionByName(small_out)
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), *[F.col(f"c_{c}").alias(c) for c in carry], "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id", rows_per_file: int = 500_000) -> None:
    """Write the rows of docs into one folder for each shard, in slot order, some files each. Keys must be unique."""
    joined = docs.join(placed.select(key, "shard", "slot"), key)
    part = F.floor(F.col("slot") / rows_per_file)
    joined.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def owner(position: int, points: list[int], owners: list[int]) -> int:
    """The shard that a point of the ring belongs to when none is full."""
    return owners[bisect_left(points, position) % len(points)]
