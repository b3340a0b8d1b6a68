"""Mixing sources to target weights by entropy balancing.

Each source s has a target of T_s words. Of all rates w_i in [0, MAX_COPIES] for the documents that meet the targets, the
ones nearest to 1 in relative entropy are w_i = min(MAX_COPIES, exp(lambda_s * z_i)), where z_i is the document's size
over its source's mean size in words: an exponential tilt, worked out as a power so that the cap is its only bound. The dual
is concave in one lambda a source and is solved by distributed Newton steps, kept inside a bracket that grows by doubling
until it holds the solution and shrinks from then on, since the cap bends the dual. Targets, duals and brackets are tables with a row a source, so the number of sources isn't bounded; the driver sees scalars only.

The rates are then rounded into whole copies. Documents above 1/GRAIN of their source, of which there are fewer than GRAIN
a source, are rounded together so that they come as near to their part of the target as they can. For all others a hash
of the document decides who gets the copy that rounding leaves open: those whose hash over their open part is smallest,
up to the place where the source's target is met; PASSES passes narrow that place down, each by a histogram of BINS bins
a source. So the words taken differ from the target by about one small document, and reruns agree.

Null and blank texts have size 0 and add nothing. A null source is a source of its own. Null ids are told apart by their
texts. Rows of one doc_id and text share a hash, hence get copies together. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import join_hot, n_words_of, numbered, stage

MAX_COPIES, GRAIN, BINS, PASSES, MAX_STEPS = 3, 1000, 2048, 4, 200
#: Relative error of a source's words at which its dual counts as solved.
TOLERANCE = 1e-4
#: Tables of sources up to this length, counted first, are broadcast; of longer ones only the hot sources are.
BROADCAST_SOURCES = 100_000
#: Tables of up to this many sources, counted first, are written by one task, as are their BINS bins a source.
ONE_TASK_SOURCES = 1000
WEIGHTS = (1, 2, 3)


def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined by skey with a table that has a row a source and its number of rows as `many`."""
    counted = table.agg(F.count(F.lit(1)).alias("n"), F.sum("many").alias("rows")).first()
    if counted["n"] <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table.drop("many")), "skey")
    return join_hot(rows, table, "skey", "many", counted["rows"])


def stage_sources(table: DataFrame, label: str, n_sources: int) -> DataFrame:
    """A table of sources, or of their bins, staged; many tasks for a few rows would only cost."""
    return stage(table.coalesce(1) if n_sources <= ONE_TASK_SOURCES else table, label)


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """sums (skey, total, ...) with weight and target: weights repeat over the sources by code point, null last.

    No target is above `most` times its source's size; what such a source leaves is shared by the others' weights. That
    is the least of most * total and level * weight, for the level at which the targets add up to all words.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stage(numbered(sums, ["skey"], "rank").withColumn("weight", F.get(listed, F.pmod("rank", F.lit(len(weights))).cast("int"))).drop("rank"), "mix-weights")
    room = F.col("total") * float(most)
    words = weighed.agg(F.sum("total")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = room < level * F.col("weight")
        r = weighed.agg(F.sum(F.when(full, room).otherwise(0.0)).alias("room"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(full.cast("long")).alias("n")).first()
        if not r["weight"] or r["n"] == capped:
            return weighed.withColumn("target", F.least(room, F.lit(level) * F.col("weight")))
        level, capped = (words - r["room"]) / r["weight"], r["n"]


def solve(by_size: DataFrame, sources: DataFrame, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """sources (skey, many, total, mean, target) with the dual x. by_size: (skey, size, n), the documents of each size.

    Every step sums the words taken at x and their derivative over all sizes and moves the x of each source that isn't
    solved yet: by Newton, if that stays in its bracket; else to the bracket's middle or, where one end is still open, twice
    as far. After max_steps, the last x stands; by then a bracket has been halved beyond what doubles tell apart.
    """
    none, all_ = F.col("target") <= 0, F.col("target") >= MAX_COPIES * F.col("total")
    open_end = F.lit(None).cast("double")
    state = stage(sources.withColumns({"x": F.lit(0.0), "lo": open_end, "hi": open_end, "solved": none | all_}), "mix-duals")
    n_sources = state.count()
    for _ in range(max_steps):
        if not state.where(~F.col("solved")).limit(1).count():
            break
        at = attach(by_size, state.where(~F.col("solved")).select("skey", "many", "mean", "x"))
        power = F.col("x") * F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size")
        sums = at.groupBy("skey").agg(F.sum(words * capped_rate(power)).alias("g"), F.sum(F.when(power < LOG_MOST, words * F.col("size") / F.col("mean") * F.exp(power)).otherwise(0.0)).alias("h"))
        off = F.col("g") - F.col("target")
        joined = state.join(sums, "skey", "left").withColumn("near", F.col("solved") | F.coalesce(F.abs(off) <= tolerance * F.col("target"), F.lit(True)))
        moved = joined.withColumn("hi", F.when(off > 0, F.col("x")).otherwise(F.col("hi"))).withColumn("lo", F.when(off > 0, F.col("lo")).otherwise(F.col("x")))
        newton = F.when(F.col("h") > 0, F.col("x") - off / F.col("h"))
        reach = F.greatest(F.lit(1.0), F.abs("x"))
        inside = (newton > F.coalesce("lo", F.col("x") - 2 * reach)) & (newton < F.coalesce("hi", F.col("x") + 2 * reach))
        further = F.when(F.col("hi").isNull(), F.col("x") + reach).when(F.col("lo").isNull(), F.col("x") - reach).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when(inside, newton).otherwise(further)
        state = stage_sources(moved.withColumn("x", F.when(F.col("near"), F.col("x")).otherwise(step)).withColumn("solved", F.col("near")).select(*state.columns), "mix-duals", n_sources)
    return state


#: The power at which a rate reaches the cap.
LOG_MOST = float(np.log(MAX_COPIES))


def capped_rate(power: Column) -> Column:
    return F.when(power < LOG_MOST, F.exp(power)).otherwise(float(MAX_COPIES))


def hashed(*key: Column) -> Column:
    """A number in (0, 1) from a key."""
    return (F.xxhash64(*key, F.lit(0xB1E4D)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def round_large(rates: np.ndarray, sizes: np.ndarray, target: float, order: np.ndarray) -> np.ndarray:
    """Whole copies of a few documents whose sizes sum up near target, each the rate rounded down or up if that suffices."""
    copies = np.floor(rates).astype(int)
    left = target - float(copies @ sizes)
    for most in (np.minimum(MAX_COPIES, np.floor(rates) + 1), np.full(len(rates), MAX_COPIES)):
        for i in np.lexsort((order, -sizes)):  # the largest that still fits, first among those whose rate leaves it open
            while 0 < sizes[i] <= left and copies[i] < most[i]:
                copies[i] += 1
                left -= sizes[i]
    near = [i for i in np.lexsort((order, sizes)) if 0 < sizes[i] < 2 * left and copies[i] < MAX_COPIES]
    if near:
        copies[min(near, key=lambda i: abs(sizes[i] - left))] += 1
    return copies


def rounded_large(large: DataFrame) -> DataFrame:
    """large (skey, doc_id, size, rate, u, ...) with copies; fewer than GRAIN rows a source."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "u", "doc_id"], ascending=[False, True, True])
        sizes = part["size"].to_numpy(dtype=float)
        return part.assign(copies=round_large(part["rate"].to_numpy(), sizes, float((part["rate"] * sizes).sum()), part["u"].to_numpy()).astype(np.int32))

    kind = large.schema["doc_id"].dataType
    named = large.withColumn("doc_id", F.col("doc_id").cast("string"))  # a null among numbers would make pandas round them
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema) + ", copies int"
    return named.groupBy("skey").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def edges(small: DataFrame, need: DataFrame) -> DataFrame:
    """skey, many, edge: the priority p up to which the rows of small (skey, size, p) fit into need (skey, many, need) words."""
    state = stage(need.withColumns({"lo": F.lit(0.0), "width": F.lit(64.0), "got": F.lit(0.0)}), "mix-edges")
    n_sources = state.count()
    for _ in range(PASSES):  # each narrows the place BINS-fold
        at = attach(small.where((F.col("size") > 0) & F.col("p").isNotNull()).select("skey", "size", "p"), state.where("width > 1e-12").select("skey", "many", "lo", "width"))
        place = F.floor((F.col("p") - F.col("lo")) / F.col("width") * BINS)
        inside = at.where((F.col("p") >= F.col("lo")) & (F.col("p") < F.col("lo") + F.col("width")))
        bins = stage_sources(inside.groupBy("skey", F.least(place, F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("size").alias("s")), "mix-bins", n_sources)
        upto = F.col("got") + F.sum("s").over(Window.partitionBy("skey").orderBy("bin"))  # BINS rows a source at most
        found = bins.join(state, "skey").withColumn("upto", upto).groupBy("skey").agg(F.min(F.when(F.col("upto") > F.col("need"), F.col("bin"))).alias("bin"), F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("upto"))
        joined = state.join(found.withColumn("seen", F.lit(True)), "skey", "left")
        beyond = F.col("seen") & F.col("bin").isNull()
        lo = F.when(beyond, F.col("lo") + F.col("width")).otherwise(F.col("lo") + F.coalesce(F.col("width") * F.col("bin") / BINS, F.lit(0.0)))
        width = F.when(beyond, 0.0).when(F.col("seen"), F.col("width") / BINS).otherwise(F.col("width"))
        state = stage_sources(joined.select("skey", "many", "need", lo.alias("lo"), width.alias("width"), F.coalesce("upto", "got").alias("got")), "mix-edges", n_sources)
    return state.select("skey", "many", F.col("lo").alias("edge"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, rate, copies and taken for every row of docs."""
    key = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", key.alias("skey"), n_words_of(F.col("text")).alias("size")), "mix-sizes")
    by_size = stage(rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "mix-by-size")
    sums = by_size.groupBy("skey").agg(F.sum("n").alias("many"), F.sum(F.col("n") * F.col("size")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("filled"))
    sources = targets(sums, weights).withColumn("mean", F.col("total") / F.greatest("filled", F.lit(1)))
    duals = solve(by_size.where("size > 0"), sources.select("skey", "many", "total", "mean", "target"))

    rate = capped_rate(F.col("x") * F.col("size") / F.greatest("mean", F.lit(1e-9)))
    rated = attach(rows, duals.select("skey", "many", "total", "mean", "target", "x")).withColumn("rate", F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= MAX_COPIES * F.col("total"), float(MAX_COPIES)).otherwise(rate))
    rated = rated.withColumn("u", hashed(F.col("doc_id"), F.col("text_hash"))).drop("mean", "x")
    is_large = F.col("size") * GRAIN > F.col("total")
    large = stage(rounded_large(rated.where(is_large)), "mix-large")

    # Small documents: floor(rate) copies each, and one more for the smallest priorities u / open part.
    small = rated.where(~is_large).withColumn("base", F.floor("rate").cast("int")).withColumn("open", F.col("rate") - F.floor("rate"))
    priority = F.when(F.col("open") > 0, F.col("u") / F.col("open")).otherwise(F.lit(1e18) * F.col("u"))
    small = stage(small.withColumn("p", F.when(F.col("base") >= MAX_COPIES, F.lit(None).cast("double")).otherwise(F.log1p(priority))).drop("u", "open"), "mix-small")
    sure = large.select("skey", (F.col("copies") * F.col("size")).alias("s")).unionByName(small.select("skey", (F.col("base") * F.col("size")).alias("s"))).groupBy("skey").agg(F.sum("s").alias("sure"))
    need = duals.select("skey", "many", "target").join(sure, "skey", "left").select("skey", "many", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("need"))
    chosen = attach(small, edges(small, need)).withColumn("copies", F.col("base") + F.when(F.col("p") < F.col("edge"), 1).otherwise(0))

    cols = ["doc_id", "text_hash", "source", "size", F.col("total").alias("source_size"), "target", "rate", F.col("copies").cast("int").alias("copies")]
    return large.select(*cols).unionByName(chosen.select(*cols)).withColumn("taken", F.col("copies").cast("long") * F.col("size"))
