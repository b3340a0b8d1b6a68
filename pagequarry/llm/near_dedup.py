"""Near-duplicate documents by HyperMinHash, confirmed on whole shingle sets.

A document's set holds the distinct runs of `shingle` words (A-Z as a-z); with fewer words the whole sequence is its one
element, and without words the set is empty and linked with nothing. Elements are 64-bit hashes.

1. Rows of one set are one class, told apart by a 128-bit digest of the sorted set; one row, of the smallest doc_id,
   represents it. So exact copies, however many, cost one row from here on.
2. Each representative has K registers. A register is the minimum of one hash function over the set in 16 bits: the
   count of leading zeros (6 bits) and the MANTISSA bits behind the leading one.
3. ROWS registers make a band. At similarity 0.8 one of BANDS bands agrees with probability 1 - 3e-6. Buckets up to
   NEAR + 1 rows give all their pairs; in larger ones each row is paired with the one before it and with the smallest.
   Buckets above HOT rows are dealt to sub-buckets for that, whose first rows are tied to the bucket's first row.
4. Pairs whose registers estimate a similarity (corrected for registers that agree by chance) below the limit by more
   than four standard errors are dropped; the others are verified on whole sets.
5. Verified links are closed to components by contraction (each round every node takes the smallest label around it).
6. Buckets of more than NEAR + 1 rows that still touch several components are searched exhaustively, in pairs of blocks
   whose rows are compared by their registers; whole sets go only with rows that come near another component's there, and
   only links that join components leave a pair of blocks. Thus no link between different components is lost to step 3's
   shortcuts.

Documents are rows: a doc_id that repeats with another text doesn't tie the two texts. Rows with a null doc_id are linked
like others, but a component takes its name from its smallest doc_id that isn't null; a component of null ids alone has
the name null. `kept` is true where doc_id and component_id are equal or both null. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import chunks, join_hot, mix, ngram_hashes, stage, word_hashes

ROWS, BANDS, MANTISSA = 5, 32, 10
K = ROWS * BANDS
NEAR, HOT, BLOCK = 6, 1000, 256
#: Lists of ids up to this length, counted first, are broadcast (8 bytes each); longer ones are joined by shuffling.
MAX_BROADCAST_IDS = 1_000_000
SHINGLE, PERCENT = 5, 80
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, given its words' hashes."""
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))


def digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def text_hash(docs: DataFrame) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(docs["text"]).alias("text_hash")


def registers(elements: np.ndarray) -> np.ndarray:
    """K compressed minima of a set as uint16."""
    least = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(elements), 512):
        least = np.minimum(least, (elements[i : i + 512, None] * _A + _B).min(axis=0))
    high = (least >> np.uint64(11)).astype(np.float64)  # 53 bits: exact in a double
    zeros = np.where(high > 0, 53 - np.frexp(high)[1], 53).astype(np.int64)
    shifted = np.where(high > 0, least << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    mantissa = (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64)
    return (np.minimum(zeros, 63) << MANTISSA | mantissa).astype(np.uint16)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of n and m elements of which `agree` of K registers agree, less those that agree by chance.

    Two independent minima fall into one cell with probability sum(p q); a cell at x is x / 2^MANTISSA wide times a factor
    whose mean over an octave is 1 / (2 ln 2), and the densities are n exp(-n x) and m exp(-m x).
    """
    chance = 0.7213475 * n * m / (n + m) ** 2 / 2**MANTISSA
    return np.clip((agree / K - chance) / (1 - chance), 0, 1)


def least_estimate(percent: int = PERCENT) -> float:
    s = percent / 100
    return s - 4 * (s * (1 - s) / K) ** 0.5


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n (set size), sig (digest of the set; null if empty) and regs for every row of docs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part["text"].tolist()]
            ids = part["doc_id"]
            for a, b in chunks(texts):
                h, off = word_hashes(texts[a:b], lower=True)
                ns, sigs, regs = [], [], []
                seen: dict[bytes, bytes] = {}
                for i in range(b - a):
                    s = shingle_set(h[off[i] : off[i + 1]], shingle)
                    ns.append(len(s))
                    sig = digest(s) if len(s) else None
                    if sig is not None and sig not in seen:
                        seen[sig] = registers(s).tobytes()
                    sigs.append(sig)
                    regs.append(seen.get(sig))
                yield pd.DataFrame({"doc_id": ids.iloc[a:b], "text_hash": part["text_hash"].iloc[a:b], "n": ns, "sig": sigs, "regs": regs})

    found = docs.select(F.col("doc_id").cast("string"), text_hash(docs), "text").mapInPandas(run, "doc_id string, text_hash long, n long, sig binary, regs binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))  # a null among numbers would make pandas round them


def bands(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of each representative."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _B[:ROWS] | np.uint64(1)
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for part in parts:
            if not len(part):
                continue
            regs = np.frombuffer(b"".join(part["regs"]), dtype=np.uint16).reshape(len(part), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
            h = np.zeros((len(part), BANDS), dtype=np.uint64) + salts
            for r in range(ROWS):
                h = mix(h + regs[:, :, r] * powers[r])
            yield pd.DataFrame({"key": h.astype(np.int64).ravel(), "id": np.repeat(part["id"].to_numpy(), BANDS)})

    return reps.select("id", "regs").mapInPandas(run, "key long, id long")


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of (key, id, size): all pairs of buckets up to NEAR + 1 rows; else each row with the one before it and
    with the bucket's smallest. As buckets of one group of copies order their rows alike, those pairs repeat from band to
    band, so a large group gives a few pairs a row."""
    salt = F.when(F.col("size") > HOT, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / (HOT // 2)))).otherwise(F.lit(0))
    dealt = members.withColumn("salt", salt).repartition("key", "salt")
    w = Window.partitionBy("key", "salt").orderBy("id")
    near = [F.lag("id", 1).over(w), F.first("id").over(w), *[F.when(F.col("size") <= NEAR + 1, F.lag("id", i).over(w)) for i in range(2, NEAR + 1)]]
    others = dealt.select("id", F.array_distinct(F.array_compact(F.array(*near))).alias("others"))
    pairs = others.select(F.col("id").alias("x"), F.explode("others").alias("y"))
    firsts = dealt.where(F.col("size") > HOT).groupBy("key", "salt").agg(F.min("id").alias("id"))
    tied = firsts.withColumn("y", F.min("id").over(Window.partitionBy("key"))).select(F.col("id").alias("x"), "y")
    return ordered(pairs.unionByName(tied))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose registers come near enough to percent."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sets that differ in size by more than the limit allows can't reach it.
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                ra, rb = (np.frombuffer(b"".join(p[c]), dtype=np.uint16).reshape(len(p), K) for c in ("ra", "rb"))
                est = estimate((ra == rb).sum(axis=1), p["na"].to_numpy(dtype=float), p["nb"].to_numpy(dtype=float))
                yield p.loc[est >= least_estimate(percent), ["a", "b"]]

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(run, "a long, b long")


def shingle_sets(docs: DataFrame, needed: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(id, s) for the representatives of needed (id): the whole sorted set as 64-bit integers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()  # rows that repeat id and text
        for part in parts:
            part = part[~part["id"].isin(done) & ~part["id"].duplicated()]
            done.update(part["id"].tolist())
            texts = part["text"].tolist()
            for i, j in chunks(texts):
                h, off = word_hashes(texts[i:j], lower=True)
                yield pd.DataFrame({"id": part["id"].iloc[i:j], "s": [shingle_set(h[off[k] : off[k + 1]], shingle).astype(np.int64) for k in range(j - i)]})

    ids = stage(needed.join(reps.select("id", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("t")), "id"), "dedup-ids")
    n = ids.count()
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", text_hash(docs), "text")
    wanted = texts.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    sets = stage(wanted.select("id", "text").mapInPandas(run, "id long, s array<long>"), "dedup-sets")
    return sets if sets.count() == n else stage(sets.groupBy("id").agg(F.first("s").alias("s")), "dedup-sets")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are as similar as percent. Only texts of documents in a pair are looked at."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps, shingle)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t")).where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all nodes of links (a, b) but the smallest of each component: comp is the smallest that can be reached.

    Alternates two contractions until nothing changes: every node's larger neighbours, then all its smaller neighbours,
    are tied to the smallest node around it. Rounds grow with the logarithm of the longest path.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "dedup-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = stage(small, "dedup-edges")
        if after.count() == edges.count() and not after.exceptAll(edges).limit(1).count():
            break
        edges = after
    return stage(after.select(F.col("u").alias("id"), F.col("v").alias("comp")), "dedup-components")


def unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id, comp) of buckets above NEAR + 1 rows that touch several components."""
    known = stage(members.where(F.col("size") > NEAR + 1).join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "dedup-known")
    keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo != hi").select("key", "many")
    return join_hot(known, keys, "key", "many", known.count())


def exhaustive(rows: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket, compared block by block.

    A bucket's rows are split by whether they belong to its largest component and by the step of their set size on a scale
    of ratio 100 / percent, and dealt to blocks within. Rows of steps further apart than one can't be near each other, nor
    are rows of the largest component compared among themselves. In a pair of blocks, registers sift the pairs, whole sets
    decide, and what has been linked there isn't tried again: at most one link fewer than the blocks have rows comes out.
    """
    sized = rows.join(reps.select("id", "n", "regs"), "id")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_part"))
    major = parts.groupBy("key").agg(F.max_by("comp", F.struct("n_part", "comp")).alias("major"), F.sum("n_part").alias("many"))
    marked = join_hot(sized, major, "key", "many", rows.count()).withColumn("is_major", (F.col("comp") == F.col("major")).cast("int")).drop("major")
    marked = stage(marked.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")), "dedup-sized")
    groups = marked.groupBy("key", "is_major", "step").agg(F.count(F.lit(1)).alias("many")).withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    groups = stage(groups.withColumn("group", F.xxhash64("key", "is_major", "step")), "dedup-groups")
    dealt = join_hot(marked.withColumn("group", F.xxhash64("key", "is_major", "step")), groups.select("group", "blocks", "many"), "group", "many", rows.count())
    blocked = stage(dealt.withColumn("block", F.xxhash64("group", F.pmod(F.xxhash64("id"), F.col("blocks")))).select("block", "id", "comp", "n", "regs"), "dedup-blocks")

    named = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "is_major", "step", F.xxhash64("group", F.col("block").cast("long")).alias("block"))
    p, q = named.alias("p"), named.alias("q")
    apart = F.struct("p.is_major", "p.step", "p.block") <= F.struct("q.is_major", "q.step", "q.block")
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & apart & (F.abs(F.col("p.step") - F.col("q.step")) <= 1) & (F.col("p.is_major") + F.col("q.is_major") < 2))
    pairs = pairs.select(F.col("p.block").alias("i"), F.col("q.block").alias("j")).distinct()
    ends = stage(pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "dedup-block-pairs")

    def sift(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of x, the rows of y in another component whose sizes and registers come near."""
        rx, ry = (np.frombuffer(b"".join(t["regs"]), dtype=np.uint16).reshape(len(t), K) for t in (x, y))
        nx, ny, cx, cy = x["n"].to_numpy(), y["n"].to_numpy(), x["comp"].to_numpy(), y["comp"].to_numpy()
        for k in range(len(x)):
            fits = 100 * np.minimum(ny, nx[k]) >= percent * np.maximum(ny, nx[k])
            est = estimate((ry == rx[k]).sum(axis=1), float(nx[k]), ny.astype(float))
            yield k, np.flatnonzero(fits & (cy != cx[k]) & (est >= least_estimate(percent)))

    def near(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        x, y = part[part["block"] == i], part[part["block"] == j]
        ix, iy = x["id"].to_numpy(), y["id"].to_numpy()
        found = set()
        for k, at in sift(x, y):
            if len(at):
                found.add((i, ix[k]))
                found.update((j, v) for v in iy[at])
        return pd.DataFrame([(i, j, block, v) for block, v in found], columns=["i", "j", "block", "id"], dtype="int64")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        x, y = part[part["block"] == i], part[part["block"] == j]
        cx, cy, ix, iy, sx, sy = (t[c].to_numpy() for c in ("comp", "id", "s") for t in (x, y))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        out = []
        for k, at in sift(x, y):
            for m in at:
                a, b = root(cx[k]), root(cy[m])
                if a != b:
                    common = len(np.intersect1d(sx[k], sy[m], assume_unique=True))
                    if 100 * common >= percent * (len(sx[k]) + len(sy[m]) - common):
                        parent[max(a, b)] = min(a, b)
                        out.append((ix[k], iy[m]))
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    close = stage(ends.join(blocked, "block").groupBy("i", "j").applyInPandas(near, "i long, j long, block long, id long"), "dedup-close")
    sets = shingle_sets(docs, close.select("id").distinct(), reps, shingle)
    again = close.join(blocked, ["block", "id"]).join(sets, "id").select("i", "j", "block", "id", "comp", "n", "regs", "s")
    return ordered(again.groupBy("i", "j").applyInPandas(link, "x long, y long"))


def classified(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n and keeper for every row of docs: the row (doc_id, text_hash) that stands for its component.

    keeper is null for an empty set. A null doc_id is a keeper's only where its component has no other.
    """
    rows = stage(sketches(docs, shingle), "dedup-sketches")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("many"), F.min("n").alias("n"), F.min("regs").alias("regs"))
    reps = stage(classes.withColumn("id", F.monotonically_increasing_id()), "dedup-reps")
    banded = stage(bands(reps), "dedup-bands")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("many", F.col("size"))
    members = stage(join_hot(banded, sizes, "key", "many", banded.count()), "dedup-buckets")
    tried = stage(agreeing(bucket_pairs(members), reps, percent), "dedup-pairs")
    links = stage(verified(tried, docs, reps, shingle, percent), "dedup-links")
    comps = components(links)
    open_rows = stage(unresolved(members, comps), "dedup-open")
    if open_rows.limit(1).count():
        more = stage(exhaustive(open_rows, reps, docs, shingle, percent), "dedup-more")
        if more.limit(1).count():
            comps = components(links.unionByName(more))
    nodes = comps.unionByName(comps.select(F.col("comp").alias("id"), "comp").distinct())
    linked = stage(nodes.join(reps.select("id", "row"), "id"), "dedup-linked")
    names = linked.groupBy("comp").agg(F.min("row").alias("keeper"), F.count(F.lit(1)).alias("many"))
    keepers = join_hot(linked.select("id", "comp"), names, "comp", "many", linked.count()).select("id", "keeper")
    whole = stage(reps.select("sig", "id", "row", "many").join(keepers, "id", "left").select("sig", "many", F.coalesce("keeper", "row").alias("keeper")), "dedup-classes")
    out = join_hot(rows.select("sig", "doc_id", "text_hash", "n"), whole, "sig", "many", rows.count(), "left")
    return out.select("doc_id", "text_hash", "n", F.when(F.col("keeper").isNotNull(), F.struct("keeper.doc_id", "keeper.text_hash")).alias("keeper"))


def find(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    component = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return classified(docs, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row left of each component, that of the smallest doc_id; rows without words all stay.

    Rows are told apart by doc_id and text, so no text goes because another one has its id. Of rows equal in both, one
    stays, whichever if they differ in other columns.
    """
    found = stage(classified(docs, shingle, percent).where(F.col("keeper").isNotNull()), "dedup-found")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    dropped = stage(found.where(~is_keeper).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "dedup-dropped")
    repeated = stage(found.where(is_keeper).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).count().where("count > 1").drop("count"), "dedup-repeated")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    few = lambda keys: F.broadcast(keys) if keys.count() <= MAX_BROADCAST_IDS else keys
    left = docs.join(few(dropped), same, "left_anti")
    if not repeated.limit(1).count():
        return left
    once = docs.join(few(repeated), same).dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return left.join(few(repeated), same, "left_anti").unionByName(once)
