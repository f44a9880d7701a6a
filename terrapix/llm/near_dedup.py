"""Near-duplicate groups by SetSketch registers.

A document's shingles go into a SetSketch: m registers, each the truncated exponent, to a base just over 1, of the
least of exponential hash values; sketches merge by maxima, and two sketches agree in a register about as often as
their sets overlap. Documents with equal shingle sets are one class from the start. Bands of registers are bucket keys;
candidates are judged by the joint likelihood of the registers' order given the sets' sizes, and what can't be ruled
out is verified on the full shingle sets.

Buckets aren't expanded into pairs. First each bucket compares its members with one pivot only, the member that shares
most buckets with others (in a group of edited copies, the original). Links join components. Where the rest of a bucket
then still lies in several components, it depends on its size. Large ones, joined by their pivot, are cut into blocks of
members, and blocks meet two by two with their full sets, giving only links between components. In small ones, of `few`
members at most, those of different components are compared. So each bucket's pairs have met or lie in one component,
and no link that the bands show is lost.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER, MIX1, MIX2, NOT_SPACE, bytes_of, documents, hashes, mix, passes, prepare, release, stored, words

#: Columns of shared shingles that two blocks are compared by at once.
COLUMNS = 8192
#: Registers in a band, bands, base, rate and largest value of the sketch; how far below the threshold the estimate of
#: a pair may lie that is still verified; and members of a bucket that is compared in one round.
ROWS, BANDS, B, RATE, LARGEST, MARGIN, FEW, BLOCK = 6, 40, 1.001, 20.0, 65535, 0.15, 64, 400


def multipliers(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * MIX1) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct hashes of each row's k-word shingles, sorted; all words as one shingle where there are fewer."""
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets, NOT_SPACE)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    w = hashes(low, starts, ends)
    h = w.copy()
    for j in range(1, min(k, len(w))):
        h[: len(w) - j] = mix(h[: len(w) - j] * MIX2 + w[j:])
    first = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for r in range(len(offsets) - 1):
        a, z = first[r], first[r + 1]
        if z - a >= k:
            out.append(np.unique(h[a : z - k + 1]))
        elif z > a:
            one = w[a : a + 1]
            for j in range(a + 1, z):
                one = mix(one * MIX2 + w[j : j + 1])
            out.append(mix(one + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], mults: np.ndarray) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), len(mults)), np.uint64)
    for i, a in enumerate(mults):
        least[:, i] = np.minimum.reduceat(every * a, starts)
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / np.log(B))
    return np.clip(k, 0, LARGEST).astype(np.uint16)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of largest likelihood for each pair of register rows, the sets' sizes given."""
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = m - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0.0, 1.0, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (B - 1) / B) / np.log(B)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    fit = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return grid[np.arange(len(a)), fit.argmax(1)]


def _sketch(k: int, m: int):
    def go(batches):
        mults = multipliers(m)
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            for i, j in passes(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                full = [s for s in sets if len(s)]
                regs = iter(registers(full, mults)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "sig", "regs"],
                )

    return go


def _bands(rows: int, bands: int):
    def go(batches):
        odd = multipliers(rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows)
            keys = mix((regs.astype(np.uint64) + np.uint64(1)) @ odd + np.arange(bands, dtype=np.uint64)[None, :] * MIX2)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bands))], ["key", "doc_id"])

    return go


def _likely(at_least: float):
    def go(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb"))
            keep = np.concatenate([joint_estimate(a[i : i + 500], b[i : i + 500], na[i : i + 500], nb[i : i + 500]) for i in range(0, n, 500)]) >= at_least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    return go


def _sets(k: int):
    def go(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            for i, j in passes(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "shingles"])

    return go


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that are similar: by sizes, by joint likelihood, then on full shingle sets. Stored."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "ra", "rb")
    likely = stored(both.mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long, na long, nb long"), "op6-likely")
    wanted = stored(likely.selectExpr("explode(array(a, b)) as doc_id").distinct(), "op6-wanted")
    sets = stored(docs.join(wanted, "doc_id").mapInArrow(_sets(k), "doc_id long, shingles array<bigint>"), "op6-sets")
    one = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    full = likely.join(one("b"), "b").join(one("a"), "a").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    links = stored(full.where(f"100 * both >= {percent} * (na + nb - both)").selectExpr("a as u", "b as v"), "op6-links")
    release(likely, wanted, sets)
    return links


def _compare(percent: int):
    """Links between the members of two blocks that lie in different components, one for each pair of components."""

    def go(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("shingles").combine_chunks() if isinstance(table.column("shingles"), pa.ChunkedArray) else table.column("shingles")
        ids, comp, part = (table.column(c).to_numpy() for c in ("doc_id", "component", "part"))
        a, b = np.flatnonzero(part == table.column("i")[0].as_py()), np.flatnonzero(part == table.column("j")[0].as_py())
        sizes = np.diff(lists.offsets.to_numpy())
        uniq, inv = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        shared = np.ones(len(uniq), bool)
        for side in (a, b):  # what one block alone holds is in no intersection
            seen = np.zeros(len(uniq), bool)
            seen[inv[np.isin(row, side)]] = True
            shared &= seen
        column = np.cumsum(shared) - 1
        keep = np.flatnonzero(shared[inv])
        keep = keep[np.argsort(column[inv[keep]], kind="stable")]
        at, row = column[inv[keep]], row[keep]
        both = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            x, y = np.searchsorted(at, [low, low + COLUMNS])
            dense = np.zeros((len(ids), COLUMNS), np.float32)
            dense[row[x:y], at[x:y] - low] = 1
            both += dense[a] @ dense[b].T
        union = sizes[a][:, None] + sizes[b][None, :] - both
        u, v = np.nonzero((100 * both >= percent * union) & (comp[a][:, None] != comp[b][None, :]))
        if len(u):
            pairs = np.sort(np.stack([comp[a[u]], comp[b[v]]], 1), axis=1)
            first = np.unique(pairs, axis=0, return_index=True)[1]
            u, v = ids[a[u[first]]], ids[b[v[first]]]
        return pa.table({"u": pa.array(np.asarray(u, np.int64)), "v": pa.array(np.asarray(v, np.int64))})

    return go


def _unsettled(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with each one's component and the bucket's size c."""
    own = comp.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    named = buckets.join(own, "doc_id", "left").withColumn("component", F.coalesce("own", "doc_id")).drop("own")
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"))
    several = several.where("lo < hi").select(F.col("key").alias("key2"), "c")
    return named.join(several, F.col("key") == F.col("key2")).drop("key2")


def _block_links(members: DataFrame, docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links within each group of members (grp, doc_id, component), found block by block. Stored."""
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = members.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    wanted = stored(members.select("doc_id").distinct(), "op6-wanted")
    sets = stored(docs.join(wanted, "doc_id").mapInArrow(_sets(k), "doc_id long, shingles array<bigint>"), "op6-sets")
    meet = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = meet.select("grp", "doc_id", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    links = stored(meet.join(sets, "doc_id").groupBy("grp", "i", "j").applyInArrow(_compare(percent), "u long, v long").distinct(), "op6-links")
    release(wanted, sets)
    return links


def near_dedup(df: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their sets of `shingle`-word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (it is the smallest).
    Linked are pairs with 100 * intersection >= percent * union. Words are what ASCII white space divides, A-Z in lower
    case. Null, empty and blank texts have an empty set and are linked with nothing. An empty table gives an empty
    result; other columns are ignored. Rows that repeat a doc_id, with the same text or another, are documents of their
    own: each is linked by its own text and gives a row. Rows without doc_id are left out. At similarity 0.8 the default
    bands miss a pair with probability (1 - 0.8 ** 6) ** 40, 5 in a million, and a more similar one less often.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = documents(df)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty():
        return _groups(docs, shingle, percent, rows, bands, few, block)
    keyed = stored(docs.withColumn("row", F.monotonically_increasing_id()), "op6-keyed")
    found = _groups(keyed.select(F.col("row").alias("doc_id"), "text"), shingle, percent, rows, bands, few, block)
    found = stored(found.withColumnRenamed("doc_id", "row").join(keyed.select("row", "doc_id"), "row"), "op6-found")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("c")).withColumnRenamed("component_id", "c2")
    found = found.join(least, F.col("component_id") == F.col("c2"))
    return found.select("doc_id", "n_shingles", F.col("c").alias("component_id"), (F.col("doc_id") == F.col("c")).alias("kept"))


def _groups(docs: DataFrame, shingle: int, percent: int, rows: int, bands: int, few: int, block: int) -> DataFrame:
    """near_dedup of documents with distinct ids."""
    sketches = stored(docs.mapInArrow(_sketch(shingle, rows * bands), "doc_id long, n_shingles long, sig binary, regs binary"), "op6-sketches")
    some = sketches.where("n_shingles > 0")
    classes = some.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("sig", "rep")
    classes = stored(classes, "op6-equal")  # so the join sees how large each side is, and can split hot groups
    member = stored(some.select("doc_id", "sig").join(classes, "sig", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "op6-members")
    firsts = member.where("doc_id = rep").select("doc_id")
    reps = stored(some.join(firsts, "doc_id").select("doc_id", "n_shingles", "regs"), "op6-classes")

    banded = reps.mapInArrow(_bands(rows, bands), "key long, doc_id long")
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "key2")
    crowded = stored(banded.join(shared, F.col("key") == F.col("key2")).select("key", "doc_id", "c"), "op6-buckets")
    popular = crowded.groupBy("doc_id").agg(F.sum("c").alias("pop")).join(reps.select("doc_id", F.col("n_shingles").alias("n")), "doc_id")
    buckets = stored(crowded.select("key", "doc_id").join(popular, "doc_id"), "op6-popular")
    release(crowded)

    # First each bucket's most popular member meets the others.
    best = buckets.groupBy("key").agg(F.max(F.struct("pop", (-F.col("doc_id")).alias("less"), "n")).alias("p"))
    best = stored(best.select(F.col("key").alias("key2"), (-F.col("p.less")).alias("pivot"), F.col("p.n").alias("n2")), "op6-pivots")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else their sizes rule a link out
    pairs = buckets.join(best, (F.col("key") == F.col("key2")) & (F.col("doc_id") != F.col("pivot")) & near("n", "n2"))
    tested = stored(pairs.selectExpr("least(doc_id, pivot) as a", "greatest(doc_id, pivot) as b").distinct(), "op6-pairs")
    links = _verified(tested, reps, docs, shingle, percent)
    comp = stored(components(links, "op6-components"), "op6-components")

    # Then what is left of buckets that still hold several components: large ones block by block, small ones by pairs.
    rest = buckets.join(best.select(F.col("key2").alias("key"), F.col("pivot").alias("doc_id")), ["key", "doc_id"], "left_anti")
    rest = stored(_unsettled(rest, comp), "op6-unsettled")
    large, small = rest.where(F.col("c") > few), rest.where(F.col("c") <= few)
    more = []
    if not large.isEmpty():
        groups = large.join(best.select("key2", F.col("pivot").alias("grp")), F.col("key") == F.col("key2")).select("grp", "doc_id", "component").distinct()
        more.append(_block_links(groups, docs, shingle, percent, block))
    if not small.isEmpty():
        other = small.select("key", F.col("doc_id").alias("b"), F.col("component").alias("c2"), F.col("n").alias("n2"))
        cross = small.join(other, "key").where((F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("c2")) & near("n", "n2"))
        cross = cross.select(F.col("doc_id").alias("a"), "b").distinct().join(tested, ["a", "b"], "left_anti")
        cross = stored(cross, "op6-pairs")
        more.append(_verified(cross, reps, docs, shingle, percent))
        release(cross)
    if any(not x.isEmpty() for x in more):
        comp = stored(components(reduce(DataFrame.unionByName, more, links), "op6-components"), "op6-components")
    release(classes, reps, buckets, best, tested, rest, links, *more)
    final = member.join(comp.selectExpr("node as rep", "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    out = sketches.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
