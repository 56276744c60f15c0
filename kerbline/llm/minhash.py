"""Near-duplicate documents: universal hash minima, banding, verification, components.

A document is the set of its word shingles.  Equal sets are one class from the
start.  Each class gets ``hashes`` minima; classes that agree on all minima of
some band are candidates, candidates are confirmed on their full sets, and the
confirmed links' components come from alternating large-star and small-star.

With 32 bands of 4 minima a pair at similarity 0.8 has a band in common with a
probability of 1 - 5e-8; low bits of the minima, by which far pairs are ruled
out before their sets are read, miss it with a probability under 1e-9.  Words are
told apart by 64-bit hashes.  Members of one large cluster are compared block by
block, which is complete and grows with the square of the cluster.

Null and empty texts have an empty set, link with nothing and are kept.  Rows
with equal ids count as one document, but each row is returned; of equal sets
the smallest id stays.  Very long texts are read whole.  An empty table gives an
empty result.  Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kerbline.llm.arrow import bound_batches, texts
from kerbline.llm.components import join_groups
from kerbline.plans.scratch import Scratch

_WORDS: dict[bytes, int] = {}
_KEPT_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; fewer words than k are one shingle.

    Words are what ASCII white space separates, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > _KEPT_WORDS:
        known.clear()
    size = min(k, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ each[j : j + n]) * _STEP
        h ^= h >> np.uint64(31)
    return np.unique(h)


def universal(hashes: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``hashes`` multiply-shift functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, hashes, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 2**63, hashes, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each function's upper 32 bits over the set."""
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * a[None, :]
        part += b
        np.minimum(low, (part >> np.uint64(32)).min(0).astype(np.uint32), out=low)
    return low


def sketch(k: int, hashes: int) -> Callable[[Column], Column]:
    """text -> struct(n: set size, key: digest of the whole set, sig: the minima); key and sig are null for an empty set."""

    @F.arrow_udf(T._parse_datatype_string("n long, key binary, sig binary"))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = universal(hashes)
        for batch in batches:
            n, key, sig = [], [], []
            for text in texts(batch):
                s = shingle_set(text, k)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minima(s, a, b).tobytes() if len(s) else None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["n", "key", "sig"])

    return apply


def band_keys(hashes: int, bands: int) -> Callable[[Column], Column]:
    """minima -> one 64-bit key for each band."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def apply(sig: pa.Array) -> pa.Array:
        rows = len(sig)
        values = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(rows, bands, hashes // bands).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (rows, bands)).copy()
        for j in range(values.shape[2]):
            key = (key ^ values[:, :, j]) * _STEP
            key ^= key >> np.uint64(31)
        flat = pa.array(key.view(np.int64).reshape(-1), pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * bands, pa.int32()), flat)

    return apply


def full_sets(k: int) -> Callable[[Column], Column]:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def apply(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, k).view(np.int64) for t in texts(column)], pa.list_(pa.int64()))

    return apply


@F.arrow_udf(T.ArrayType(T.LongType()))
def low_bits(sig: pa.Array) -> pa.Array:
    """One bit of each minimum, packed into longs."""
    values = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), -1)
    packed = np.packbits((values & 1).astype(np.uint8), axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return pa.array([row.view(np.int64) for row in packed], pa.list_(pa.int64()))


#: Probability at most that low bits rule out a pair at the threshold.
MISSED = 1e-9


def most_bits_apart(hashes: int, percent: int) -> int:
    """The least number of low bits that two documents at the threshold exceed with a probability under MISSED.

    Minima agree with the similarity's probability, and bits of unlike minima half the time.
    """
    p, more = (1 - percent / 100) / 2, 1.0
    for m in range(hashes + 1):
        more -= math.comb(hashes, m) * p**m * (1 - p) ** (hashes - m)
        if more < MISSED:
            return m
    return hashes


def bits_apart(a: str, b: str, longs: int) -> Column:
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)]
    return sum(parts[1:], parts[0])


#: Shingles and documents that a block aims at, when large clusters are compared block by block.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 40_000, 2_000


def _compare_blocks(percent: int):
    """Links inside one block or between two, as few as connect the same documents."""

    def apply(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["c"].to_numpy()
        lists = table["hs"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, code, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        shared = times[code] > 1
        _, code = np.unique(code[shared], return_inverse=True)
        row = row[shared]
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            x = np.zeros((len(ids), 4096), np.float32)
            x[row[lo:hi], code[lo:hi] - at] = 1
            both += x @ x.T
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for i, j in zip(*np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1)), strict=True):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[a] = b
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return apply


def block_links(clusters: DataFrame, sets: DataFrame, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links between components inside clusters of similar documents, each cluster cut into blocks of bounded size.

    All pairs of blocks are compared but those that hold one component only: the
    work grows with the square of a cluster.  A comparison is a matrix product and
    gives few rows.
    """
    weighed = clusters.join(sets.select("id", F.size("hs").alias("n")), "id")
    blocks = weighed.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / block_shingles, F.count("*") / BLOCK_DOCUMENTS)).cast("int").alias("blocks"))
    # of the most frequent component in each cluster, members need no comparison among themselves
    common = weighed.groupBy("cluster", "c").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "c"))["c"].alias("main"))
    placed = weighed.join(blocks, "cluster").join(common, "cluster").withColumn("main", F.col("c") == F.col("main"))
    # blocks of the main component get even numbers, others odd ones
    mine = placed.withColumn("block", 2 * F.pmod(F.xxhash64("id"), F.col("blocks")) + F.when(F.col("main"), 0).otherwise(1))
    other = F.explode(F.sequence(F.lit(0), 2 * F.col("blocks") - 1))
    met = mine.select("cluster", "id", "c", "block", other.alias("with")).where("block % 2 = 1 or with % 2 = 1")
    sided = met.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "id", "c")
    return sided.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(_compare_blocks(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
    percent: int = 80, hashes: int = 128, bands: int = 32, dense_from: int = 48, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links), kept (it is the smallest).

    Two documents link when 100 * |intersection| >= percent * |union|.
    """
    bound_batches(docs.sparkSession, 1000)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.write(source.select("id", sketch(k, hashes)("text").alias("s")).select("id", "s.*"), "sketched")
    # equal sets have equal minima, so any row of a class has them
    classes = scratch.write(sketched.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    banded = classes.select(F.explode(band_keys(hashes, bands)("sig")).alias("bucket"), F.col("rep").alias("id")).where("id is not null")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = scratch.write(banded.join(shared, "bucket", "left_semi"), "members")
    wanted = members.select("id").distinct()
    sets = scratch.write(
        source.join(wanted, "id", "left_semi").select("id", full_sets(k)("text").alias("hs")).dropDuplicates(["id"]), "sets"
    )

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("id").alias(c), F.col("hs").alias(f"h{c}")) for c in "ab")
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")

    limit, longs = most_bits_apart(hashes, percent), -(-hashes // 64)
    found = join_groups(
        members, verify, scratch,
        sketch=classes.where("rep is not null").select(F.col("rep").alias("id"), low_bits("sig").alias("sk")),
        near=lambda a, b, _: bits_apart(a, b, longs) <= limit,
        dense=lambda clusters: block_links(clusters, sets, percent, block_shingles), dense_from=dense_from,
    )
    of_class = classes.select("key", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    joined = sketched.select("id", "n", "key").join(of_class, "key", "left")
    done = scratch.write(joined.select("id", "n", F.coalesce("component", "id").alias("component")), "done")
    scratch.keep_only(done)
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
