"""Vectors as short codes: a codebook for each part, fitted by Lloyd rounds that skip distances as Elkan does.

A vector is cut into equal parts, and each part has a codebook of ``entries``
points.  A round assigns every part to its nearest entry and moves entries to the mean of
their parts.  With each part go an upper bound of the distance to its entry
and a lower bound of the distance to each entry.  They are written with the
table after every assignment; the next one shifts them by how far entries moved and
computes a distance only where the triangle inequality can't tell that the entry is farther.  Only what
is strictly farther is skipped, and what is left is decided by integer distances, so
ties go to the lower index and codes are those of a plain search.

Components are integers, floor(256 x), and sums are exact.  Tasks add up their parts
by entry before anything is shuffled; the driver holds the codebooks alone, whose size is
that of ``entries`` vectors.

Vectors that are null or hold a null, a NaN or an infinity are dropped.  The length is that
of the smallest id whose length the parts divide; rows of another length, empty vectors among them, stay with a null code and
error and take no part.  Null ids come after all others, and rows of equal ids are told by their components.  Repeated rows count each.
With fewer vectors than entries the codebooks are smaller.  Components beyond 64 bits
are held at their limits, and an error beyond them is null.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.arrow import bound_batches
from kerbline.plans.scratch import Scratch

#: Components up to here are squared and added in 64 bits; beyond, in Python's integers.
SAFE = 1 << 26
STATE = "id long, label {label}, parts array<bigint>, code binary, upper binary, lower binary, unit binary"


@dataclass
class Codebooks:
    """``points``: parts x entries x components, integers; and how far each entry moved to get there, rounded up."""

    points: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.points.reshape(-1).tolist())).encode()).hexdigest()


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - 1e-14)


def _root_up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-14)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    apart = a - b
    return (apart * apart).sum(-1)


def _kind(*arrays: np.ndarray) -> type:
    return np.int64 if all(not a.size or np.abs(a.astype(np.float64)).max() < SAFE for a in arrays) else object


def first_assignment(part: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, squared distance to it, and the bounds: all distances are computed."""
    every = np.stack([_distances(part, p) for p in points], 1)
    code = every.argmin(1)
    own = every[np.arange(len(part)), code]
    return code, own, _root_up(own), _root_down(every)


def next_assignment(part: np.ndarray, points: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the last assignment and its bounds; the last value counts the distances that were computed."""
    rows = np.arange(len(part))
    upper = (upper + moved[code]) * (1 + 1e-14)
    lower = np.maximum((lower - moved) * (1 - 1e-14), 0)
    half = _root_down(np.stack([_distances(points, p) for p in points], 1)) / 2

    def open_pairs(at: np.ndarray) -> np.ndarray:
        left = ~((upper[at, None] < lower[at]) | (upper[at, None] < half[code[at]]))
        left[np.arange(len(at)), code[at]] = False
        return left

    some = rows[open_pairs(rows).any(1)]
    own = _distances(part[some], points[code[some]])
    upper[some], lower[some, code[some]] = _root_up(own), _root_down(own)
    left = open_pairs(some)
    i, j = left.nonzero()
    exact = _distances(part[some[i]], points[j])
    lower[some[i], j] = _root_down(exact)
    known = np.full(left.shape, np.inf if part.dtype == object else np.iinfo(np.int64).max, part.dtype)
    known[np.arange(len(some)), code[some]] = own
    known[i, j] = exact
    best = known.argmin(1)  # the lower index of equal integers; what was skipped is farther than the entry held
    code = code.copy()
    code[some] = best
    upper[some] = _root_up(known[np.arange(len(some)), best])
    return code, upper, lower, len(some) + len(exact)


def pack_lower(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds, rows x entries, as bytes times a unit of the row, never larger than they were."""
    unit = (lower.max(1) / 255 * (1 + 1e-6)).astype(np.float32)
    wide = np.where(unit > 0, unit, 1).astype(np.float64)[:, None]
    steps = np.minimum(np.floor(lower / wide), 255)
    steps -= (steps * wide > lower) & (steps > 0)
    return steps.astype(np.uint8), unit


def unpack_lower(steps: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) * unit.astype(np.float64)[..., None]


def integer_parts(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, parts): components as integers, of the vectors that are kept."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # in two steps, so that what is not finite is never floored
    return rows.where(v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: _floored(x.cast("double"))).alias("parts"))


def _floored(x):
    big = float(1 << 55)  # times 256, the limits of 64 bits
    return F.when(x >= big, F.lit((1 << 63) - 1)).when(x < -big, F.lit(-(1 << 63))).otherwise(F.floor(x * 256)).cast("long")


def _cut(column: pa.Array, n_parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(_kind(flat)).reshape(len(column), n_parts, -1)


def assign(state: DataFrame, books: Codebooks) -> DataFrame:
    """The table with the codes and bounds under ``books``; a table without bounds gets its first ones."""
    n_parts, entries, _ = books.points.shape
    begun = "code" in state.columns
    schema = STATE.format(label=state.schema["label"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = _cut(batch.column("parts"), n_parts)
            points = books.points.astype(_kind(books.points, vectors))
            vectors = vectors.astype(points.dtype)
            code, upper, unit = np.zeros((n, n_parts), np.uint8), np.zeros((n, n_parts), np.float32), np.zeros((n, n_parts), np.float32)
            lower = np.zeros((n, n_parts, entries), np.uint8)
            if begun:
                held = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), k).reshape(n, n_parts, -1) for c, k in (("code", np.uint8), ("upper", "<f4"), ("lower", np.uint8), ("unit", "<f4"))}
            for p in range(n_parts):
                if begun:
                    bounds = unpack_lower(held["lower"][:, p], held["unit"][:, p, 0])
                    c, u, low, _ = next_assignment(vectors[:, p], points[p], books.moved[p], held["code"][:, p, 0].astype(np.int64), held["upper"][:, p, 0].astype(np.float64), bounds)
                else:
                    c, _, u, low = first_assignment(vectors[:, p], points[p])
                code[:, p], upper[:, p] = c, np.nextafter(u.astype(np.float32), np.float32(np.inf))
                lower[:, p], unit[:, p] = pack_lower(low)
            packed = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code, upper, lower, unit)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("parts"), *packed], names=["id", "label", "parts", "code", "upper", "lower", "unit"])

    return state.mapInArrow(run, schema)


def moved_entries(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the mean of their parts, rounded down; one without parts stays."""
    n_parts, entries, width = books.points.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, entries, width + 1), object)
        for batch in batches:
            vectors = _cut(batch.column("parts"), n_parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(vectors), n_parts)
            one = np.zeros((n_parts, entries, width + 1), vectors.dtype)
            for p in range(n_parts):
                np.add.at(one[p, :, :width], code[:, p], vectors[:, p])
                np.add.at(one[p, :, width], code[:, p], 1)
            sums += one.astype(object)
        flat = sums.reshape(-1, width + 1)
        used = np.flatnonzero(flat[:, width])
        slots = (used[:, None] * (width + 1) + np.arange(width + 1)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([str(x) for x in flat[used].reshape(-1)], pa.string())], names=["slot", "total"])

    sums = state.select("parts", "code").mapInArrow(partial, "slot long, total string").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    points = books.points.astype(object).reshape(-1, width)
    totals = {r["slot"]: int(r["total"]) for r in sums.collect()}  # at most parts x entries x (width + 1)
    new = [[totals[k * (width + 1) + j] // totals[k * (width + 1) + width] for j in range(width)] if k * (width + 1) + width in totals else list(points[k]) for k in range(len(points))]
    after = np.array(new, object).reshape(books.points.shape)
    return Codebooks(after.astype(_kind(after)), _root_up(_distances(after, books.points.astype(object))))


@dataclass
class Coded:
    """``rows``: id, label, code (bytes) and error; ``books``, or none where no vector could be used."""

    rows: DataFrame
    books: Codebooks | None


def code_vectors(rows: DataFrame, scratch: Scratch, n_parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Coded:
    """Fit codebooks on all vectors, from the ``entries`` smallest ids, and code all vectors with them."""
    if entries > 256:
        raise ValueError("a code is a byte a part")
    bound_batches(rows.sparkSession)
    kept = scratch.write(integer_parts(rows, id_col, vector_col, label_col), "parts")
    order = [F.col("id").asc_nulls_last(), "parts"]
    first = kept.where((F.size("parts") > 0) & (F.size("parts") % n_parts == 0)).orderBy(*order).select("parts").first()
    if first is None:
        return Coded(kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None)
    length = len(first["parts"])
    same = F.size("parts") == length
    seeds = [r["parts"] for r in kept.where(same).orderBy(*order).limit(entries).select("parts").collect()]
    points = np.array(seeds, object).reshape(len(seeds), n_parts, -1).transpose(1, 0, 2)
    books = Codebooks(points.astype(_kind(points)), np.zeros(points.shape[:2]))
    state = kept.where(same)
    for _ in range(rounds):
        state, before = scratch.write(assign(state, books), "state"), state
        scratch.drop(before)
        books = moved_entries(state, books)
    coded = assign(state, books).select("id", "label", "parts", "code")
    width = length // n_parts

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _cut(batch.column("parts"), n_parts)
            points = books.points.astype(_kind(books.points, vectors))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(vectors), n_parts)
            near = points[np.arange(n_parts), code].reshape(len(vectors), n_parts, width)
            total = _distances(vectors.astype(points.dtype), near).astype(object).sum(1)
            found = pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("code"), found], names=["id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    done = coded.mapInArrow(error, f"id long, label {kind}, code binary, error long")
    others = kept.where(~same).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return Coded(scratch.write(done.unionByName(others), "coded"), books)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of equal labels together, nulls being equal; null where they go beyond 64 bits or there are none."""
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
