"""Long repeated byte strings, by run-compressed Burrows-Wheeler indexes.

Every window of ``length`` bytes has one anchor: the leftmost gram of minimal
hash inside it.  Equal windows have equal anchors at equal places, so windows
need only be compared among those of one anchor gram.  A document's windows fall
into runs with the same anchor; the bytes of such a run are its context.

1. Grams that anchor once are dropped by a count; no text moves.
2. Contexts of one gram that are equal as a whole are repeated as a whole.
3. The distinct contexts of a gram are indexed together, in buckets of bounded
   size: suffix order by doubling, the Burrows-Wheeler transform, its runs.  Only
   where a run begins is a suffix sampled with its predecessor and the length of
   their common prefix found; by the transform's order every other position's
   longest match is its sample's, shortened by the distance, so marking both
   places of each sample with a long enough match marks all.
4. A gram with very many distinct contexts is not gathered: its windows are
   compared by hash in blocks, then singly where a block is undecided.

Equal contexts agree in two 64-bit hashes of different kinds, of the gram and of
the whole context.

Texts are UTF-8 bytes, null as empty; matches never cross documents, and strings
are judged on the input.  Texts shorter than ``length`` lose nothing; very long
ones are read whole.  Rows with one id must have one text; such repeated rows are
copies of each other.  All equal strings go, so there are no ties.  An empty
table gives an empty one.  Only the id and text columns are read, whatever else
there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from kerbline.llm.arrow import bound_batches, texts
from kerbline.plans.scratch import Scratch

GRAM = 32
#: Bytes of contexts that a bucket aims at, and distinct contexts of a gram above which its windows are not gathered.
BUCKET_BYTES = 1_500_000
HOT_CONTEXTS = 4000
BLOCK = 8

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of one byte string, each in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """(gram hash, context hash, first window, context end, anchor place) of each run of windows with one anchor."""
    n = len(data)
    if n < length:
        return None
    width = length - GRAM + 1
    rolling = Rolling(data)
    at = np.arange(n - GRAM + 1)
    value = rolling.of(at, at + GRAM)
    low, place, reach = value, at, 1
    while 2 * reach <= width:
        m = len(low) - reach
        left = low[:m] <= low[reach:]
        place = np.where(left, place[:m], place[reach:])
        low = np.where(left, low[:m], low[reach:])
        reach *= 2
    shift, m = width - reach, n - length + 1
    place = np.where(low[:m] <= low[shift : shift + m], place[:m], place[shift : shift + m])
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    end = np.r_[first[1:], m] - 1 + length
    anchor = place[first]
    view = memoryview(data)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))
    return value[anchor], whole, first, end, anchor


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


RUN = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def runs_of(length: int):
    """text -> array of its anchor runs."""

    @F.arrow_udf(T._parse_datatype_string("array<struct<h:long,c:long,s:int,e:int>>"))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, sizes = [], [0]
            for text in texts(batch):
                runs = anchor_runs(_bytes_of(text), length)
                if runs:
                    found.append(runs)
                sizes.append(sizes[-1] + (len(runs[0]) if runs else 0))
            parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4)]
            columns = [parts[0].astype(np.uint64).view(np.int64), parts[1].astype(np.uint64).view(np.int64), parts[2].astype(np.int32), parts[3].astype(np.int32)]
            items = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN))
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)

    return apply


@F.arrow_udf(T.BinaryType())
def packed(text: pa.Array) -> pa.Array:
    """Compressed UTF-8 bytes, so that a join moves half as much."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts(text)], pa.binary())


def unpacked(blob: bytes) -> bytes:
    return zstandard.decompress(blob)


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def pieces_of(blob: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes at each of a list of (s, e)."""
    out = []
    for b, wanted in zip(blob.to_pylist(), spans.to_pylist(), strict=True):
        data = unpacked(b)
        out.append([data[w["s"] : w["e"]] for w in wanted])
    return pa.array(out, pa.list_(pa.binary()))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several byte strings, sampled where runs begin.

    Strings are laid out one after another, each with an end mark of its own that
    sorts before all bytes and among themselves in their order.
    """

    FIRST = 7

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(x) for x in strings], np.int64)
        begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
        n = int(sizes.sum()) + len(strings)
        self.begin, self.sizes, self.n = begin, sizes, n
        text = np.zeros(n + self.FIRST, np.int64)  # 0 is the end mark; bytes are 1 to 256
        for b, x in zip(begin.tolist(), strings, strict=True):
            text[b : b + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 1
        self.text = text
        stop = np.repeat(begin + sizes, sizes + 1)  # of each place, where its string's end mark is
        self.left = stop - np.arange(n)  # bytes up to it
        key = np.zeros(n, np.int64)
        for k in range(self.FIRST):
            key = (key << 9) | np.where(self.left > k, text[k : k + n], 0)
        self.levels: list[tuple[int, np.ndarray]] = []
        span = self.FIRST
        longest = int(sizes.max()) if len(sizes) else 0
        rank = self._ranks(key)
        self.levels.append((span, rank))
        while span < longest:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left > span)
            after[inside] = rank[inside + span] + 1
            rank = self._ranks(rank.astype(np.int64) * (n + 1) + after)
            span *= 2
            self.levels.append((span, rank))
        self.order = np.argsort(rank.astype(np.int64) * n + np.arange(n))  # equal suffixes end their strings: by string
        before = np.where(self.order > 0, text[self.order - 1], 0)
        # a run begins where the byte before differs; end marks are all different
        self.heads = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        self.runs = len(self.heads) + 1

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        return rank

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``p`` and ``q``."""
        done = np.zeros(len(p), np.int64)
        room = np.minimum(self.left[p], self.left[q])
        for span, rank in reversed(self.levels):
            fits = np.flatnonzero(done + span <= room)
            same = fits[rank[p[fits] + done[fits]] == rank[q[fits] + done[fits]]]
            done[same] += span
        for _ in range(self.FIRST):
            fits = np.flatnonzero(done < room)
            same = fits[self.text[p[fits] + done[fits]] == self.text[q[fits] + done[fits]]]
            done[same] += 1
        return done

    def matches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, other place, common length) of the samples whose match is at least ``length``."""
        p, q = self.order[self.heads], self.order[self.heads - 1]
        able = np.minimum(self.left[p], self.left[q]) >= length
        for span, rank in self.levels:
            if span <= length:
                able &= rank[p] == rank[q]
        p, q = p[able], q[able]
        size = self.common(p, q)
        long = size >= length
        return p[long], q[long], size[long]

    def covered(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, end) of the maximal stretches covered by matches."""
        p, q, size = self.matches(length)
        edge = np.zeros(self.n + 1, np.int64)
        for place in (p, q):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + size, -1)
        on = np.r_[False, np.cumsum(edge)[: self.n] > 0, False]  # end marks are never covered, so stretches keep to their string
        start, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
        which = np.searchsorted(self.begin, start, "right") - 1
        return which, start - self.begin[which], end - self.begin[which]


SPAN = pa.schema([("id", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _index_bucket(length: int):
    def apply(table: pa.Table) -> pa.Table:
        index = RunIndex(table["bytes"].to_pylist())
        which, start, end = index.covered(length)
        ids, at = table["id"].to_numpy()[which], table["s"].to_numpy()[which]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array((at + start).astype(np.int32)), pa.array((at + end).astype(np.int32))], schema=SPAN)

    return apply


def _block_hashes(length: int):
    """Context bytes -> its blocks of windows: first and last window, hash of all their bytes together, hash of the bytes that all windows of the full block share."""

    @F.arrow_udf(T._parse_datatype_string("array<struct<x:int,y:int,whole:long,core:long>>"))
    def apply(batch: pa.Array) -> pa.Array:
        out = []
        for raw in batch.to_pylist():
            data = np.frombuffer(raw, np.uint8)
            anchor = int(anchor_runs(data, length)[4][0])
            rolling = Rolling(data)
            x = np.arange(len(data) - length + 1)
            grid = (anchor - x) // BLOCK  # by distance to the anchor, so that equal windows fall alike
            first = np.flatnonzero(np.r_[True, grid[1:] != grid[:-1]])
            last = np.r_[first[1:], len(x)] - 1
            near = anchor - grid[first] * BLOCK  # the full block's last window
            whole = _mix(rolling.of(first, last + length) ^ (near - first).astype(np.uint64))
            core = rolling.of(near, near - BLOCK + 1 + length)
            out.append([{"x": int(a), "y": int(b), "whole": int(w), "core": int(c)} for a, b, w, c in zip(first, last, whole.view(np.int64), core.view(np.int64), strict=True)])
        kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("whole", pa.int64()), ("core", pa.int64())]))
        return pa.array(out, kind)

    return apply


def _window_hashes(length: int):
    """Context bytes, first and last window -> the hash of each window between."""

    @F.arrow_udf(T._parse_datatype_string("array<long>"))
    def apply(raw: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(
            [[xxhash.xxh3_64_intdigest(b[i : i + length]) - 2**63 for i in range(p, q + 1)] for b, p, q in zip(raw.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)],
            pa.list_(pa.int64()),
        )

    return apply


def _spread(hot: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated stretches among contexts of grams with very many of them, by counts of hashes only."""
    blocks = scratch.write(hot.select("h", "id", "s", "bytes", F.explode(_block_hashes(length)("bytes")).alias("k")).select("h", "id", "s", "bytes", "k.*"), "blocks")
    twice = lambda c: blocks.groupBy("h", c).agg(F.count("*").alias("n")).where("n > 1").select("h", c)
    whole = blocks.join(twice("whole"), ["h", "whole"], "left_semi")
    open_ = blocks.join(twice("whole"), ["h", "whole"], "left_anti").join(twice("core"), ["h", "core"], "left_semi")
    # a block found whole elsewhere may hold the window that an undecided one repeats, so its windows are counted too
    tested = blocks.join(twice("core"), ["h", "core"], "left_semi").join(open_.select("h", "core").distinct(), ["h", "core"], "left_semi")
    windows = scratch.write(tested.select("h", "id", "s", F.posexplode(_window_hashes(length)("bytes", "x", "y")).alias("i", "w"), "x").select("h", "w", "id", (F.col("s") + F.col("x") + F.col("i")).alias("at")), "windows")
    again = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    single = windows.join(again, ["h", "w"], "left_semi")
    return whole.select("id", (F.col("s") + F.col("x")).cast("int").alias("s"), (F.col("s") + F.col("y") + length).cast("int").alias("e")).unionByName(
        single.select("id", F.col("at").cast("int").alias("s"), (F.col("at") + length).cast("int").alias("e"))
    )


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int, bucket_bytes: int, hot_contexts: int) -> DataFrame:
    """(id, s, e): stretches of bytes covered by strings of ``length`` that start more than once; they may touch and overlap."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = scratch.write(source.select("id", F.explode(runs_of(length)("text")).alias("r")).select("id", "r.*"), "all-runs")
    # written, so that the join's sides are plain shuffles and a gram with very many runs is split
    often = scratch.write(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    kept = scratch.write(runs.join(often, "h", "left_semi"), "runs")
    scratch.drop(runs, often)
    classes = scratch.write(kept.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "s", "e")).alias("r")), "classes")
    equal = kept.join(classes.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("id", "s", "e")

    several = classes.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1")
    chosen = classes.join(several, "h").select("h", "variants", "r.*")
    wanted = chosen.groupBy("id").agg(F.collect_list(F.struct("h", "variants", "s", "e")).alias("w"))  # of one document's runs
    blobs = source.select("id", packed("text").alias("blob"))
    fetched = blobs.join(wanted, "id").select("id", "w", pieces_of("blob", "w").alias("p"))
    contexts, seen = scratch.write_observed(
        fetched.select("id", F.explode(F.arrays_zip("w", "p")).alias("z")).select("id", "z.w.h", "z.w.variants", "z.w.s", F.col("z.p").alias("bytes")).dropDuplicates(["id", "s"]),
        "contexts",
        F.sum(F.octet_length("bytes").cast("long")).alias("bytes"),
        F.max("variants").alias("most"),
    )
    buckets = 1 + (seen["bytes"] or 0) // bucket_bytes
    usual = contexts.where(F.col("variants") <= hot_contexts).select(F.pmod("h", F.lit(buckets)).alias("bucket"), "id", "s", "bytes")
    found = usual.groupBy("bucket").applyInArrow(_index_bucket(length), "id long, s int, e int")
    spans = equal.unionByName(found)
    if (seen["most"] or 0) > hot_contexts:
        spans = spans.unionByName(_spread(contexts.where(F.col("variants") > hot_contexts), length, scratch))
    return spans


def _cut():
    """Compressed text and its stretches -> what is removed and what stays."""

    @F.arrow_udf(T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<s:int,e:int>>"))
    def apply(blob: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for b, given in zip(blob.to_pylist(), spans.to_pylist(), strict=True):
            data = unpacked(b)
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in given or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at, stay = 0, []
            for s, e in merged:
                stay.append(data[at:s])
                at = e
            stay.append(data[at:])
            rows.append((len(data), sum(e - s for s, e in merged), len(merged), b"".join(stay), [{"s": s, "e": e} for s, e in merged]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return apply


def remove_repeats(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
    bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (their places).

    Every byte covered by a ``length``-byte string that starts at least twice in
    the table is removed, wherever it occurs.
    """
    bound_batches(docs.sparkSession, 1000)
    spans = repeated_spans(docs, scratch, id_col, text_col, length, bucket_bytes, hot_contexts)
    of_doc = spans.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # of one document
    blobs = docs.select(F.col(id_col).cast("long").alias("id"), packed(F.col(text_col).cast("string")).alias("blob"))
    done = blobs.join(of_doc, "id", "left").select("id", _cut()("blob", "spans").alias("r"))
    return done.select(F.col("id").alias(id_col), "r.*")
