"""Byte-level BPE by ranks: Spark's higher-order functions fold merges over the bytes of distinct words.

A text is cut into words by the vocabulary's pattern.  A word starts as the
array of its bytes, and each step of an ``aggregate`` joins the neighbours whose
concatenation has the lowest rank, which a literal map of all ranks tells; what
is left are the word's tokens.  The corpus's commonest words, up to a stated
number, are folded once each and their ids are looked up from then on; the
rest are folded where they stand.  Either way gives the same ids, so
how many words are common decides the work and nothing else.  Decoding joins the
ids' bytes.

All of it is column expressions.  Bytes are
joined as an array of strings, which need not be valid text, since Spark joins those in
linear time and binary ones pair by pair.

Null and empty texts have no ids.  Texts and words of any length are encoded
whole: a short word is merged pair by pair; in a long one a step joins all pairs of the
lowest rank, so a run of one letter takes a few steps, and a word of n bytes
takes as many passes as it has different merges.  Equal texts and repeated rows have equal
ids; an empty table gives an empty one.  Encoding and decoding are functions of
columns; the caller chooses the names, so none can clash.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.plans.scratch import Scratch

#: Words that are looked up instead of folded where they stand; of at most ``COMMON_BYTES`` bytes each, which bounds the table.
COMMON_WORDS, COMMON_BYTES = 500_000, 64
#: Words of more bytes are merged rank by rank.
LONG = 48
#: Bits of an id; two to the others are the buckets of the rank map, and of the common words.
ID_BITS, PAIR_BITS, WORD_BITS = 20, 16, 17
#: Spreads pairs of ids over buckets; stands for the rank of a pair that no merge joins.
SPREAD, NONE = 40503, (1 << 40) - 1


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is the id, from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=8)
def _class_of(name: str) -> str:
    """A range list of the characters that the tiktoken library's tables file under a class; its Unicode version differs from Java's."""
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    found = bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)).decode()
    ranges: list[list[int]] = []
    for c in map(ord, found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def java_pattern(pattern: str) -> str:
    r"""The pattern as Java must read it to cut as tiktoken does.

    Java's ``\s`` takes Unicode's white space only when told; letters and numbers that
    its tables don't have yet are unassigned there, and are looked for among those.
    """
    letters, numbers = _class_of(r"\p{L}"), _class_of(r"\p{N}")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[\S&&\P{{L}}&&\P{{N}}&&[\P{{Cn}}[^{letters}{numbers}]]]", 1)
    head, found, tail = out.partition(r"[\S&&\P{L}")
    swap = lambda s: s.replace(r"\p{L}", rf"[\p{{L}}[\p{{Cn}}&&[{letters}]]]").replace(r"\p{N}", rf"[\p{{N}}[\p{{Cn}}&&[{numbers}]]]")
    if not found and r"\p" in pattern.partition("[^")[2].partition("]")[0]:
        raise ValueError(f"a negated class that is not known here: {pattern}")
    if not found:
        return "(?U)" + swap(out)
    close = tail.index("]]]") + 3
    return "(?U)" + swap(head) + found + tail[:close] + swap(tail[close:])


def words(text: Column, pattern: str) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: the engine would evaluate each mention anew inside a lambda."""
    return F.transform(F.array(value), use)[0]


def write_ranks(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """A rank file as one row of tables.

    ``ranks`` maps two neighbours, as one number, to the id of what they make; it
    is an array of small maps, as Spark looks through a map entry by entry.
    ``starts`` holds the elements of all pairs of bytes, ``ends`` those of a last byte;
    ``pieces`` and ``packed`` have the bytes of an id's token and of the id itself.
    """
    ids = read_ranks(path)
    top = max(ids.values())
    if top >= 1 << ID_BITS:
        raise ValueError("ids of this size don't fit the rank map")
    if any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("a single byte has no rank")
    keys: list[list[int]] = [[] for _ in range(1 << PAIR_BITS)]
    made: list[list[int]] = [[] for _ in range(1 << PAIR_BITS)]
    pieces = [""] * (top + 1)
    for token, i in ids.items():
        pieces[i] = token.hex().upper()
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                at = (a * SPREAD + b) & (1 << PAIR_BITS) - 1
                keys[at].append(a << ID_BITS | b)
                made[at].append(i)
    told = sorted(range(256), key=lambda b: zlib.crc32(bytes([b])) >> 24)
    starts = [ids.get(bytes([a, b]), NONE) << ID_BITS | ids[bytes([a])] for a in told for b in told]
    ends = [NONE << ID_BITS | ids[bytes([a])] for a in told]
    row = {"keys": keys, "made": made, "pieces": pieces, "packed": [i.to_bytes(4, "little").hex().upper() for i in range(top + 1)], "starts": starts, "ends": ends}
    schema = "keys array<array<bigint>>, made array<array<bigint>>, pieces array<string>, packed array<string>, starts array<bigint>, ends array<bigint>"
    one = spark.range(1).select(F.from_json(F.lit(json.dumps(row, separators=(",", ":"))), schema).alias("row")).select("row.*")
    raw = lambda c: F.transform(c, lambda x: F.unhex(x).cast("string")).alias(c)
    return scratch.write(one.select(F.zip_with("keys", "made", F.map_from_arrays).alias("ranks"), raw("pieces"), raw("packed"), "starts", "ends"), "ranks")


@contextmanager
def literals(tables: DataFrame) -> Iterator[dict[str, Column]]:
    """The columns of a one-row table as literals: session variables, while the caller builds its plan.  A plan keeps the values."""
    spark, own = tables.sparkSession, uuid.uuid4().hex
    view, names = f"one_{own}", {c: f"{c}_{own}" for c in tables.columns}
    tables.createOrReplaceTempView(view)
    try:
        for c, name in names.items():
            spark.sql(f"DECLARE VARIABLE {name} {tables.schema[c].dataType.simpleString()}")
            spark.sql(f"SET VAR {name} = (SELECT {c} FROM {view})")
        yield {c: F.expr(f"session.{name}") for c, name in names.items()}
    finally:
        for name in names.values():
            spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        spark.catalog.dropTempView(view)


class RankCodec:
    """Column functions of one rank file, whose tables are literals, and pattern."""

    def __init__(self, tables: dict[str, Column], pattern: str):
        self.tables, self.pattern = tables, pattern

    def fold(self, word: Column) -> Column:
        """A word's ids; the word isn't empty."""
        return Fold(self.tables).ids(word)

    def encode(self, text: Column, common: Column | None = None) -> Column:
        """A text's ids as an array; ``common`` is the table that ``common_words`` made, as a literal."""
        known = lambda w: [] if common is None else [common[F.hash(w).bitwiseAND((1 << WORD_BITS) - 1)][w]]
        return F.flatten(F.transform(words(text, self.pattern), lambda w: F.coalesce(*known(w), self.fold(w))))

    def pack(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers in one binary."""
        return F.array_join(F.transform(ids, lambda i: self.tables["packed"][i]), "").cast("binary")

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids' tokens, joined."""
        return F.array_join(F.transform(ids, lambda i: self.tables["pieces"][i]), "").cast("binary")


class Fold:
    """The merges of one word.  An element is an id and, above its bits, the rank of its union with the next one."""

    def __init__(self, tables: dict[str, Column]):
        self.ranks, self.starts, self.ends = tables["ranks"], tables["starts"], tables["ends"]

    def _join(self, a: Column, b: Column) -> Column:
        made = self.ranks[(a * SPREAD + b).bitwiseAND((1 << PAIR_BITS) - 1)][F.shiftleft(a, ID_BITS) + b]
        return F.shiftleft(F.coalesce(made, F.lit(NONE)), ID_BITS) + a

    def ids(self, word: Column) -> Column:
        raw = word.cast("binary")
        by_size = lambda e: F.when(F.size(e) <= LONG, self._pair_by_pair(e)).otherwise(self._rank_by_rank(e))
        return F.transform(_let(self._start(raw), by_size), lambda x: _id(x).cast("int"))

    def _start(self, word: Column) -> Column:
        """The elements of a word's bytes.  The checksum of one byte is told by its highest eight bits."""
        told = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.shiftright(F.crc32(F.substring(word, i, F.lit(1))), 24))
        return _let(told, lambda t: F.transform(t, lambda a, i: F.coalesce(self.starts[a * 256 + F.get(t, i + 1)], self.ends[a])))

    def _pair_by_pair(self, elements: Column) -> Column:
        """All merges of a short word, one a step: the lowest rank and of its places the leftmost."""

        def merged(e: Column, rank: Column, at: Column) -> Column:
            anew = lambda x, i: F.when(i == at - 1, self._join(_id(x), rank)).when(i == at, self._join(rank, _id(F.get(e, at + 2)))).otherwise(x)
            return F.filter(F.transform(e, anew), lambda _, i: i != at + 1)

        def step(e: Column, _: Column) -> Column:
            place = lambda best: F.array_position(e, best).cast("int") - 1
            return _let(F.array_min(e), lambda best: F.when(best >= NONE << ID_BITS, e).otherwise(_let(place(best), lambda at: merged(e, _rank(best), at))))

        return F.aggregate(_steps(F.size(elements)), elements, step)

    def _rank_by_rank(self, elements: Column) -> Column:
        """The same for a long word, all pairs of the lowest rank in a step; where they overlap, each second one of a run from the left."""

        def merged(e: Column, rank: Column) -> Column:
            marks = F.replace(F.array_join(F.transform(e, lambda x: F.when(_rank(x) == rank, F.lit("1")).otherwise(F.lit("0"))), ""), F.lit("11"), F.lit("10"))
            return _let(F.regexp_extract_all(marks, F.lit("."), F.lit(0)), lambda m: rejoined(F.filter(F.zip_with(e, m, lambda x, c: F.when(c == "1", rank).otherwise(_id(x))), lambda _, i: F.coalesce(F.get(m, i - 1) != "1", F.lit(True)))))

        def rejoined(ids: Column) -> Column:
            return _let(ids, lambda p: F.transform(p, lambda a, i: self._join(a, F.get(p, i + 1))))

        def step(s: Column, _: Column) -> Column:
            go_on = lambda rank: F.when(rank >= NONE, F.struct(s["e"].alias("e"), F.lit(True).alias("done"))).otherwise(F.struct(merged(s["e"], rank).alias("e"), F.lit(False).alias("done")))
            return F.when(s["done"], s).otherwise(_let(_rank(F.array_min(s["e"])), go_on))

        return F.aggregate(_steps(F.size(elements)), F.struct(elements.alias("e"), F.lit(False).alias("done")), step, lambda s: s["e"])


def _id(element: Column) -> Column:
    return element.bitwiseAND((1 << ID_BITS) - 1)


def _rank(element: Column) -> Column:
    return F.shiftright(element, ID_BITS)


def _steps(n: Column) -> Column:
    """As many steps as ``n`` elements can need."""
    return F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))


def common_words(docs: DataFrame, codec: RankCodec, scratch: Scratch, text: str = "text", most: int = COMMON_WORDS) -> DataFrame:
    """One row with ``common``: an array of maps from word to ids, for at most ``most`` of the commonest words of all texts.

    A word is in the map that its hash numbers.  Counts are summed before they
    are shuffled; a histogram of their logarithms tells the least count.
    """
    found = docs.select(F.explode(words(F.col(text), codec.pattern)).alias("word")).where(F.octet_length("word") <= COMMON_BYTES)
    counts = scratch.write(found.groupBy("word").agg(F.count("*").alias("n")), "words")
    size = F.floor(F.log2(F.col("n")) * 64).cast("int")
    histogram = sorted(((r["size"], r["words"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, room = None, most  # some thousand classes at most, as counts are 64-bit
    for k, n in histogram:
        room -= n
        if room < 0:
            break
        least = k
    chosen = counts.where(size >= least if least is not None else F.lit(False)).repartition("word").select("word", codec.fold(F.col("word")).alias("ids"))
    rows = chosen.select(F.hash("word").bitwiseAND((1 << WORD_BITS) - 1).alias("bucket"), F.struct("word", "ids").alias("entry"))
    rows = rows.unionByName(docs.sparkSession.range(1 << WORD_BITS).select(F.col("id").cast("int").alias("bucket")), allowMissingColumns=True)
    maps = rows.groupBy("bucket").agg(F.map_from_entries(F.collect_list("entry")).alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", F.map_entries("words").alias("words"))))
    table = maps.agg(ordered.alias("all")).select(F.transform("all", lambda s: F.map_from_entries(s["words"])).alias("common"))
    out = scratch.write(table, "common")
    scratch.drop(counts)
    return out
