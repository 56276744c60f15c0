"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and proofs by coordinate lookup.

A row's leaf is the digest of its fields.  Within a group leaves are numbered in
order; runs of ``arity`` neighbours are digested into the nodes of the next level
until one is left, the group's subroot, and subroots are joined likewise into the root.
All nodes are written as a table keyed by their coordinates: group, level, place.

A proof needs no tree at hand.  Which siblings a leaf has on each level follows from
its number and the size of its group; it explodes into their coordinates, which
are joined to the node table, put in order, concatenated and folded.  So that no node
is asked for by half of all leaves, a lookup goes up ``stride`` levels at most: there
a whole block of leaves shares what is above, and the blocks ask for it in their turn.

A null field is told from every text; rows with a null group are a group of their own,
the first.  Rows that tie in the order follow their digests, and equal rows are leaves each.
One row alone is its group's subroot, one group alone gives the root, and an
empty table has neither root nor rows.  Texts are digested whole.  Only the named
columns are read and outputs are named here, so further columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.plans.scratch import Scratch

#: Leaves, at most, that one block gathers.
BLOCK = 1024


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: ``-`` for null, else the value's length in bytes, ``:`` and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _h(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with ``at``, their number in their group, and ``n``, the group's size; and the largest such size.

    Rows are range-partitioned, and only one row for each group in each part goes through a running sum.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "digest")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("place", 33))
    ordered = scratch.write(placed, "ordered")
    sizes = ordered.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("own").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(group).alias("n"))
    sizes, seen = scratch.write_observed(sizes, "sizes", F.max("n").alias("most"))
    return ordered.join(sizes, ["grp", "part"]).withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift"), seen["most"] or 0


@dataclass
class Tree:
    """``leaves`` (grp, at, n, digest and what was carried) and ``nodes`` (grp, n, level, at, digest), leaves included; ``most`` is the largest n."""

    leaves: DataFrame
    nodes: DataFrame
    most: int
    arity: int

    @property
    def stride(self) -> int:
        return max(k for k in range(1, 11) if k == 1 or self.arity**k <= BLOCK)

    def power(self, k: Column) -> Column:
        return F.array(*(F.lit(self.arity**i).cast("long") for i in range(64) if self.arity**i < 1 << 62))[k]

    def depth(self, n: Column) -> Column:
        """Levels above the leaves of a group of n."""
        powers = [self.arity**i for i in range(64) if self.arity**i < 1 << 62]
        return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))

    def bases(self) -> list[int]:
        """The levels at which some group's blocks begin."""
        return [b for b in range(0, 64, self.stride) if b == 0 or self.arity**b < self.most]


def build(rows: DataFrame, order: list[str], scratch: Scratch, arity: int = 2) -> Tree:
    """The trees over ``rows``: ``grp`` (not null), ``digest``, the columns of ``order`` and any others."""
    leaves, most = _numbered(rows, order, scratch)
    tree = Tree(leaves, leaves.select("grp", "n", F.lit(0).alias("level"), "at", "digest"), most, arity)
    size = arity**tree.stride
    level = tree.nodes
    for base in tree.bases():
        # a block's levels are made at once, from at most BLOCK nodes (or one run)
        up = F.least(F.lit(tree.stride), tree.depth(F.col("n")) - base)
        some = level.where(tree.depth(F.col("n")) > base)
        blocks = some.groupBy("grp", "n", _div(F.col("at"), F.lit(size)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("own"))
        run = lambda below, i: F.array_join(F.transform(F.slice(below, i * arity + 1, F.lit(arity)), text_of), "")
        parents = lambda below: F.transform(F.sequence(F.lit(0), _div(F.size(below) - 1, F.lit(arity)).cast("int")), lambda i: _h(run(below, i)))
        grown = F.aggregate(F.sequence(F.lit(1), up), F.array(F.transform("own", lambda s: s["digest"])), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))
        levels = blocks.select("grp", "n", "block", F.posexplode(grown).alias("step", "made")).where("step > 0")
        wide = levels.select("grp", "n", "step", "block", F.posexplode("made").alias("j", "digest"))
        at = F.col("block") * tree.power(F.lit(tree.stride) - F.col("step")) + F.col("j")
        made = scratch.write(wide.select("grp", "n", (F.col("step") + base).cast("int").alias("level"), at.alias("at"), "digest"), "nodes")
        tree.nodes = tree.nodes.unionByName(made)
        level = made.where(F.col("level") == base + tree.stride)
    return tree


def subroots(tree: Tree) -> DataFrame:
    """grp and digest of each group's last node."""
    return tree.nodes.where((F.col("at") == 0) & (F.col("level") == tree.depth(F.col("n")))).select("grp", "digest")


def _own_paths(tree: Tree, items: DataFrame, base: int) -> DataFrame:
    """(grp, at, path) of nodes of level ``base``: for each level up to the next base, the digests before and after their own."""
    up = F.least(F.lit(tree.stride), tree.depth(F.col("n")) - base)
    levels = F.when(up > 0, F.sequence(F.lit(0), up - 1)).otherwise(F.array().cast("array<int>"))

    def siblings(k: Column) -> Column:
        own = _div(F.col("at"), tree.power(k))
        first, count = own - own % tree.arity, _div(F.col("n") - 1, tree.power(k + base)) + 1
        there = F.filter(F.sequence(first, first + (tree.arity - 1)), lambda j: (j != own) & (j < count))
        return F.transform(there, lambda j: F.struct(k.alias("k"), j.alias("j")))

    wanted = items.select("grp", "at", F.explode(F.flatten(F.transform(levels, siblings))).alias("c")).select("grp", F.col("at").alias("of"), "c.k", "c.j")
    table = tree.nodes.where(F.col("level").between(base, base + tree.stride - 1))
    table = table.select("grp", (F.col("level") - base).alias("k"), F.col("at").alias("j"), "digest")
    found = wanted.join(table, ["grp", "k", "j"]).groupBy("grp", "of").agg(F.sort_array(F.collect_list(F.struct("k", "j", "digest"))).alias("found"))

    def step(k: Column) -> Column:
        own = _div(F.col("at"), tree.power(k))
        side = lambda keep: F.unhex(F.array_join(F.transform(F.filter("found", keep), lambda s: F.hex(s["digest"])), ""))
        return F.struct(side(lambda s: (s["k"] == k) & (s["j"] < own)).alias("before"), side(lambda s: (s["k"] == k) & (s["j"] > own)).alias("after"))

    own = items.select("grp", "at", "n").join(found.withColumnRenamed("of", "at"), ["grp", "at"], "left")
    none = F.array().cast("array<struct<k:int,j:bigint,digest:binary>>")
    return own.withColumn("found", F.coalesce("found", none)).select("grp", "at", F.transform(levels, step).alias("path"))


def paths(tree: Tree, scratch: Scratch, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``path``, from the leaf up.  ``above`` (grp, path, any others) is appended for whole groups."""
    size = F.lit(tree.arity**tree.stride)
    no_steps = F.array().cast("array<struct<before:binary,after:binary>>")
    upper = None  # (grp, block, path): what a node of the next base has above it
    for base in reversed(tree.bases()[1:]):
        own = _own_paths(tree, tree.nodes.where((F.col("level") == base) & (tree.depth(F.col("n")) > base)), base)
        if upper is not None:
            own = own.withColumn("block", _div(F.col("at"), size)).join(upper.withColumnRenamed("path", "rest"), ["grp", "block"], "left")
            own = own.select("grp", "at", F.concat("path", F.coalesce("rest", no_steps)).alias("path"))
        upper = scratch.write(own.withColumnRenamed("at", "block"), "paths")
    blocks = tree.leaves.where(F.col("at") % size == 0).select("grp", _div(F.col("at"), size).alias("block"))
    blocks = blocks.withColumn("rest", no_steps) if upper is None else blocks.join(upper.withColumnRenamed("path", "rest"), ["grp", "block"], "left")
    if above is not None:
        blocks = blocks.join(above.withColumnRenamed("path", "last"), "grp").withColumn("rest", F.concat(F.coalesce("rest", no_steps), "last")).drop("last")
    own = _own_paths(tree, tree.leaves, 0).withColumnRenamed("path", "own")
    found = tree.leaves.join(own, ["grp", "at"]).withColumn("block", _div(F.col("at"), size)).join(blocks, ["grp", "block"])
    return found.withColumn("path", F.concat("own", F.coalesce("rest", no_steps))).drop("own", "rest", "block")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda own, s: _h(F.concat(text_of(s["before"]), text_of(own), text_of(s["after"]))))


def proof_digest(path: Column) -> Column:
    """H of all siblings from the leaf up, left to right."""
    return _h(F.array_join(F.transform(path, lambda s: F.concat(text_of(s["before"]), text_of(s["after"]))), ""))


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], scratch: Scratch, claims: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """Per row of ``docs``: ``key`` (its ``order``), ``leaf``, ``subroot``, ``root``, ``path`` and the ``claims``, columns over ``docs`` that are carried along."""
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null comes first
    carried = {f"claim_{k}": v for k, v in (claims or {}).items()}
    rows = docs.select(grp.alias("grp"), F.col(order).alias("key"), leaf_digest(*map(F.col, fields)).alias("digest"), *(v.alias(k) for k, v in carried.items()))
    tree = build(rows, ["key"], scratch, arity)
    groups = scratch.write(subroots(tree).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "subroots")
    top = build(groups, ["name"], scratch, arity)
    root = subroots(top).first()  # one row
    above = paths(top, scratch).select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"))
    found = paths(tree, scratch, scratch.write(above, "above"))
    return found.select("key", F.col("digest").alias("leaf"), "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "path", *(F.col(k).alias(k.removeprefix("claim_")) for k in carried))
