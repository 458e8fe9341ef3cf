"""Merkle manifest of a table: every row a leaf, a tree for each group of rows, a tree over the groups' roots.

A node is the lowercase hex SHA-256 of what stands below it, written one after another; every ``FAN`` consecutive nodes
of a level (the last run may be shorter, even one) have a parent, while a level has more than one. Leaves of a group
ascend by key. Groups stand in bytewise order, null first, and their roots are the leaves of the last tree.

``FAN ** LEVELS`` neighbouring nodes form an aligned block, one row. A block keeps each of its levels as one hex
string: parents are hashes of its fixed-width substrings, and the siblings of a node are what flanks it in its run.
Blocks' roots are the nodes of the next round, until each group has one node. On the way back down a block hands its
members the path above it: pairs of (left, right) siblings from a leaf's level up to the root.

Positions are counted by ranges (``common.positions``), so a group of any size is spread over all tasks; a block is
all that ever meets in one row. Each round's blocks are a written table.

Cases: nulls in any column are leaves of their own form (``-``); null keys stand first; rows with equal keys stand in
the order of their leaves; repeated rows are leaves like any other; null is a group; an empty table has no root and no
proofs; columns that aren't ``fields`` are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BROADCAST_BYTES, LOWER, UPPER, cut, positions, small

#: 2**BITS nodes have a parent; a block holds LEVELS levels below its root.
BITS, LEVELS, HEX = 4, 3, 64
FAN, SIZE = 1 << BITS, 1 << (BITS * LEVELS)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _near(paths: DataFrame) -> DataFrame:
    """A table of paths, broadcast if it is small: a step of a path has up to 64 times the bytes that ``small`` counts for it."""
    return small(cut(paths), BROADCAST_BYTES // 64)


def _runs(level: str) -> Column:
    """The fixed-width substrings of a level that have a parent each."""
    return F.transform(F.sequence(F.lit(1), F.length(level), F.lit(FAN * HEX)), lambda at: F.substring(F.col(level), at, F.lit(FAN * HEX)))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, n, items, l0, l1, ..., root) from nodes (g, pos, n, digest, item); n nodes are in the group's level."""
    packed = nodes.groupBy("g", F.expr(f"pos div {SIZE}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("m"))
    out = packed.select("g", "block", "n", F.transform("m", lambda x: x.item).alias("items"), F.array_join(F.transform("m", lambda x: x.digest), "").alias("l0"))
    for k in range(LEVELS):
        parents = F.array_join(F.transform(_runs(f"l{k}"), lambda run: F.sha2(run, 256)), "")
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN**k, parents))
    return cut(out.withColumn("root", F.coalesce(*[f"l{k}" for k in range(LEVELS, -1, -1)])).drop(f"l{LEVELS}"))


def _path(i: Column) -> Column:
    """Pairs of siblings of a block's i-th node, up to the root of its tree."""
    steps = []
    for k in range(LEVELS):
        run, at = F.get(F.col(f"r{k}"), F.shiftright(i, BITS * (k + 1))), F.shiftright(i, BITS * k).bitwiseAND(FAN - 1) * HEX
        steps.append(F.when(F.col("n") > FAN**k, F.struct(F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + HEX + 1, F.lit(FAN * HEX)).alias("right"))))
    return F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("above"))


def _members(blocks: DataFrame, finish: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(g, block, i, subroot, x): ``finish`` of each member's item, digest and path, in blocks with the path above them."""
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"r{k}", F.coalesce(_runs(f"l{k}"), F.array().cast("array<string>")))

    def member(item: Column, i: Column) -> Column:
        run = F.get(F.col("r0"), F.shiftright(i, BITS))
        return F.struct(item.alias("item"), F.substring(run, i.bitwiseAND(FAN - 1) * HEX + 1, F.lit(HEX)).alias("digest"), _path(i).alias("path"))

    done = F.transform(F.transform("items", member), lambda x: finish(x["item"], x["digest"], x["path"]))
    return blocks.select("g", "block", "subroot", F.posexplode(done).alias("i", "x"))


class Tree:
    """Trees of all groups of ``nodes`` (g, pos, n, digest, item), as rounds of blocks."""

    def __init__(self, nodes: DataFrame):
        self.rounds = [_blocks(nodes)]
        while (self.rounds[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > SIZE:
            above = self.rounds[-1].where(F.col("n") > SIZE)
            self.rounds.append(_blocks(above.select("g", F.col("block").alias("pos"), F.expr(f"(n + {SIZE - 1}) div {SIZE}").alias("n"), F.col("root").alias("digest"), F.lit(0).alias("item"))))
        tops = [r.where(F.col("n") <= SIZE).select("g", F.col("root").alias("digest")) for r in self.rounds]
        self.roots = tops[0]
        for t in tops[1:]:
            self.roots = self.roots.union(t)

    def members(self, above: DataFrame, finish: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """``finish`` of each node's item, digest and path; ``above`` has (g, subroot, above) of each group's root."""
        above, found = _near(above.withColumnRenamed("g", "ag")), None
        for k in range(len(self.rounds) - 1, -1, -1):
            tops = self.rounds[k].where(F.col("n") <= SIZE).join(above, F.col("g") == F.col("ag")).drop("ag")
            if found is not None:
                lower = _near(found.select(F.col("g").alias("bg"), (F.col("block") * SIZE + F.col("i")).alias("bb"), "subroot", F.col("x").alias("above")))
                tops = tops.unionByName(self.rounds[k].where(F.col("n") > SIZE).join(lower, (F.col("g") == F.col("bg")) & (F.col("block") == F.col("bb"))).drop("bg", "bb"))
            found = _members(tops, finish if k == 0 else lambda item, digest, path: path)
        return found


class Manifest:
    """The trees over ``documents``: a leaf for each row from ``fields``, in the order of ``key`` within ``group``.

    ``carry`` are columns that go with a leaf to its proof (``key`` always does).
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None):
        item = F.struct(F.col(key).alias("key"), *[c.alias(name) for name, c in (carry or {}).items()])
        g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
        leaves = cut(documents.select(g.alias("g"), F.col(key).alias("key"), leaf([F.col(f"`{c}`") for c in fields]).alias("digest"), item.alias("item")))
        self.empty, self.item = leaves.isEmpty(), leaves.schema["item"].dataType
        self.spark, self.root = documents.sparkSession, None
        if self.empty:
            return
        placed = positions(leaves, [F.col("key").asc_nulls_first(), F.col("digest")], "g")
        self.tree = Tree(placed.select("g", "pos", "n", "digest", "item"))
        ranked = positions(cut(self.tree.roots.select(F.lit("").alias("all"), "g", "digest")), [F.col("g")], "all")
        self.over = Tree(ranked.select(F.col("all").alias("g"), "pos", "n", "digest", F.struct("g").alias("item")))
        self.root = self.over.roots.first()["digest"]

    def proofs(self, finish: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
        """(subroot, x) of each leaf: x is ``finish`` of its item, leaf and path, by default these three.

        The path is an array of (left, right): siblings before and after the node, in hex, from the leaf's level to the root.
        """
        finish = finish or (lambda item, digest, path: F.struct(item.alias("item"), digest.alias("leaf"), path.alias("path")))
        if self.empty:
            path = "array<struct<left:string,right:string>>"
            none = self.spark.createDataFrame([], "subroot string").select("subroot", F.lit(None).cast(self.item).alias("i"), F.lit("").alias("d"), F.array().cast(path).alias("p"))
            return none.select("subroot", finish(F.col("i"), F.col("d"), F.col("p")).alias("x"))
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        top = self.over.roots.select("g", F.lit("").alias("subroot"), nothing.alias("above"))
        groups = self.over.members(top, lambda item, digest, path: F.struct(item["g"].alias("g"), digest.alias("subroot"), path.alias("above")))
        return self.tree.members(groups.select("x.*"), finish).select("subroot", "x")


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's hash and its path."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def verified(documents: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Proof and check of each row, where texts with crc32(doc_id) divisible by 5 were lower-cased (A-Z) since.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); a null doc_id's text isn't touched.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    later = leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(f"`{c}`") for c in fields])
    made = Manifest(documents, fields=fields, carry={"later": F.when(changed, later)})

    def check(item: Column, digest: Column, path: Column) -> Column:
        return F.struct(item["key"].alias("doc_id"), digest.alias("leaf"), F.sha2(siblings(path), 256).alias("proof_sha256"), fold(F.coalesce(item["later"], digest), path).alias("folded_root"))

    out = made.proofs(check).select("x.doc_id", "x.leaf", "subroot", F.lit(made.root).cast("string").alias("root"), "x.proof_sha256", "x.folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
