"""Merkle manifest of a dataset with an inclusion proof for every row.

Rows are leaves; within a source, every three consecutive nodes become their
hash, level by level, and the sources' roots are joined in the same way. The
nodes of a tree are cut into aligned blocks of 3^8, which are worked on in
parallel. A block is built by appending its nodes one after the other: an
open subtree holds the partial witnesses of the nodes below it, and when its
siblings are complete these witnesses get one more step. The roots of blocks
are then appended in the same manner, as nodes of the tree above, and what they
gain there completes the witnesses of all nodes below.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ARITY = 3
#: Levels of a block; it has at most ARITY ** LEVELS nodes.
LEVELS = 8


@dataclass
class Subtree:
    """A complete subtree: its digest and the witnesses of the nodes in it,
    each a list of (digests to the left, digests to the right) by level."""

    digest: str
    witnesses: list[list[tuple[str, str]]] = field(default_factory=list)


class OpenTree:
    """Append-only tree whose unfinished runs of siblings stay open."""

    def __init__(self) -> None:
        self.runs: list[list[Subtree]] = [[]]

    def append(self, sub: Subtree, level: int = 0) -> None:
        """Add a subtree next to those of its level; complete the run if it is the last."""
        while len(self.runs) <= level:
            self.runs.append([])
        self.runs[level].append(sub)
        if len(self.runs[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [s.digest for s in run]
        for i, sub in enumerate(run):
            step = ("".join(digests[:i]), "".join(digests[i + 1 :]))
            for witness in sub.witnesses:
                witness.append(step)
        self.append(Subtree(sha256("".join(digests).encode()).hexdigest(), [w for s in run for w in s.witnesses]), level + 1)

    def close(self, height: int) -> Subtree:
        """Complete what is open up to this height; the one subtree that is left."""
        for level in range(height):
            if level < len(self.runs) and self.runs[level]:
                self._complete(level)
        return self.runs[height][0]


def height(nodes: int) -> int:
    """Levels above so many nodes."""
    levels = 0
    while ARITY**levels < nodes:
        levels += 1
    return levels


def _block(levels: int, table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    size, tree, witnesses = table["size"][0].as_py(), OpenTree(), []
    for digest in table["digest"].to_pylist():
        witnesses.append([])
        tree.append(Subtree(digest, witnesses[-1:]))
    top = tree.close(min(levels, height(size))).digest
    sides = [pa.array([[step[k] for step in w] for w in witnesses], pa.list_(pa.string())) for k in (0, 1)]
    return table.append_column("root", pa.array([top] * len(table))).append_column("lefts", sides[0]).append_column("rights", sides[1])


def _appended(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, at, size, digest, ...) with root, lefts and rights within their block."""
    rows = nodes.withColumn("block", F.floor(F.col("at") / ARITY**levels))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.groupBy("tree", "block").applyInArrow(lambda nodes: _block(levels, nodes), f"{fields}, root string, lefts array<string>, rights array<string>")


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """With at (0, 1, ... within its tree in this order) and size (rows of its
    tree); and the size of the largest.

    Rows are range-partitioned, so a tree may span many tasks; what is summed
    over them is one count for each tree in each partition.
    """
    order = [F.col("tree"), *order]
    laid = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    runs = laid.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    runs = stash(runs, "runs")
    out = laid.join(runs, ["tree", "_part"]).withColumn("at", F.col("_place") + F.col("_shift"))
    return out.drop("_id", "_part", "_place", "_shift"), runs.agg(F.max("size")).first()[0] or 0


def _grown(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes in their blocks, the blocks' roots in theirs, and so on up to one root a tree."""
    floors = [stash(_appended(nodes, levels), "blocks")]
    while largest > ARITY**levels:
        largest = -(-largest // ARITY**levels)
        roots = floors[-1].where(F.col("at") % ARITY**levels == 0)
        size = F.ceil(F.col("size") / ARITY**levels).alias("size")
        floors.append(stash(_appended(roots.select("tree", F.col("block").alias("at"), size, F.col("root").alias("digest")), levels), "blocks"))
    return floors


def leaf(*values: Column) -> Column:
    """Hash of these values: `-` if null, else byte count, `:`, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)), 256)


def folded(digest: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), digest, lambda d, s: F.sha2(F.concat(s["a"], d, s["b"]), 256))


def manifest(rows: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """Witnesses of all rows (source, doc_id, leaf, ...) and the root of all.

    Returns the rows with subroot, lefts and rights: the digests beside the path
    from the leaf to the root, by level. Sources ascend by their bytes, null
    first and apart from ''; leaves of a source by doc_id (null first), and of
    one doc_id by leaf. Rows may repeat. Without rows the root is None. Names
    of further columns that clash: tree, at, size, digest, block, root.
    """
    tree = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree")
    nodes, largest = numbered(rows.select(tree, F.col("leaf").alias("digest"), *(c for c in rows.columns if c != "leaf")), [F.col("doc_id"), F.col("digest")])
    if not largest:
        empty = F.array().cast("array<string>")
        return rows.select("*", F.lit("").alias("subroot"), empty.alias("lefts"), empty.alias("rights")), None
    floors = _grown(nodes, largest, levels)
    tops = floors[-1].where("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("below"), F.col("root").alias("digest"))
    sources, largest = numbered(tops, [F.col("below")])
    forest = _grown(sources, largest, levels)
    root = forest[-1].where("at = 0").first()["root"]
    upper = _completed(forest).select(F.col("below").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "lefts", "rights")
    out = _completed(floors, upper)
    return out.select(*(F.col("digest").alias("leaf") if c == "leaf" else c for c in rows.columns), "subroot", "lefts", "rights"), root


def _completed(floors: list[DataFrame], upper: DataFrame | None = None) -> DataFrame:
    """The lowest floor with what its blocks' roots gain on all floors above."""
    for floor in reversed(floors):
        if upper is not None:
            above = upper.withColumnsRenamed({"lefts": "_lefts", "rights": "_rights"})
            floor = floor.join(above, ["tree", "block"]).withColumn("lefts", F.concat("lefts", "_lefts")).withColumn("rights", F.concat("rights", "_rights"))
        gained = [c for c in ("subroot",) if c in floor.columns]
        upper = floor.select("tree", F.col("at").alias("block"), *gained, "lefts", "rights")
        last = floor
    return last
