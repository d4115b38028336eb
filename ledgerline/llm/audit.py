"""Filter interaction audit: what each filter removes, in every order of them.

Every document is reduced to a mask of the filters that it fails, and the corpus
to its mask cells: how many documents of a part have which mask. A recursive
query then extends prefixes of filters by each letter that is not yet in them,
carries the bits that were applied, and says at every level what that step does
with each mask. The recursion runs over masks and not over documents or parts,
so its size depends on the number of filters alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def default_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words (A), few distinct ones (B), many
    capitals (C), symbols (D)."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters=default_filters) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by what they fail.

    The first bits are those of ``filters``, the last is that of copies: texts
    that a row of smaller doc_id has. Equal texts fail the same other filters,
    so copies are counted by (digest, part) before they meet, and a text that a
    third of all rows have costs a row a task. Null texts are empty, null
    sources the part ''. Rows without doc_id come after all others; rows that
    share a doc_id are no copies of each other. A doc_id with several labels is
    good (toxic) if one of them says so; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    fails = filters(text)
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails.values())))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), mask.alias("mask"))
    told = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = rows.join(told, "doc_id", "left").na.fill(0, ["good", "toxic"])
    sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    once = rows.groupBy("doc_id", "digest", "part", "mask").agg(*sums)
    counts = ("n", "good", "toxic")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *counts))
    copies = once.groupBy("digest", "part", "mask").agg(first.alias("first"), *(F.sum(c).alias(c) for c in counts))
    named = F.struct("first.unnamed", "first.doc_id")
    copies = copies.withColumn("holds", named.eqNullSafe(F.min(named).over(Window.partitionBy("digest"))))
    kept = {c: F.when(F.col("holds"), F.col(f"first.{c}")).otherwise(0) for c in counts}
    both = F.array(
        F.struct("mask", *(kept[c].alias(c) for c in counts)),
        F.struct(F.col("mask").bitwiseOR(1 << len(fails)).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in counts)),
    )
    return copies.select("part", F.inline(both)).where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def walk(spark, letters: str) -> DataFrame:
    """A row for each prefix of distinct letters and each mask: whether that
    step keeps, removes or no longer sees a document of the mask."""
    named = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    return spark.sql(
        f"""WITH RECURSIVE letters(letter, bit) AS (VALUES {named}),
        walk(mask, prefix, applied, bit, step) AS (
            SELECT CAST(id AS INT), '', 0, 0, 0 FROM range({1 << len(letters)})
            UNION ALL
            SELECT mask, concat(prefix, letters.letter), applied | letters.bit, letters.bit, step + 1
            FROM walk JOIN letters ON applied & letters.bit = 0)
        SELECT mask, prefix, step, mask & applied = 0 AS stays, mask & bit <> 0 AND mask & (applied ^ bit) = 0 AS goes,
            mask & bit <> 0 AND mask & (applied ^ bit) <> 0 AS gone, mask = bit AS alone
        FROM walk WHERE step > 0"""
    )


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each step of each order of the filters does, by part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (what the step's filter removes, summed over
    all orders). A part has a row for every order and step, zeros included; no
    documents give no rows. Orders are as many as the factorial of the letters.
    """
    steps = walk(cells.sparkSession, letters)
    count = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    told = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step").agg(
        count("stays").alias("kept"), count("goes").alias("removed"), count("gone").alias("redundant"), count("alone").alias("unique_fails"),
        count("goes", "good").alias("good_lost"), count("goes", "toxic").alias("toxic_lost"),
    )
    ways = F.element_at(F.array(*(F.lit(math.factorial(len(letters) - s)) for s in range(1, len(letters) + 1))), F.col("step"))
    same = Window.partitionBy("part", F.right("prefix", F.lit(1)))
    told = told.withColumn("shapley", F.sum(F.col("removed") * ways).over(same))
    orders = steps.where(f"step = {len(letters)} AND mask = 0").select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    return told.join(F.broadcast(orders), ["prefix", "step"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
