"""The metric that a label names, by the aliases of all metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_label, normal_score
from .phrases import phrase_offsets

#: Fixed value: the least share of an alias's words that a label must have.
LEAST_SHARE = 0.6


def _words(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(label, " "), lambda w: w != ""))


def candidates(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs (label, alias) of distinct normal forms, of which no other can match.

    Aliases inside a label are found by the automaton of ``phrases``; a label
    inside an alias is one of the alias's parts, of which there is a bounded
    number; words are found by prefix filtering, as a label with enough of an
    alias's words has one of its few rarest.
    """
    label, alias = labels.select("label").distinct(), aliases.select("alias").distinct()
    in_label = phrase_offsets(label, "label", "label", alias, "alias")
    in_alias = alias.select("alias", F.explode(_parts(F.col("alias"))).alias("label")).join(label, "label")
    some = F.size("words") - F.ceil(F.size("words") * LEAST_SHARE - 1e-9).cast("int") + 1
    each = alias.select("alias", F.explode(_words(F.col("alias"))).alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word")
    prefix = ranked.groupBy("alias").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words")).withColumn("words", F.col("words.word"))
    rare = prefix.select("alias", F.explode(F.slice("words", F.lit(1), some)).alias("word"))
    shared = label.select("label", F.explode(_words(F.col("label"))).alias("word")).join(rare, "word")
    return in_label.select("label", "alias").union(in_alias.select("label", "alias")).union(shared.select("label", "alias")).distinct()


def _parts(text: Column) -> Column:
    """All parts of a text that isn't empty."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(1), n)
    ends = lambda a: F.sequence(F.lit(1), n - a + 1)
    return F.array_distinct(F.flatten(F.transform(starts, lambda a: F.transform(ends(a), lambda k: F.substring(text, a, k)))))


def best_metric(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, metric, alias, score) of each distinct label that an alias matches:
    equal 1, one holds the other 0.85, else the share of the alias's words in
    the label, 0.6 at least. The best score counts, ties by ``rank``.

    ``aliases`` has (metric, alias, rank); aliases of over 80 characters are
    refused, so that all parts of them can be listed. Labels without a letter or
    digit match nothing.
    """
    if aliases.where(F.char_length("alias") > 80).limit(1).count():
        raise ValueError("an alias of over 80 characters")
    raw = labels.select("label").where("label is not null").distinct().withColumn("_label", normal_label(F.col("label"))).where("_label != ''")
    known = aliases.withColumn("_alias", normal_label(F.col("alias"))).where("_alias != ''")
    pairs = candidates(raw.select(F.col("_label").alias("label")), known.select(F.col("_alias").alias("alias")))
    scored = pairs.withColumn("score", normal_score(F.col("label"), F.col("alias"))).where(F.col("score") >= LEAST_SHARE)
    scored = scored.select(F.col("label").alias("_label"), F.col("alias").alias("_alias"), "score").join(known, "_alias")
    best = scored.groupBy("_label").agg(F.min_by(F.struct("metric", "alias", "score"), F.struct((-F.col("score")).alias("down"), "rank")).alias("b"))
    return raw.join(best, "_label").select("label", "b.metric", "b.alias", "b.score")
