"""What became of a document: the state of a cell's stages and its lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.merge import written
from .coverage import metric_cell_state

#: Ranks of sources, the best first; others come last.
SOURCE_RANK = {"ir_press_release": 3, "archive_html": 3, "archive_pdf": 3, "edgar_8k": 2}
#: Kinds of a trail in their order.
KINDS = ("document", "chunk", "value", "review", "decision", "fact")


def period_trace(cells: DataFrame, reports: DataFrame, manifest: DataFrame, metrics: DataFrame, values: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each (entity, month) of ``cells`` and each metric: what each
    stage made of it, the state of the month, and its own value and review.

    ``reports`` (id, entity, day, source_type, status, parse_quality, text): of a
    month's the best source counts, then the latest day and id. ``values`` and
    ``reviews`` (id, entity, month, metric, ...; reviews with agreement and
    state, only active pending ones) count if there is a report; of several the
    one with the smallest id is shown. ``keyword_gated``: extraction ran over a text and left
    neither values nor reviews.
    """
    keys = ["entity", "month"]
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in SOURCE_RANK.items() for x in p))[F.col("source_type")], F.lit(1))
    shown = F.struct("id", "status", "parse_quality", F.char_length(F.coalesce("text", F.lit(""))).alias("char_count"))
    report = reports.withColumn("month", F.trunc("day", "MM")).groupBy(*keys).agg(F.max_by(shown, F.struct(rank, "day", "id")).alias("report"))
    listed = manifest.select(*keys).distinct().withColumn("has_manifest", F.lit(True))
    of_metric = [*keys, "metric"]
    value = values.groupBy(*of_metric).agg(F.min_by("value", "id").alias("value"))
    review = reviews.where("status = 'PENDING' AND coalesce(precedence, 'active') = 'active'").groupBy(*of_metric).agg(F.min_by(F.struct("id", "agreement"), "id").alias("review"))
    grid = cells.select(*keys).distinct().join(report, keys, "left").join(listed, keys, "left").crossJoin(metrics.select("metric"))
    known = grid.join(value, of_metric, "left").join(review, of_metric, "left")
    known = known.withColumns({c: F.when(F.col("report").isNotNull(), F.col(c)) for c in ("value", "review")})
    of_month = known.groupBy(*keys).agg(
        F.max(F.col("value").isNotNull()).alias("has_value"),
        F.coalesce(F.max(F.col("review").isNotNull() & ~F.coalesce(F.col("review.agreement") == "LLM_EMPTY", F.lit(False))), F.lit(False)).alias("has_review"),
        F.coalesce(F.max(F.col("review.agreement") == "LLM_EMPTY"), F.lit(False)).alias("has_empty"),
    )
    rows = known.join(of_month, keys)
    done, text = F.coalesce(F.col("report.status") == "done", F.lit(False)), F.coalesce(F.col("report.char_count"), F.lit(0))
    none = ~F.col("has_value") & ~F.col("has_review") & ~F.col("has_empty")
    no = F.lit(False)
    flags = {
        "analyst_gap": no, "data": F.col("has_value"), "quarterly": no, "review": F.col("has_review"), "llm_empty": F.col("has_empty"),
        "parse_error": F.coalesce(F.col("report.parse_quality") == "parse_failed", no), "extract_error": done & ~F.col("has_value"), "scraper_error": no,
    }
    return rows.select(
        *of_metric,
        F.coalesce("has_manifest", no).alias("has_manifest"),
        text.alias("char_count"),
        "report.parse_quality",
        F.col("report.status").alias("extraction_status"),
        (done & (text > 0) & none).alias("keyword_gated"),
        metric_cell_state(flags).alias("cell_state"),
        "value",
        F.col("review.id").alias("review_id"),
    )


def trails(cells: DataFrame, links: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(cell columns, kind, id): every item that a cell's items lead to, up and down.

    ``cells`` has (kind, id) and any columns that name the cell; ``links``
    (kind, id, to_kind, to_id) lead from an earlier kind to a later one. So one
    way is done kind by kind: when it is a kind's turn all its items are known,
    and they meet the links of that kind alone, on id, once. Kinds without items
    are passed over.
    """
    name = [c for c in cells.columns if c not in ("kind", "id")]
    cells = written(cells, "cells")
    there = lambda rows: {r[0] for r in rows.select("kind").distinct().collect()}
    start = (cells, there(cells))
    down = links.select("kind", "id", F.col("to_kind").alias("_kind"), F.col("to_id").alias("_id"))
    up = links.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), F.col("kind").alias("_kind"), F.col("id").alias("_id"))
    found = [cells]
    for way, order in ((down, kinds), (up, kinds[::-1])):
        reached = [start]
        for kind in order[:-1]:
            parts = [rows.where(F.col("kind") == kind).select(*name, "id") for rows, has in reached if kind in has]
            if not parts:
                continue
            items = reduce(DataFrame.unionByName, parts).repartition("id").distinct()
            step = items.join(way.where(F.col("kind") == kind).select("id", "_kind", "_id"), "id")
            step = written(step.select(*name, F.col("_kind").alias("kind"), F.col("_id").alias("id")), "trail")
            if has := there(step):
                reached.append((step, has))
                found.append(step)
    # By cell, which is what rows are grouped by next: so they are dealt once.
    every = reduce(DataFrame.unionByName, found)
    return (every.repartition(*name) if name else every).distinct()


def trail_texts(rows: DataFrame, name: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One ordered trail a cell: ``kind:id > kind:id > ...`` by kind, then id."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), "id", "kind")))
    said = F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["id"].cast("string")))
    return rows.groupBy(*name).agg(F.array_join(said, " > ").alias("trail"))


def stage_counts(rows: DataFrame, name: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """How many items of each kind a cell's trail has."""
    return rows.groupBy(*name).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
