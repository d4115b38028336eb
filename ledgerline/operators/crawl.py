"""What a crawl brings in: artifacts, the gate before the store, notes of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, has_any, host
from .merge import first_wins

#: What pages say that aren't there, and the least words of one that is kept.
ERRORS = ("404 not found", "page not found", "access denied", "not found")
LEAST_WORDS = 50
#: Characters that one suggestion may add.
MOST_SUGGESTED = 2_000


def artifact_documents(artifacts: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, entity, url, text, status) of crawl artifacts, each a JSON list of
    documents: ``source_url``, else ``url``; the artifact's key where no ticker
    is named. What is no list is one row of status bad_format, null is missing."""
    item = "struct<ticker: string, source_url: string, url: string, raw_text: string>"
    parsed = F.when(F.trim(raw).startswith("["), F.from_json(raw, f"array<{item}>"))
    none = F.array(F.lit(None).cast(item))
    status = F.when(F.col(raw).isNull(), "missing").when(parsed.isNull(), "bad_format").otherwise("ok")
    rows = artifacts.select(key, status.alias("status"), F.explode(F.when(status == "ok", parsed).otherwise(none)).alias("d"))
    filled = lambda c: F.when(F.trim(c) != "", c)
    entity = F.when(F.col("status") == "ok", F.upper(F.coalesce(filled(F.col("d.ticker")), F.col(key).cast("string"))))
    return rows.select(key, entity.alias("entity"), F.coalesce(filled(F.col("d.source_url")), F.col("d.url")).alias("url"), F.col("d.raw_text").alias("text"), "status")


def gated(pages: DataFrame, known: DataFrame, order: str, errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """``pages`` (entity, url, text, ...) with ``verdict``: error_page, too few
    words (insufficient_content), a URL that came before (duplicate, the first
    by ``order`` among those that pass the first two rules) or that is ``known``
    (entity, url), else ingested. URLs are compared in canonical form."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    content = F.when(has_any(F.coalesce("text", F.lit("")), list(errors)), "error_page").when(words < LEAST_WORDS, "insufficient_content")
    rows = pages.withColumns({"_bad": content, "_url": canonical_url(F.col("url"))})
    first = rows.where("_bad is null").groupBy("entity", "_url").agg(F.min(order).alias("_first"))
    there = known.select("entity", canonical_url(F.col("url")).alias("_url")).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(first, ["entity", "_url"], "left").join(there, ["entity", "_url"], "left")
    verdict = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.coalesce("_known", F.lit(False)) | (F.col(order) != F.col("_first")), "duplicate").otherwise("ingested")
    return joined.select(*pages.columns, verdict.alias("verdict"))


def index_notes(docs: DataFrame) -> DataFrame:
    """(entity, host, docs, span): how many documents (entity, url, period) of
    each host an entity has, and from which period to which; ? without any."""
    span = F.when(F.min("period").isNull(), "?").when(F.min("period") == F.max("period"), F.min("period")).otherwise(F.concat(F.min("period"), F.lit("–"), F.max("period")))
    name = F.coalesce(F.nullif(host(F.col("url")), F.lit("")), F.lit("(unknown)"))
    return docs.groupBy("entity", name.alias("host")).agg(F.count("*").alias("docs"), span.alias("span"))


def appended(current: Column, suggestion: Column) -> Column:
    """A prompt or hint with a suggestion below it. Blank suggestions and those
    of over 2,000 characters change nothing."""
    text = F.trim(suggestion)
    good = (text != "") & (F.char_length(text) <= MOST_SUGGESTED)
    return F.when(good, F.trim(F.concat_ws("\n\n", F.nullif(current, F.lit("")), text))).otherwise(current)


def suggestions_applied(prompts: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """``prompts`` (key, prompt) after ``suggestions`` (key, text, seq), the last
    of each key; keys without a prompt get one."""
    last = first_wins(suggestions.select(key, "text", (-F.col("seq")).alias("seq")), [key]).select(key, F.col("text").alias("_text"))
    both = prompts.join(last, key, "full")
    return both.select(key, appended(F.coalesce("prompt", F.lit("")), F.coalesce("_text", F.lit(""))).alias("prompt"))
