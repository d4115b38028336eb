"""Extraction: gates, windows, table values, routing and precedence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonfix import mended_json
from ..functions.periods import covered_months
from ..functions.text import first_position, has_any, parse_hashrate, parse_number
from .filters import ladder

#: Trust in a value below which it goes to review; window sizes.
ACCEPT, MONTHLY_BUDGET, QUARTERLY_BUDGET = 0.75, 8_000, 24_000


def gate(docs: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Documents that hold a phrase; without phrases none passes."""
    return docs.where(has_any(F.col(text), phrases))


def sliding_windows(docs: DataFrame, key: str, text: str, budget: int = MONTHLY_BUDGET) -> DataFrame:
    """Up to three windows of ``budget`` characters: the start, one that begins a
    quarter before the first ends (if the text is longer than the first), and
    what follows that. Null and empty texts give none."""
    n = F.char_length(text)
    window = lambda k, at: F.struct(F.lit(k).alias("window"), F.substring(text, at + 1, budget).alias("text"))
    second = budget - budget // 4
    places = ((0, 0, 0), (1, second, budget), (2, second + budget, second + budget))  # window, start, characters that it takes more than
    windows = F.filter(F.array(*(F.when(n > more, window(k, at)) for k, at, more in places)), lambda w: w.isNotNull())
    return docs.select(key, F.explode(windows).alias("w")).select(key, "w.*")


def confidence(weight: Column, distance: Column, value: Column, lo: Column, hi: Column) -> Column:
    """weight x decay over 500 characters x range, clamped to 0 to 1."""
    near = F.greatest(F.lit(0.0), F.lit(1.0) - distance / 500.0)
    fits = F.coalesce(value.between(lo, hi), F.lit(True)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight * near * fits))


def grain_fits(result: Column, expected: Column) -> Column:
    """Monthly rejects quarterly and annual, quarterly rejects annual."""
    bad = ((expected == "monthly") & result.isin("quarterly", "annual")) | ((expected == "quarterly") & (result == "annual"))
    return ~F.coalesce(bad, F.lit(False))


def route(protected: Column, no_data: Column, fits: Column, outlier: Column, trust: Column, accept: float = ACCEPT) -> Column:
    return ladder(
        [
            ("skip_protected", protected),
            ("skip_no_data", no_data),
            ("review_temporal", ~fits),
            ("review_outlier", outlier),
            ("accept", trust >= accept),
        ],
        "review_low_confidence",
    )


def table_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, label, value) of pipe rows with two cells or more: the first
    cell that isn't empty, and the first such cell after it."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").contains("|"))
    filled = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return lines.select(key, "line_no", F.get(filled, F.lit(0)).alias("label"), F.get(filled, F.lit(1)).alias("value")).where("value is not null")


def table_values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, label, value) of pipe rows: the first cell, and the number
    in the first later one that holds one, however many cells there are."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").contains("|"))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    numbers = F.filter(F.transform(F.slice(cells, F.lit(2), F.size(cells)), parse_number), lambda x: x.isNotNull())
    return lines.select(key, "line_no", F.get(cells, F.lit(0)).alias("label"), F.get(numbers, F.lit(0)).alias("value")).where("value is not null")


def metric_values(cells: DataFrame, aliases: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``table_cells`` whose label is a metric's, with its score and the
    number in the value. Of hash rates the value may lack the unit; it is then
    that of ``units``."""
    from .labels import best_metric

    found = cells.join(best_metric(cells.select("label"), aliases).select("label", "metric", "score"), "label")
    rate = F.coalesce(parse_hashrate(F.col("value")), parse_hashrate(F.concat("value", F.lit(" EH/s"))))
    is_rate = F.col("metric").isin([m for m, u in (units or {}).items() if u == "EH/s"])
    return found.withColumn("number", F.when(is_rate, rate).otherwise(parse_number(F.col("value")))).where("number is not null")


def parse_responses(rows: DataFrame, key: str, raw: str, ranges: DataFrame, default: float = 0.5) -> DataFrame:
    """(key, metric, value, confidence) of JSON answers wrapped in any text:
    numbers in the metric's range, confidence clamped. Broken JSON is mended."""
    body = mended_json(F.col(raw))
    parsed = F.from_json(body, "map<string, struct<value: string, confidence: string>>")
    flat = rows.select(key, F.explode(parsed).alias("metric", "r"))
    flat = flat.select(key, "metric", F.col("r.value").try_cast("double").alias("value"), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(default)).alias("c"))
    joined = flat.where("value is not null").join(ranges, "metric")
    return joined.where(F.col("value").between(F.col("lo"), F.col("hi"))).select(key, "metric", "value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")).alias("confidence"))


def extract(docs: DataFrame, extractor: Callable[[str], list[tuple[str, float, float]]], key: str, text: str) -> DataFrame:
    """Plug-in point: ``extractor(text)`` gives (metric, value, confidence) and
    runs on Arrow batches; a model server would be called from here."""

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(k, *x) for k, t in zip(pdf[key], pdf[text], strict=True) for x in extractor(t or "")]
            yield pd.DataFrame(rows, columns=[key, "metric", "value", "confidence"])

    return docs.select(key, text).mapInPandas(work, f"{key} {dict(docs.dtypes)[key]}, metric string, value double, confidence double")


def review_precedence(items: DataFrame, reports: DataFrame, monthly: DataFrame) -> DataFrame:
    """Quarterly review items of monthly reporters: deferred while a month's
    report is pending, suppressed once all months have the metric, else active.

    ``reports`` (entity, month, pending), ``monthly`` (entity, metric, month).
    """
    months = items.select("id", "entity", "metric", F.explode(covered_months(F.col("period"))).alias("month"))
    pending = months.join(reports.where("pending").select("entity", "month").distinct(), ["entity", "month"]).groupBy("id").agg(F.count("*").alias("pending"))
    covered = months.join(monthly.select("entity", "metric", "month").distinct(), ["entity", "metric", "month"]).groupBy("id").agg(F.count("*").alias("covered"))
    n = F.size(covered_months(F.col("period")))
    state = ladder([("deferred", F.coalesce("pending", F.lit(0)) > 0), ("suppressed", F.coalesce("covered", F.lit(0)) == n)], "active")
    return items.join(pending, "id", "left").join(covered, "id", "left").withColumn("precedence", state).drop("pending", "covered")


#: Headers of the section to read, the surest first; phrases that
#: come with figures; the least length of a section that is not a line of the
#: table of contents; characters before a header, and before a phrase.
SECTION_HEADERS = (r"(?i)\bitem\s+7[.\s]", r"(?i)\bitem\s+2[.\s]", r"(?i)management['\u2019]?s\s+discussion")
DATA_PHRASES = (
    "bitcoin mined", "btc mined", "bitcoin produced", "btc produced", "bitcoin we mined", "bitcoin production",
    "hash rate", "hashrate", "exahash", "bitcoin holdings", "btc holdings", "total bitcoin",
)
LEAST_SECTION, BEFORE_HEADER, BEFORE_PHRASE = 300, 200, 500


def _section_start(text: Column, header: str) -> Column:
    """0-based place of the first match whose section is long enough, or null.

    A section ends at the next ``Item n`` that starts ten characters or more
    after its header does.
    """
    parts = F.split(text, f"(?={header})", -1)
    step = lambda s, p: F.struct((s["at"] + F.char_length(p)).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step)["starts"]
    rest = lambda at: F.substring(text, at + 11, F.lit(1 << 30))
    length = lambda at: F.coalesce(first_position(rest(at), r"(?i)\bitem\s+\d"), F.char_length(rest(at)))
    headed = F.filter(starts, lambda at: (at > 0) | text.rlike(f"^(?:{header})"))
    return F.get(F.filter(headed, lambda at: length(at) >= LEAST_SECTION), F.lit(0))


def quarterly_window(docs: DataFrame, key: str, text: str, headers: tuple[str, ...] = SECTION_HEADERS, phrases: tuple[str, ...] = DATA_PHRASES, budget: int = QUARTERLY_BUDGET) -> DataFrame:
    """(key, start, strategy, text): where to read a long filing.

    ``mda_header``: a little before the first header of the surest kind with a
    section of its own, ``keyword_seek``: before the first phrase, ``start``:
    the beginning. Null texts are empty.
    """
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    header = F.coalesce(*(_section_start(F.col("text"), h) for h in headers))
    low = F.lower("text")
    phrase = F.least(*(F.nullif(F.locate(p, low), F.lit(0)) for p in phrases)) - 1
    placed = rows.select("*", header.alias("header"), phrase.alias("phrase"))
    start = F.greatest(F.lit(0), F.coalesce(F.col("header") - BEFORE_HEADER, F.col("phrase") - BEFORE_PHRASE, F.lit(0)))
    strategy = F.when(F.col("header").isNotNull(), "mda_header").when(F.col("phrase").isNotNull(), "keyword_seek").otherwise("start")
    return placed.select(key, start.alias("start"), strategy.alias("strategy"), F.substring("text", start + 1, F.lit(budget)).alias("text"))


def broad_values(rows: DataFrame, key: str, raw: str, synonyms: DataFrame, default_category: str = "other") -> DataFrame:
    """(key, metric, value, category) of a JSON list of all numbers found in a
    document: names become canonical by ``synonyms`` (name, metric, category),
    unknown ones stay; the first of each metric counts."""
    item = "struct<name: string, value: string>"
    flat = rows.select(key, F.posexplode(F.from_json(raw, f"array<{item}>")).alias("n", "i"))
    named = flat.select(key, "n", F.lower(F.trim("i.name")).alias("name"), parse_number(F.col("i.value")).alias("value")).where("value is not null")
    joined = named.join(synonyms, "name", "left").withColumn("metric", F.coalesce("metric", "name"))
    first = joined.groupBy(key, "metric").agg(F.min_by(F.struct("value", "category"), "n").alias("f"))
    return first.select(key, "metric", "f.value", F.coalesce("f.category", F.lit(default_category)).alias("category"))
