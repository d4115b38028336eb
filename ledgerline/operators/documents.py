"""Documents: sections, chunk packing, prompts, payloads, zero-extract items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_at_sentinels, strip_release_frame

#: Source types of press releases.
MONTHLY_SOURCES = ("archive_html", "archive_pdf", "ir_press_release", "wire_press_release")
#: The date line of a release, and lines that end it, wherever
#: they stand or only late in the text.
RELEASE_DATE = (
    r"(?i)^(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    r"\s+\d{1,2},?\s+\d{4}"
)
RELEASE_ENDS = (r"^Recent Announcements\s*$", r"^Investor Notice\s*$", r"^Source:\s+[A-Z]", r"(?i)^email\s*$", r"^©\s*\d{4}", r"(?i)^Distributed by\s+\w")
RELEASE_ENDS_LATE = (
    r"(?i)^Forward-Looking (?:Statements?|Information)\s*$",
    r"(?i)^Cautionary Statements?\s*$",
    r"^About [A-Z][A-Za-z]",
    r"(?i)^For more information,?\s+visit\s*$",
    r"(?i)^(?:Investor\s+Relations|Media)\s+Contact\b",
    r"(?i)^For\s+(?:investor|media)\s+(?:relations\s+)?(?:contact|inquiries|information)\b",
)
#: What ends a filing.
FILING_ENDS = (r"(?m)^\s*SIGNATURES?\s*$", r"Pursuant to the requirements of the Securities Exchange Act", r"(?m)^\s*EXHIBIT\s+INDEX\s*$")


def sections(docs: DataFrame, key: str, text: str, heading: str = r"(?m)^(?=Item\s+\d)", least: int = 300) -> DataFrame:
    """(key, section, body): the text cut before each heading; short bodies go."""
    parts = F.split(F.coalesce(text, F.lit("")), heading)
    rows = docs.select(key, F.posexplode(parts).alias("section", "body"))
    return rows.where(F.char_length("body") >= least)


def release_text(text: Column) -> Column:
    """A press release without the navigation above it and the boilerplate below."""
    return strip_release_frame(text, RELEASE_DATE, RELEASE_ENDS, RELEASE_ENDS_LATE)


def filing_text(text: Column) -> Column:
    """A filing without signatures and the index of exhibits."""
    return cut_at_sentinels(text, FILING_ENDS, 0.3)


def prepared_text(source_type: Column, text: Column) -> Column:
    """Text made ready by its source: releases, filings, others as they are."""
    monthly = source_type.isin(*MONTHLY_SOURCES)
    return F.when(monthly, release_text(text)).when(source_type.startswith("edgar_"), filing_text(text)).otherwise(F.coalesce(text, F.lit("")))


def parsed(docs: DataFrame, key: str, source_type: str, text: str) -> DataFrame:
    """(key, parser, section, body): annual and quarterly filings by section,
    all others as one release."""
    periodic = F.coalesce(F.col(source_type).isin("edgar_10k", "edgar_10q"), F.lit(False))
    filings = sections(docs.where(periodic), key, text).withColumn("parser", F.lit("filing"))
    releases = docs.where(~periodic).select(key, F.lit(0).alias("section"), release_text(F.col(text)).alias("body"), F.lit("release").alias("parser"))
    return filings.unionByName(releases).select(key, "parser", "section", "body")


def packed_chunks(chunks: DataFrame, key: str, order: str, keywords: list[str], budget: int) -> DataFrame:
    """Chunks of a document that fit its budget, most keyword hits first, with
    the ``used`` characters of each; the one at the border is cut short."""
    low = F.lower("text")
    hits = sum(((F.char_length("text") - F.char_length(F.replace(low, F.lit(k), F.lit("")))) / len(k) for k in keywords), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("hits"), order)
    before = F.coalesce(F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("hits", hits.cast("long")).withColumn("before", before).where(F.col("before") < budget)
    return rows.withColumn("used", F.least(F.char_length("text").cast("long"), budget - F.col("before"))).drop("before")


def chunk_windows(chunks: DataFrame, key: str, order: str, text: str, keywords: list[str], budget: int, most: int = 3) -> DataFrame:
    """(key, window, text): the chunks of a document in windows of at most
    ``budget`` characters, ``most`` windows, those with most keywords first.

    Chunks are taken by their keyword hits, ties by ``order``. A chunk that
    doesn't fit fills the window up and closes it; what is cut off it is not
    read again, unless the first window had no room left at all, then the chunk
    begins the next one. Chunks of a window are parted by blank lines, which
    count only when the window is cut to the budget. Null texts are empty.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(said)
    hits = sum(((F.char_length(low) - F.char_length(F.replace(low, F.lit(k), F.lit("")))) / len(k) for k in keywords), F.lit(0)).cast("long")
    listed = F.array_sort(F.collect_list(F.struct((-hits).alias("down"), F.col(order).alias("order"), said.alias("text"))))
    closed = lambda parts: F.substring(F.array_join(parts, "\n\n"), 1, budget)
    none = F.array().cast("array<string>")
    state = lambda windows, parts, used, first: F.struct(windows.alias("windows"), parts.alias("parts"), used.alias("used"), first.alias("first"))

    def step(s: Column, c: Column) -> Column:
        text, n = c["text"], F.char_length(c["text"])
        room = F.lit(budget) - s["used"]
        filled = F.when(room > 0, F.array_append(s["parts"], F.substring(text, F.lit(1), room))).otherwise(s["parts"])
        begun = F.array_append(s["windows"], closed(s["parts"]))
        alone = F.size(begun) < most
        return (
            F.when(~s["first"] & (F.size(s["windows"]) >= most), s)
            .when(n <= room, state(s["windows"], F.array_append(s["parts"], text), s["used"] + n, s["first"]))
            .when(~s["first"] | (room > 0), state(F.array_append(s["windows"], closed(filled)), none, F.lit(0), F.lit(False)))
            .when(alone & (n > budget), state(F.array_append(begun, F.substring(text, F.lit(1), F.lit(budget))), none, F.lit(0), F.lit(False)))
            .otherwise(state(begun, F.when(alone, F.array(text)).otherwise(none), F.when(alone, n).otherwise(0), F.lit(False)))
        )

    def finish(s: Column) -> Column:
        rest = s["first"] | ((F.size(s["parts"]) > 0) & (F.size(s["windows"]) < most))
        return F.when(rest, F.array_append(s["windows"], closed(s["parts"]))).otherwise(s["windows"])

    packed = chunks.groupBy(key).agg(listed.alias("_chunks"))
    windows = F.aggregate("_chunks", state(none, none, F.lit(0), F.lit(True)), step, finish)
    return packed.select(key, F.posexplode(windows).alias("window", "text"))


def prompts(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text per key: its non-empty blocks in order, blank lines between."""
    kept = blocks.where(F.coalesce(F.trim(text), F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return kept.groupBy(key).agg(F.array_join(F.transform(listed, lambda b: b[text]), "\n\n").alias("prompt"))


def instructions(*tiers: Column) -> Column:
    """The first tier that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(t) != "", t) for t in tiers), F.lit(""))


def zero_extracts(passed: DataFrame, metrics: DataFrame, extracted: DataFrame, cleared: DataFrame) -> DataFrame:
    """(doc, metric) items for gated documents from which nothing was extracted,
    without those that an analyst has cleared."""
    nothing = passed.join(extracted.select("doc").distinct(), "doc", "left_anti")
    return nothing.crossJoin(metrics).join(cleared, ["doc", "metric"], "left_anti")


def payload(docs: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Documents with a map of metric to value; empty without values."""
    maps = values.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    none = F.create_map().cast("map<string, double>")
    return docs.join(maps, key, "left").withColumn("metrics", F.coalesce("metrics", none))


def chronology(docs: DataFrame, group: str, tier: Column, day: str, key: str) -> DataFrame:
    """Sequence of extraction: source tier, date, id."""
    w = Window.partitionBy(group).orderBy(tier, day, key)
    return docs.withColumn("sequence", F.row_number().over(w))


def preferred(docs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One document per key, the first by ``order`` (a total order)."""
    rest = [c for c in docs.columns if c not in keys]
    return docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_d")).select(*keys, "_d.*")
