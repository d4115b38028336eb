"""Texts, URLs, hashes and numbers as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides utm_*.
TRACKING = ("fbclid", "gclid", "ref", "source", "_hsenc", "_hsmi")
#: Units of hash rate in EH/s.
HASHRATE_UNITS = {"EH/S": 1.0, "PH/S": 1e-3, "TH/S": 1e-6, "GH/S": 1e-9, "EXAHASH": 1.0, "EXAHASHES": 1.0}
#: Phrases of pages that stop robots.
CHALLENGES = ("just a moment", "attention required", "verify you are human", "captcha", "access denied")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which ``value`` is computed once a row however often
    and in whatever lambda ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment, same path.

    Null and blank URLs give the empty string.
    """
    url = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), r"\?.*$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith("utm_"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.coalesce(F.when(url != "", F.concat(head, path, tail)), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def plain_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits; other characters vanish."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def parse_number(text: Column) -> Column:
    """First number, with thousands commas, as double; null without one."""
    found = F.regexp_extract(text, r"(-?[\d,]*\d[\d,]*(?:\.\d+)?)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def parse_percent(text: Column) -> Column:
    """The first ``x %`` as a ratio."""
    return F.regexp_extract(text, r"([\d.]+)\s*%", 1).try_cast("double") / 100


def parse_hashrate(text: Column) -> Column:
    """The first hash rate in EH/s."""
    pattern = r"(?i)([\d.]+)\s*(EH/s|PH/s|TH/s|GH/s|exahash(?:es)?)"
    table = F.create_map(*(F.lit(x) for p in HASHRATE_UNITS.items() for x in p))
    factor = F.try_element_at(table, F.upper(F.regexp_extract(text, pattern, 2)))
    return F.regexp_extract(text, pattern, 1).try_cast("double") * factor


def first_position(text: Column, pattern: str) -> Column:
    """0-based character position of a pattern's first match, null without one."""
    return F.when(text.rlike(pattern), F.char_length(F.element_at(F.split(text, pattern, 2), 1)))


def cut_at_sentinels(text: Column, patterns: tuple[str, ...], share: float) -> Column:
    """Text before the earliest first match of a pattern that stands at or after
    ``share`` of the text, without trailing white space. Null gives ''."""
    text = F.coalesce(text, F.lit(""))
    threshold = F.floor(F.char_length(text) * F.lit(share))
    late = [bound(first_position(text, p), lambda at: F.when(at >= threshold, at)) for p in patterns]
    cut = F.least(F.char_length(text), *late)
    return F.regexp_replace(F.substring(text, F.lit(1), cut.cast("int")), r"\s+$", "")


def strip_release_frame(text: Column, date_line: str, always: tuple[str, ...], late: tuple[str, ...], share: float = 0.4) -> Column:
    """Press-release text without navigation and boilerplate.

    Starts at the last non-empty line before the first date line (not among
    the first two lines, at most 7 lines back), ends before the first line
    that matches ``always`` or, past ``share`` of the lines, ``late``.
    """
    matches = lambda line, patterns: reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns))
    numbered = lambda lines: F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("s")))
    dated = lambda rows: F.get(F.filter(rows, lambda x: x["s"].rlike(date_line)), F.lit(0))["i"]

    def first(rows: Column, date_at: Column) -> Column:
        before = F.slice(rows, F.greatest(date_at - 7, F.lit(0)) + 1, F.least(date_at, F.lit(7)))
        above = F.try_element_at(F.filter(before, lambda x: x["s"] != ""), F.lit(-1))["i"]
        return F.when(date_at >= 2, F.coalesce(above, F.lit(0))).otherwise(0)

    def cut(lines: Column, rows: Column, start: Column, from_late: Column) -> Column:
        ends = F.filter(rows, lambda x: (x["i"] >= start) & (matches(x["s"], always) | ((x["i"] >= from_late) & matches(x["s"], late))))
        end = F.coalesce(F.get(ends, F.lit(0))["i"], F.size(lines))
        return F.trim(F.array_join(F.slice(lines, start + 1, end - start), "\n"))

    def frame(lines: Column, rows: Column, start: Column) -> Column:
        return bound(start + F.floor((F.size(lines) - start) * F.lit(share)).cast("int"), lambda at: cut(lines, rows, start, at))

    # Each step is bound: a line is looked at once in each, and not once for each other line.
    return bound(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda lines: bound(numbered(lines), lambda rows: bound(bound(dated(rows), lambda at: first(rows, at)), lambda start: frame(lines, rows, start))),
    )


def has_any(text: Column, phrases: list[str]) -> Column:
    """Whether a phrase occurs, ignoring case."""
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, (lower.contains(p.lower()) for p in phrases), F.lit(False))


def title_passes(title: Column, include: str, exclude: str) -> Column:
    return title.rlike(include) & ~title.rlike(exclude)


def parse_quality(text: Column, pages: Column) -> Column:
    """parse_failed, text_sparse or text_ok by characters per page."""
    per_page = F.char_length(F.coalesce(text, F.lit(""))) / F.greatest(pages, F.lit(1))
    return F.when(per_page < 50, "parse_failed").when(per_page < 200, "text_sparse").otherwise("text_ok")


def normal_label(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+", " "))


def label_score(cell: Column, alias: Column) -> Column:
    """1 if equal, 0.85 if one holds the other, else the share of the alias's
    words in the cell if at least 0.6, else 0."""
    return normal_score(normal_label(cell), normal_label(alias))


def normal_score(c: Column, a: Column) -> Column:
    """``label_score`` of labels that are in normal form already."""
    words = F.array_distinct(F.split(a, " "))
    share = F.size(F.array_intersect(F.split(c, " "), words)) / F.size(words)
    return (
        F.when(a == "", 0.0)
        .when(c == a, 1.0)
        .when(c.contains(a) | a.contains(c), 0.85)
        .when(share >= 0.6, share)
        .otherwise(0.0)
    )


def phrase_list(raw: Column) -> Column:
    """Distinct lower-case phrases of a comma or newline separated list."""
    parts = F.transform(F.split(raw, r"[,\n]+"), lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def bot_challenge(html: Column, status: Column) -> Column:
    return (status == 403) | has_any(html, list(CHALLENGES))


def metric_unit(metric: Column, units: dict[str, str]) -> Column:
    """Unit of a metric, empty if unknown."""
    table = F.create_map(*(F.lit(x) for p in units.items() for x in p))
    return F.coalesce(F.try_element_at(table, metric), F.lit(""))
