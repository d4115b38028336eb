"""What an HTML page says of itself, by patterns: title and date."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import MONTHS, month_number


def _first(html: Column, *patterns: str) -> Column:
    """The first non-empty group 1 of the patterns, white space made single."""
    hits = (F.trim(F.regexp_replace(F.regexp_extract(html, p, 1), r"\s+", " ")) for p in patterns)
    return F.coalesce(*(F.when(h != "", h) for h in hits))


def _shortened(title: Column, least: int, most: int) -> Column:
    """Single spaces, no dashes or bars at the ends, null if shorter than
    ``least``, cut with dots if longer than ``most``."""
    clean = F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"^[ |\u2013\u2014-]+|[ |\u2013\u2014-]+$", "")
    cut = F.concat(F.rtrim(F.substring(clean, 1, most - 3)), F.lit("..."))
    return F.when(F.char_length(clean) > most, cut).when(F.char_length(clean) >= least, clean)


def document_title(html: Column, text: Column, least: int = 8, most: int = 220) -> Column:
    """Title of a page: og or twitter title, <title>, <h1>, else the first
    telling one of the text's 20 first lines. Null without one."""
    # Names of tags and attributes, and lines that are no titles.
    tag = lambda name: rf"(?is)<meta(?=[^>]*?\b(?:property|name)\s*=\s*[\"']{name}[\"'])[^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    found = [_first(html, tag("og:title")), _first(html, tag("twitter:title")), _first(html, r"(?is)<title[^>]*>(.*?)</title>")]
    found.append(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"<[^>]*>", " "))
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    other = rf"(?i)^(?:source:|email|distributed by .*|(?:{names})\s+\d{{1,2}},?\s+\d{{4}}.*)$"
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, 20), lambda x: _shortened(x, least, most))
    lines = F.filter(lines, lambda x: x.isNotNull() & ~x.rlike(other))
    return F.coalesce(*(_shortened(c, least, most) for c in found), F.get(lines, F.lit(0)))


def published_date(html: Column) -> Column:
    """Date of publication: meta tags, a time element, else the first
    ``Month day, year`` of the page. Null without one."""
    iso = _first(
        html,
        r"(?is)<meta[^>]+(?:article:published_time|datePublished|pubdate|dc\.date|\"date\")[^>]+content=[\"'](\d{4}-\d{2}-\d{2})",
        r"(?is)<time[^>]+datetime=[\"'](\d{4}-\d{2}-\d{2})",
    )
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    spelt = rf"(?i)\b({names})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
    part = lambda g: F.regexp_extract(html, spelt, g)
    year, day = part(3).try_cast("int"), part(2).try_cast("int")
    written = F.concat_ws("-", year.cast("string"), F.lpad(month_number(part(1)).cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.coalesce(iso.try_cast("date"), F.when(html.rlike(spelt), written.try_cast("date")))


#: Tags whose contents aren't shown, and tags that break lines.
HIDDEN = ("script", "style", "noscript", "head")
BREAKS = "p|div|br|li|tr|h[1-6]|section|article|table"


def unescaped(text: Column) -> Column:
    """Character references, numeric or by one of the names of HTML 4 (the
    standard library's list) or ``apos``, as characters; others stay."""
    names = F.create_map(*(F.lit(x) for n, c in {**name2codepoint, "apos": 39}.items() for x in (n, chr(c))))
    pattern = r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    spelt = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def read(p: Column) -> Column:
        name = F.regexp_extract(p, pattern, 1)
        number = F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 9)).when(name.startswith("#"), F.conv(F.substring(name, 3, 9), 16, 10)).try_cast("int")
        char = F.when(name.startswith("#"), spelt(number)).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.regexp_replace(p, pattern, "")), F.concat(F.lit("&"), p))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")).otherwise(text)


def _shown(html: Column) -> Column:
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


def _single(text: Column) -> Column:
    """White space, the no-break space too, as single spaces and none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def plain_text(html: Column) -> Column:
    """What a page shows, a line for each block: a table row is one line with its
    cells parted by bars. Lines without anything but bars go; null is empty."""
    text = F.regexp_replace(_shown(html), r"(?i)</t[dh]\s*>\s*</tr", "</tr")
    text = F.regexp_replace(text, r"(?i)</t[dh]\s*>", " | ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n")
    text = unescaped(F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", ""))
    lines = F.transform(F.split(text, "\n"), _single)
    return F.array_join(F.filter(lines, lambda x: x.rlike(r"[^| ]")), "\n")


def page_title(html: Column) -> Column:
    """Text of <title>, null without one."""
    title = _single(unescaped(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    return F.when(title != "", title)


def page_links(html: Column) -> Column:
    """(href, label) of the links that a page shows, in order."""
    shown, anchor = _shown(html), r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
    whole = F.regexp_extract_all(shown, F.lit(anchor), F.lit(0))
    quoted, bare = r"(?is)\bhref\s*=\s*[\"']([^\"']*)", r"(?is)\bhref\s*=\s*([^\s\"'>]+)"

    def link(x: Column) -> Column:
        tag, label = F.regexp_extract(x, anchor, 1), F.regexp_extract(x, anchor, 2)
        target = F.when(tag.rlike(quoted), F.regexp_extract(tag, quoted, 1)).otherwise(F.regexp_extract(tag, bare, 1))
        return F.struct(unescaped(target).alias("href"), _single(unescaped(F.regexp_replace(label, r"<[^>]*>", ""))).alias("label"))

    return F.transform(whole, link)
