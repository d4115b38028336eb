"""Templates of table lines and n-grams of prose lines, by frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.merge import written

#: How many of each kind a report lists, and how often they come at least.
MOST = {"table": 10, "prose": 15}
LEAST = 2
#: Places of the count sketch, and how many of the fullest are looked into to learn
#: how often the last item of the report comes.
WIDTH, FIRST = 1 << 18, 128

_TRIM = r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def lines_of(text: Column) -> Column:
    """Non-empty lines without the white space around them; null gives none."""
    cut = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, f"(?U){_TRIM}", "")), lambda x: x != "")


def is_table_line(line: Column) -> Column:
    """Two pipes or more, or a number after a word and a wide gap.

    Of the word only the last character before the gap can decide, as the gap
    itself gives the others; so three blanks, two of them part of the "word".
    """
    pipes = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
    return (pipes >= 2) | line.rlike(r"(?U)[\w\s]{3}\s{3}[\d,]")


def template(line: Column) -> Column:
    """Outer pipes and white space off, numbers as X, single spaces."""
    bare = F.regexp_replace(line, r"(?U)^\|+\s*|\s*\|+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b[\d,]+\b", "X"), " {2,}", " "))


def tokens(line: Column) -> Column:
    """Words of a-z and apostrophes in lower case, numbers as X."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), r"(?U)\b[\d,]+\b", "X"), F.lit("[a-z'X]+"), F.lit(0))


def prose_ngrams(docs: DataFrame, text: str, sizes: tuple[int, ...] = (3, 4), name: str = "template") -> DataFrame:
    """A row for each n-gram of a line that is no table line; none runs over a line end."""
    rows = docs.select(F.explode(lines_of(F.col(text))).alias("line")).where(~is_table_line(F.col("line"))).select(tokens(F.col("line")).alias("words"))
    rows = rows.where(F.size("words") >= min(sizes))
    for n in sizes:
        rows = NGram(n=n, inputCol="words", outputCol=f"_{n}").transform(rows)
    return rows.select(F.explode(F.concat(*(f"_{n}" for n in sizes))).alias(name))


def table_templates(docs: DataFrame, text: str, name: str = "template") -> DataFrame:
    """A row for each table line, as its template."""
    lines = docs.select(F.explode(lines_of(F.col(text))).alias("line")).where(is_table_line(F.col("line")))
    return lines.select(template(F.col("line")).alias(name))


def frequent(items: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows that come at least ``least`` times, with their number ``n``."""
    return items.groupBy(*items.columns).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def report(docs: DataFrame, text: str, most: dict[str, int] | None = None, least: int = LEAST) -> DataFrame:
    """The most frequent (kind, template, frequency) of the texts: table lines
    and n-grams of 3 and 4 words of prose lines, numbers as X.

    Items are first counted by hash in a sketch of ``WIDTH`` places for each kind,
    which tasks add up before the shuffle: a place counts at least what any of
    its items does. Items of the fullest places are then counted exactly, and
    the last of the report among them is a bound; in the end only items whose
    place reaches it are counted as strings. So what is shuffled is bounded for
    each task, and the result is exact. Ties go to the lesser template. Null
    texts have no lines.
    """
    most = most or MOST
    kinds = {"table": table_templates(docs, text), "prose": prose_ngrams(docs, text)}
    items = reduce(DataFrame.unionAll, (v.select(F.lit(k).alias("kind"), "template") for k, v in kinds.items()))
    placed = items.withColumn("_place", F.pmod(F.xxhash64("template"), F.lit(WIDTH)).cast("int"))
    sketch = written(placed.groupBy("kind", "_place").agg(F.count("*").alias("n")), "sketch")
    out = []
    for kind, k in most.items():
        mine, spots = placed.where(F.col("kind") == kind), sketch.where(F.col("kind") == kind)
        top = _counted(_within(mine, spots.orderBy(F.desc("n"), "_place").limit(FIRST)), least).orderBy(F.desc("frequency")).limit(k).collect()
        bound = top[-1]["frequency"] if len(top) == k else least
        best = _counted(_within(mine, spots.where(F.col("n") >= bound)), least)
        out.append(best.orderBy(F.desc("frequency"), "template").limit(k))
    return reduce(DataFrame.unionAll, out)


def _within(placed: DataFrame, spots: DataFrame) -> DataFrame:
    """Items in one of these places of the sketch, of which there are at most WIDTH."""
    return placed.join(F.broadcast(spots.select("_place")), "_place", "left_semi")


def _counted(items: DataFrame, least: int) -> DataFrame:
    return items.groupBy("kind", "template").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
