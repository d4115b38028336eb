"""Quality by weak supervision: rules vote, EM weighs them.

Each rule reads a few counts of a whole text and votes keep, reject or nothing.
A document's votes are a pattern out of at most 3^rules; Spark counts patterns,
so EM over the whole corpus runs on that small table. It estimates the share of
good documents and, for each rule, how often its keep and reject votes are
right (a reject is never a sign of quality, so good and bad can't change
places). The posterior that a document is good, not all rules passing, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_row
from .words import forget_encoders

_SYMBOLS = b"#*$%&|<>"
#: Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for on with as was by this are be from or an "
    "le la les de des du et que qui un une est pas dans pour sur avec par en "
    "der die das und den dem von zu mit ist nicht im ein eine auf sich für "
    "el los las del que y se por con una para es al lo como su".split()
)
_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function", "n_capital")


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8. Words are runs outside [\\x20\\x09-\\x0D]."""
    words = text.split()
    n = len(words)
    points = len(text) if text.isascii() else len(text.decode())
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
        v = len(seen)
        if v < n:
            pairs = ids[:-1] * v + ids[1:]
            _, pairs = np.unique(pairs, return_inverse=True)
            _, inverse, times = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            hit = np.zeros(n, dtype=bool)
            for k in range(3):
                hit[k : n - 2 + k] |= again
            repeat = int(hit.sum())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    function = sum(w in _FUNCTION for w in map(bytes.lower, words))
    capital = sum(map(bytes.isupper, words))
    return n, points - spaces, symbols, len(lines) - len(set(lines)), repeat, len(lines), function, capital


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in batches:
        texts = batch["text"].cast(pa.large_binary()).to_pylist()
        rows = [text_counts(t or b"") for t in texts]
        cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(COUNTS))]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *cols], [*kept, *COUNTS])


def count_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and COUNTS of every row; null and empty texts count
    0 throughout."""
    fields = ", ".join([*(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep), *(f"{c} long" for c in COUNTS)])
    return docs.select(*keep, "text").mapInArrow(_counted, fields)


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 keep, -1 reject, 0 abstain."""

    def rule(keep: Column, reject: Column) -> Column:
        return F.when(reject, -1).when(keep, 1).otherwise(0)

    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c, of=n: F.col(c) / of
    return {
        "length": rule(F.col("n_words") >= 80, F.col("n_words") < 20),
        "symbols": rule(share("n_symbols", chars) < 0.01, share("n_symbols", chars) > 0.08),
        "lines": rule(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "repeats": rule(share("n_repeat_words") < 0.15, share("n_repeat_words") > 0.45),
        "word_size": rule(F.col("word_chars").between(n * 3, n * 9), ~F.col("word_chars").between(n * 2, n * 14)),
        "function": rule(share("n_function") > 0.12, share("n_function") < 0.03),
        "capitals": rule(share("n_capital") < 0.05, share("n_capital") > 0.4),
    }


def fit(patterns: list[tuple[int, ...]], weights: list[float], rounds: int = 300) -> dict[tuple[int, ...], float]:
    """Posterior quality of each vote pattern, by EM.

    The start takes a document for good unless two rules reject it. For each
    rule EM estimates how often a vote on a good document is keep and how often
    a vote on a bad one is reject; an abstention says nothing.
    """
    if not patterns:
        return {}
    v, w = np.array(patterns), np.array(weights, dtype=float)
    keep, reject = (v > 0).astype(float), (v < 0).astype(float)
    good = np.array([0.95, 0.6, 0.1])[np.minimum(reject.sum(axis=1), 2).astype(int)]
    for _ in range(rounds):
        bad = 1 - good
        share = np.clip((w @ good + 2) / (w.sum() + 3), 0.5, 0.98)
        on_good = ((w * good) @ keep + 9) / ((w * good) @ (keep + reject) + 10)
        on_bad = ((w * bad) @ reject + 4) / ((w * bad) @ (keep + reject) + 8)
        on_bad = np.maximum(on_bad, 1 - on_good + 1e-3)  # a reject is never a sign of good
        score = np.log(share / (1 - share)) + keep @ np.log(on_good / (1 - on_bad)) + reject @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


def judged(counted: DataFrame, least: float, alike: DataFrame | None = None) -> DataFrame:
    """Rows with COUNTS, and what the rules make of them all together; ``alike``
    gives the same counts where ``counted`` has columns that voting doesn't need."""
    rules = votes()
    voted = counted.withColumns(rules)
    table = (counted if alike is None else alike).select(*(v.alias(k) for k, v in rules.items())).groupBy(*rules).count().collect()  # at most 3 ** len(rules) rows
    known = fit([tuple(r[k] for k in rules) for r in table], [r["count"] for r in table])
    fields = ", ".join(f"{k} int" for k in rules) + ", quality double"
    posterior = counted.sparkSession.createDataFrame([(*k, q) for k, q in known.items()], fields)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        voted.join(F.broadcast(posterior), list(rules))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("quality") >= least))
        .drop(*rules)
    )


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and COUNTS of every row, the posterior ``quality`` that its votes
    give, ``base_failed`` and ``kept``.

    base_failed: under 50 words, or over half of the words in 3-word windows
    that come twice or more. Others are kept from a posterior of ``least``. An
    empty table gives no rows; null and repeated ids are kept as rows; other
    columns are ignored.
    """
    return judged(stash(count_texts(docs, ["doc_id"]), "counts"), least)


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all their columns unchanged.

    Texts are counted twice, for the votes and to choose rows, so that no copy
    of the whole rows has to be kept in between.
    """
    whole = docs.select("text", whole_row(docs).alias("_whole"))
    return judged(count_texts(whole, ["_whole"]), least, count_texts(docs, [])).where("kept").select("_whole.*")
