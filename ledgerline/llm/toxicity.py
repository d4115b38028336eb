"""A toxicity classifier with a counterfactual penalty.

A sparse logistic model over the words of a text and their prefixes. Spark
screens the features of a bounded sample of labelled rows, and the model is
fitted on the driver to the few that tell most about the label. Besides the log loss
it pays for every change of its score when an identity term of a labelled text
is swapped for another of the same kind, so that naming a group can't make a
text toxic. Scoring runs on every whole text with the few weights that are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_row
from .words import Pieces, PieceTable, distinct, forget_encoders, slices

#: Labelled rows that a model is fitted to at most (in the order of a hash of
#: the id), hashed features, and features that survive screening unless ``fit`` is
#: told another number: those whose share of toxic rows is furthest from the
#: average, by standard deviations.
SAMPLE, SPACE, SCREENED = 8_000, 1 << 20, 4096
PREFIXES = (4, 5, 6, 7)
#: Identity terms by kind, in English, German, French and Spanish; a swap takes the
#: next one of its kind. Terms that two languages share stand in one list only.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("mexican", "american", "chinese", "french", "german", "spanish", "turkish"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle", "heterosexuelle"),
    ("türken", "deutsche", "franzosen", "spanier", "amerikaner", "chinesen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres", "hétérosexuels"),
    ("turcs", "allemands", "français", "espagnols", "américains", "chinois"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales", "heterosexuales"),
    ("turcos", "alemanes", "franceses", "españoles", "americanos", "chinos"),
)
_SWAP = {a: group[(k + 1) % len(group)] for group in IDENTITY for k, a in enumerate(group)}
_SMALL = 4  # documents that a feature must be in


def word_features(word: str) -> list[int]:
    word = word.lower()
    if not word[:1].isalpha():
        return []
    grams = ["w" + word, *(str(k) + word[:k] for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(g.encode()) % SPACE for g in grams]


def text_features(words: set[str]) -> np.ndarray:
    return np.unique([f for w in words for f in word_features(w)]).astype(np.int32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in batches:
        for a, b in slices(batch["text"]):
            found = Pieces(batch["text"][a:b])
            offsets, strings = found.offsets, found.strings(np.arange(len(found)))
            own, swapped = [], []
            for i in range(b - a):
                words = set(strings[offsets[i] : offsets[i + 1]])
                own.append(text_features(words))
                other = {_SWAP.get(w, w) for w in words}
                swapped.append(text_features(other) if other != words else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], batch["toxic"][a:b], pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))],
                ["doc_id", "toxic", "features", "swapped"],
            )


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows, and how many toxic ones, have each feature."""
    rows, toxic = np.zeros((2, SPACE), dtype=np.int64)
    for batch in batches:
        flat = batch["features"].flatten().to_numpy(zero_copy_only=False)
        each = np.repeat(batch["toxic"].to_numpy(zero_copy_only=False), batch["features"].value_lengths().to_numpy(zero_copy_only=False))
        rows += np.bincount(flat, minlength=SPACE)
        toxic += np.bincount(flat[each > 0], minlength=SPACE)
    there = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (there.astype(np.int32), rows[there], toxic[there])], ["feature", "n", "toxic"])


def _matrix(lists: list, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each screened feature that is there."""
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    cols = column[np.concatenate(lists)] if lists else np.zeros(0, dtype=column.dtype)
    return rows[cols >= 0], cols[cols >= 0]


def fit_weights(toxic: np.ndarray, own: list, swapped: list, l1: float = 2e-4, fair: float = 1.0, steps: int = 400, screened: int = SCREENED) -> dict[int, float]:
    """Weights by feature, and the intercept under -1: accelerated proximal gradient."""
    n = len(toxic)
    if not n or not own or toxic.min() == toxic.max():
        rate = (float(toxic.sum()) + 0.5) / (n + 10) if n else 0.05
        return {-1: float(np.log(rate / (1 - rate)))}
    flat = np.concatenate(own)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in own])
    df, pos = np.bincount(flat, minlength=SPACE), np.bincount(flat, weights=toxic[rows], minlength=SPACE)
    rate = toxic.mean()
    lift = (pos - df * rate) / np.sqrt(df * rate * (1 - rate) + 1)
    best = np.argsort(-np.abs(lift), kind="stable")[:screened]
    best = best[df[best] >= _SMALL]
    column = np.full(SPACE, -1, dtype=np.int32)
    column[best] = np.arange(len(best))
    r, c = _matrix(own, column)
    pairs = [(i, x) for i, x in enumerate(swapped) if x is not None]
    pr, pc = _matrix([x for _, x in pairs], column)
    base = np.array([i for i, _ in pairs], dtype=np.int64)
    m = len(best)
    w, b = np.zeros(m), float(np.log(rate / (1 - rate)))
    v, vb, t = w.copy(), b, 1.0
    weight = np.where(toxic > 0, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    weight /= weight.sum()
    # a step that the curvature of the loss and of the penalty allow
    turned = max((len(np.setxor1d(own[i], x)) for i, x in pairs), default=0)
    rate_of_step = 4.0 / (1 + np.bincount(r, minlength=n).mean() * 0.25 + 4 * fair * turned * len(pairs) / n)
    for _ in range(steps):
        logit = np.bincount(r, weights=v[c], minlength=n) + vb
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        err = weight * (p - toxic)
        grad = np.bincount(c, weights=err[r], minlength=m)
        if len(base):
            other = np.bincount(pr, weights=v[pc], minlength=len(base)) + vb
            gap = fair * (logit[base] - other) / n
            full = np.zeros(n)
            full[base] = gap
            grad += np.bincount(c, weights=full[r], minlength=m) - np.bincount(pc, weights=gap[pr], minlength=m)
        new = v - rate_of_step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate_of_step * l1, 0)
        nb = vb - rate_of_step * err.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return {-1: b, **{int(f): float(x) for f, x in zip(best, w, strict=True) if x}}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, screened: int = SCREENED, fair: float = 1.0) -> dict[int, float]:
    """Fit to at most ``sample`` labelled rows and ``screened`` of their features,
    with ``fair`` as the weight of the penalty; null labels and ids are no rows.

    A doc_id with several labels has the greatest. Where it is on several rows
    of ``docs``, each is learnt from, or one only if they would be more than
    ``sample``. Without labels of both kinds the model is their smoothed rate
    alone.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    kind = dict(found.dtypes)["doc_id"]
    table = stash(found.mapInArrow(_featured, f"doc_id {kind}, toxic int, features array<int>, swapped array<int>"), "featured")
    n, toxic = table.agg(F.count("*"), F.sum("toxic")).first()
    if n > sample:
        table = table.groupBy("doc_id", "toxic").agg(F.min(F.struct("features", "swapped")).alias("x")).select("doc_id", "toxic", "x.*")
        table = stash(table, "featured")
        n, toxic = table.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < toxic < n:
        return fit_weights(np.full(n, float(toxic or 0) / max(n, 1)), [], [])
    rate = toxic / n
    tally = table.select("toxic", "features").mapInArrow(_tallied, "feature int, n long, toxic long")
    tally = tally.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    lift = F.abs((F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1))
    best = tally.where(F.col("n") >= _SMALL).orderBy(lift.desc(), "feature").limit(screened).collect()
    wanted = pa.array(sorted(r["feature"] for r in best), pa.int32())

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], *(_only(batch[c], wanted) for c in ("features", "swapped"))], ["toxic", "features", "swapped"])

    told = table.orderBy("doc_id", "toxic").select("toxic", "features", "swapped").mapInArrow(telling, "toxic int, features array<int>, swapped array<int>").toArrow()
    return fit_weights(told["toxic"].to_numpy().astype(float), _arrays(told["features"]), _arrays(told["swapped"]), fair=fair, screened=screened)


def _only(lists: pa.ListArray, wanted: pa.Array) -> pa.ListArray:
    """The lists with nothing but ``wanted`` values; nulls stay."""
    values = lists.flatten()
    kept = np.asarray(pc.is_in(values, value_set=wanted))
    total = np.append(0, np.cumsum(kept))
    ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0))))
    offsets = pa.array(total[ends].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values.filter(pa.array(kept)), mask=pc.is_null(lists))


def _arrays(column: pa.ChunkedArray) -> list:
    """The lists of a column as views of its values, None for nulls."""
    out: list = []
    for chunk in column.chunks:
        values, ends, there = chunk.values.to_numpy(zero_copy_only=False), np.asarray(chunk.offsets), np.asarray(chunk.is_valid())
        out += [values[i:j] if ok else None for i, j, ok in zip(ends, ends[1:], there, strict=False)]
    return out


class _Known:
    """The weighted features of the pieces seen so far, by their keys."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.table, self.features, self.telling = PieceTable(), [], np.zeros(1 << 14, dtype=bool)

    def find(self, found: Pieces) -> np.ndarray:
        if self.table.n > 500_000:
            self.clear()
        k1, k2 = found.keys()
        at = self.table.find(k1, k2)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            first, inverse = distinct(k1[missing], k2[missing])
            new, base = missing[first], self.table.n
            at[missing] = base + inverse
            self.table.add(k1[new], k2[new])
            self.features += [tuple(f for f in word_features(w) if f in self.weights) for w in found.strings(new)]
            while len(self.features) > len(self.telling):
                self.telling = np.concatenate([self.telling, np.zeros_like(self.telling)])
            self.telling[base : len(self.features)] = [bool(f) for f in self.features[base:]]
        return at


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    weights = model.value
    known = _Known(weights)
    for batch in batches:
        for a, b in slices(batch["text"]):
            found = Pieces(batch["text"][a:b])
            slots = known.find(found)
            at = np.flatnonzero(known.telling[slots])
            doc = np.searchsorted(found.offsets, at, side="right") - 1
            there = {(d, f) for d, k in set(zip(doc.tolist(), slots[at].tolist(), strict=True)) for f in known.features[k]}
            total = np.full(b - a, weights[-1])
            if there:
                rows, features = zip(*sorted(there), strict=True)
                total += np.bincount(rows, weights=[weights[f] for f in features], minlength=b - a)
            score = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            cols = [batch[n][a:b] for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], [*(n for n in batch.schema.names if n != "text"), "score"])


def score(docs: DataFrame, model: dict[int, float], keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row and its ``score``, 0 to 1.

    A null or empty text scores as the intercept alone. No column but ``text``
    is an input of a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{n}` {dict(docs.dtypes)[n]}" for n in keep)
    return docs.select(*keep, "text").mapInArrow(lambda batches: _scored(shared, batches), f"{fields}, score double")


def keep_clean(docs: DataFrame, model: dict[int, float], threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    whole = docs.select("text", whole_row(docs).alias("_whole"))
    return score(whole, model, ["_whole"]).where(F.col("score") < threshold).select("_whole.*")
