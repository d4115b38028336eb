"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles becomes a signature of symbols of 16 bits.
Two texts with a Jaccard similarity of J have a symbol in common with a
probability of J. The signature is split into chunks of 5 symbols, and each
chunk is indexed under its five keys of four symbols, one symbol left out in
turn: two signatures meet if some chunk has at most one error. By the
pigeonhole principle all that differ in fewer than twice as many symbols as
there are chunks do, and most others. ``indexed`` sets the number of chunks (10
for 0.8) so that of all pairs at the threshold itself 2 in a million don't
meet. Pairs that meet are confirmed on full sets if they differ in at most
``distance`` symbols (26 of 50), which another 0.2 in a million don't.

Equal sets are one node from the start. Under a key, members are not paired
with each other but with one centre, the member that meets most others, which
in a family of edited copies is their original. Candidates are confirmed on
full sets, and links give components. Wherever members of one key are then
still in different components, their pairs across components are confirmed as
well, so no link that could join two components is lost.

Keys, centres and sets that very many rows have are dealt to several tasks in
every join (``common.dealt``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, for_all_parts, hot_keys, measured, sieve, sifted, stash
from .words import Pieces, forget_encoders, mixed, slices

CHUNK = 5
#: Probabilities that a pair at the threshold doesn't meet, or is too far apart.
_MISS, _FAR = 2e-6, 2e-7
#: Open members under a key up to which they are paired with each other.
_SMALL = 32
#: Sets, and shingles of these, whose counts order the shingles of all.
_COUNTED, _OFTEN = 1024, 1 << 15


@cache
def indexed(percent: int) -> tuple[int, int]:
    """(symbols, distance) of signatures for a similarity of percent/100."""
    j = min(percent, 99) / 100
    meets = j**CHUNK + CHUNK * j ** (CHUNK - 1) * (1 - j)
    symbols = CHUNK * math.ceil(math.log(_MISS) / math.log(1 - meets))
    tail, distance = 1.0, -1
    while tail > _FAR:
        distance += 1
        tail -= math.comb(symbols, distance) * (1 - j) ** distance * j ** (symbols - distance)
    return symbols, distance


@cache
def _factors(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_817)
    return tuple(r.integers(0, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct ``size``-word shingles of each text.

    Words are lower-cased in A-Z and lie between ASCII white space; a text with
    fewer words has its whole sequence as its one shingle. Shingles are 64-bit
    hashes of their words; two of a text's n shingles fall together with a
    probability of n * n / 2**65.
    """
    found = Pieces(texts, fine=False)
    k1, k2 = found.keys()
    hashes = mixed(k1 ^ mixed(k2))
    n = np.diff(found.offsets)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(found)) - found.offsets[:-1][doc]
    left = n[doc] - place  # words from here to the end of the text
    value = mixed(hashes)
    for k in range(1, size):
        at = np.flatnonzero(left > k)
        value[at] = mixed(value[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k] + np.uint64(k))
    whole = (left >= size) | (place == 0)
    doc, value = doc[whole], value[whole]
    _, first = np.unique(value ^ mixed(doc.astype(np.uint64)), return_index=True)
    first.sort()
    return np.searchsorted(doc[first], np.arange(len(n) + 1)), value[first]


def signatures(offsets: np.ndarray, hashes: np.ndarray, symbols: int) -> np.ndarray:
    """MinHash signatures of the sets; rows of empty sets are 0."""
    out = np.zeros((len(offsets) - 1, symbols), dtype=np.int32)
    there = np.flatnonzero(np.diff(offsets))
    flip, times = _factors(symbols)
    for k in range(symbols if len(there) else 0):
        least = np.minimum.reduceat((hashes ^ flip[k]) * times[k], offsets[there])
        out[there, k] = mixed(least) & np.uint64(0xFFFF)
    return out


def _digests(offsets: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """128 bits for each set, null for empty ones."""
    of = lambda x: hashlib.blake2b(np.sort(x).tobytes(), digest_size=16).digest()
    return pa.array([of(hashes[i:j]) if j > i else None for i, j in zip(offsets, offsets[1:], strict=False)], pa.binary())


def _sketched(size: int, symbols: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in batches:
        for a, b in slices(batch["text"]):
            offsets, hashes = shingle_sets(batch["text"][a:b], size)
            signature = signatures(offsets, hashes, symbols)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * symbols), pa.array(signature.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], pa.array(np.diff(offsets)), _digests(offsets, hashes), rows], ["doc_id", "n_shingles", "set", "signature"]
            )


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            offsets, hashes = shingle_sets(batch["text"][a:b], size)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([_digests(offsets, hashes), lists], ["set", "shingles"])


def _keys(signature: Column, symbols: int) -> Column:
    """The keys of each chunk, one symbol left out in turn."""
    return F.explode(
        F.array(
            *(
                F.xxhash64(F.lit(c + drop), *(signature[c + k] for k in range(CHUNK) if k != drop))
                for c in range(0, symbols, CHUNK)
                for drop in range(CHUNK)
            )
        )
    )


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes allow the similarity, and signatures differ in few enough symbols."""
    symbols, distance = indexed(percent)
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    same = F.zip_with(F.col(f"{a}.signature"), F.col(f"{b}.signature"), lambda x, y: x == y)
    return (small * 100 >= large * percent) & (F.size(F.filter(same, lambda x: x)) >= symbols - distance)


#: Rounds of spreading after which labels also jump; stars need no more.
_SPREAD = 3


def components(links: DataFrame, own: DataFrame) -> DataFrame:
    """(node, label) for each node of these (a, b) links: the smallest ``own``
    value, from (node, own), of all nodes that can be reached, as a struct with
    the node that has it (the smallest of several).

    Labels spread along links, where each node is also linked with itself. If
    that takes more than a few rounds, they jump as well: to the label that
    their label's own node has got, so the number of rounds grows with the
    logarithm of the longest path. Nodes of very many links and labels of very
    many nodes are dealt to several tasks.
    """
    ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))
    both, seen = measured(links.select(F.inline(ends)).distinct(), "links", n=F.count(F.lit(1)))
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", seen["n"])
    both = dealt(both, "b", hubs, "a")
    labels, rounds = own.select("node", F.struct("own", "node").alias("label")), 0
    while True:
        told = for_all_parts(labels.select(F.col("node").alias("b"), "label"), "b", hubs)
        before = F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("before")
        spread = both.join(told, ["b", "part"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"), before)
        spread, seen = measured(spread, "spread", n=F.count(F.lit(1)), changed=F.sum((F.col("label") < F.col("before")).cast("long")))
        labels, rounds = spread.select("node", "label"), rounds + 1
        if not seen["changed"]:
            return labels
        if rounds >= _SPREAD:
            labels = stash(relabelled(labels, labels, seen["n"]), "labels")


def relabelled(labels: DataFrame, new: DataFrame, total: int | None) -> DataFrame:
    """The rows with node and label, each with the label that its label's own node has in
    ``new``, if it has one there."""
    labels = labels.withColumn("root", F.col("label.node"))
    popular = hot_keys(labels.groupBy("root").agg(F.count("*").alias("n")), "root", total)
    up = for_all_parts(new.select(F.col("node").alias("root"), F.col("label").alias("up")), "root", popular)
    jumped = dealt(labels, "root", popular, "node").join(up, ["root", "part"], "left")
    return jumped.withColumn("label", F.coalesce("up", "label")).drop("root", "part", "up")


def _set_of(docs: DataFrame, size: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes, read from one text of each.

    Texts stay where they are read: a sieve of the ids passes those of the
    wanted nodes and few others, and sets are told by their digests.
    """
    chosen = stash(nodes.join(wanted, "node", "left_semi").select("set", "node", "own"), "chosen")
    texts = sifted(docs.select("doc_id", "text"), "doc_id", sieve(chosen, "own"))
    sets = texts.select("text").mapInArrow(lambda batches: _sets(size, batches), "set binary, shingles array<long>")
    return stash(sets.join(chosen.select("set", "node"), "set").dropDuplicates(["set"]).select("node", "shingles"), "sets")


def _tested(docs: DataFrame, size: int, nodes: DataFrame, pairs: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The pairs (and their other columns) with their full sets' sizes na and nb, the size ``common`` of
    their intersection, and ``apart``: what is in one set and not the other.
    ``hubs``: the nodes ``a`` of very many pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _set_of(docs, size, nodes, wanted)
    left = for_all_parts(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a", hubs)
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    out = dealt(pairs.join(right, "b"), "a", hubs, "b").join(left, ["a", "part"]).withColumn("more", F.array_except("sb", "sa"))
    sizes = (F.size("sa").alias("na"), F.size("sb").alias("nb"), (F.size("sb") - F.size("more")).alias("common"))
    return stash(out.select(*pairs.columns, *sizes, F.concat("more", F.array_except("sa", "sb")).alias("apart")), "tested")


def _links(tested: DataFrame, percent: int) -> DataFrame:
    return tested.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The class of every row: doc_id, n_shingles, component_id, kept.

    Two texts are linked when their shingle sets have a Jaccard similarity of
    ``percent``/100 or more. component_id is the smallest doc_id reachable over
    links, kept marks its row. A text without words is linked with nothing.
    Rows with a null doc_id belong to rows with an equal set but are not
    compared with others; alone, their component_id is null. Other columns are
    ignored; an empty table gives no rows.
    """
    return _classes(docs, shingle, percent).drop("set")


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the digest of each row's set."""
    kind, symbols = dict(docs.dtypes)["doc_id"], indexed(percent)[0]
    rows = stash(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: _sketched(shingle, symbols, batches),
            f"doc_id {kind}, n_shingles long, set binary, signature array<int>",
        ),
        "sketches",
    )
    same = rows.where("set is not null").groupBy("set").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min("doc_id").alias("own"), F.count("*").alias("n")
    )
    nodes, seen = measured(same.withColumn("node", F.monotonically_increasing_id()), "nodes", n=F.sum("n"))
    copied = hot_keys(nodes.select("set", "n"), "set", seen["n"])
    told = _labelled(docs, shingle, percent, nodes)
    found = dealt(rows.where("set is not null"), "set", copied, "doc_id").join(for_all_parts(told, "set", copied), ["set", "part"])
    alone = rows.where("set is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "set", "n_shingles", "component_id"]
    return found.select(columns).union(alone.select(columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(docs: DataFrame, shingle: int, percent: int, nodes: DataFrame) -> DataFrame:
    """(set, component_id) of all nodes: the smallest id of their class."""
    symbols, _ = indexed(percent)
    # a set of n shingles can at best be all of another of n + 1
    usable = (F.col("n_shingles") + 1) * percent <= F.col("n_shingles") * 100
    keyed = nodes.where(F.col("own").isNotNull() & usable).select("node", _keys(F.col("signature"), symbols).alias("key"))
    met, seen = measured(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met", n=F.sum("n"))
    common = hot_keys(met, "key", seen["n"])
    keyed = dealt(keyed, "key", common, "node").join(for_all_parts(met, "key", common), ["key", "part"])
    keyed = keyed.groupBy("node").agg(F.sum("n").alias("meets"), F.collect_list(F.struct("key", "part")).alias("k"))  # at most ``symbols`` keys
    keyed = stash(keyed.select("node", "meets", F.inline("k")), "keyed")
    centres = keyed.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("centre")).select("key", F.col("centre.node").alias("a"))
    centres = stash(centres, "centres")
    stars = keyed.join(for_all_parts(centres, "key", common), ["key", "part"]).where("a != node")
    stars, seen = measured(stars.select("a", F.col("node").alias("b")).distinct(), "stars", n=F.count(F.lit(1)))
    hubs = hot_keys(stars.groupBy("a").agg(F.count("*").alias("n")), "a", seen["n"])
    of = lambda name: nodes.select(F.col("node").alias(name), F.struct("n_shingles", "signature").alias(f"of_{name}"))
    stars = dealt(stars.join(of("b"), "b"), "a", hubs, "b").join(for_all_parts(of("a"), "a", hubs), ["a", "part"])
    stars = stash(stars.where(_near("of_a", "of_b", percent)).select("a", "b"), "near")
    tested = _tested(docs, shingle, nodes, stars, hubs)
    own = nodes.select("node", "own")
    labels = components(_links(tested, percent), own)
    found = labels.select("node", F.col("label.node").alias("label"))
    more = _within_families(tested, found, percent)
    rest = _across(docs, shingle, nodes, keyed, centres, common, found, tested, percent)
    if rest is not None:
        hubs = hot_keys(rest.groupBy("a").agg(F.count("*").alias("n")), "a", rest.count())
        more = more.union(_links(_tested(docs, shingle, nodes, rest, hubs), percent).select("la", "lb"))
    # links between components: each is one node from here on, that with its smallest id
    more, seen = measured(more.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "more", n=F.count(F.lit(1)))
    every = nodes.select("set", "node", "own").join(labels, "node", "left").withColumn("label", F.coalesce("label", F.struct("own", "node")))
    if seen["n"]:
        every = relabelled(every, components(more, own), nodes.count())
    return every.select("set", F.col("label.own").alias("component_id"))


def _across(
    docs: DataFrame, shingle: int, nodes: DataFrame, keyed: DataFrame, centres: DataFrame, common: DataFrame | None, labels: DataFrame, tested: DataFrame, percent: int
) -> DataFrame | None:
    """Pairs under one key, in different components la and lb, of which at least
    one was too far from the key's centre to be tested against it.

    Few members of a key are compared by their signatures. Many are paired only
    if they share one of their first shingles, as all that are linked do.
    """
    of = nodes.select("node", F.struct("n_shingles", "signature").alias("of_node"))
    member = keyed.select("node", "key", "part").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    near_centre = tested.select("a", F.col("b").alias("node"), F.lit(True).alias("tested"))
    member = member.join(for_all_parts(centres, "key", common), ["key", "part"]).where("node != a").join(near_centre, ["a", "node"], "left")
    member = stash(member.select("key", "part", "node", "label", "tested"), "key_members")
    far = F.sum(F.col("tested").isNull().cast("long")).alias("far")
    open_ = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), far, F.count("*").alias("n")).where("lo < hi and far > 0")
    open_, seen = measured(open_.select("key", "n"), "open", n=F.count(F.lit(1)), most=F.max("n"))
    if not seen["n"]:
        return None
    member = stash(member.join(for_all_parts(open_, "key", common), ["key", "part"]).select("key", "node", "label", "tested", "n"), "open_members")
    few = member.where(F.col("n") <= _SMALL).join(of, "node")
    untested = F.col("x.tested").isNull() | F.col("y.tested").isNull()
    ordered = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & untested & (F.col("x.node") < F.col("y.node"))
    pair = (F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
    pairs = few.alias("x").join(few.alias("y"), ordered & _near("x.of_node", "y.of_node", percent)).select(*pair)
    if seen["most"] > _SMALL:
        pairs = pairs.union(_sharing(docs, shingle, nodes, member.where(F.col("n") > _SMALL), of, percent))
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, seen = measured(pairs.distinct().join(done, ["a", "b"], "left_anti"), "across", n=F.count(F.lit(1)))
    return pairs if seen["n"] else None


def _sharing(docs: DataFrame, shingle: int, nodes: DataFrame, member: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``_across`` among these members that share one of their first shingles.

    A node stands here once, however many keys it has. One of each pair is
    untested under a key that the other has too, so shingles that are among the
    first of no such node pair nothing.
    """
    far = F.collect_list(F.when(F.col("tested").isNull(), F.col("key"))).alias("far")
    node = member.groupBy("node").agg(F.first("label").alias("label"), F.collect_list("key").alias("keys"), far).join(of, "node")
    node, total = measured(node, "open_nodes", n=F.count(F.lit(1)))
    first = _first(_set_of(docs, shingle, nodes, node.select("node")), total["n"], percent)
    first = stash(first.join(node.select("node", (F.size("far") > 0).alias("is_far")), "node").select("node", "is_far", F.explode("first").alias("shingle")), "first")
    shared = first.groupBy("shingle").agg(F.count("*").alias("n"), F.max("is_far").alias("any")).where("n > 1 and any").select("shingle")
    placed = stash(first.join(shared, "shingle").join(node, "node"), "shared")
    alike = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & F.arrays_overlap("x.far", "y.keys")
    ends = [f(F.struct("x.node", "x.label"), F.struct("y.node", "y.label")).alias(k) for k, f in (("a", F.least), ("b", F.greatest))]
    pairs = placed.where("is_far").alias("x").join(placed.alias("y"), alike & _near("x.of_node", "y.of_node", percent)).select(*ends)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"))


def _first(sets: DataFrame, total: int, percent: int) -> DataFrame:
    """(node, first): so many of the first shingles of each of these ``total``
    sets that two linked sets share one of them, in one order of all shingles.

    That holds in any order, so it may be the one in which a bounded sample of
    the sets has them, rarest first: the sample decides about work only.
    """
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(-(-total // _COUNTED))) == 0)
    often = some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rows = sorted((r["shingle"], r["n"]) for r in often.orderBy(F.desc("n"), "shingle").limit(_OFTEN).collect())
    known, counts = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(2))
    return sets.select("node", "shingles").mapInArrow(lambda batches: _firsts(known, counts, percent, batches), "node long, first array<long>")


def _firsts(known: np.ndarray, counts: np.ndarray, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``counts`` of the ``known`` shingles, which ascend; others come before them."""
    for batch in batches:
        sizes = batch["shingles"].value_lengths().to_numpy()
        values = batch["shingles"].flatten().to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        seen = np.zeros(len(values), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            seen = np.where(known[at] == values, counts[at], 0)
        order = np.lexsort((values, seen, doc))
        limit = sizes - (sizes.astype(np.int64) * percent + 99) // 100 + 1
        place = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[doc]
        ends = np.concatenate([[0], np.cumsum(np.minimum(limit, sizes))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order][place < limit[doc]]))
        yield pa.RecordBatch.from_arrays([batch["node"], lists], ["node", "first"])


def _within_families(tested: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The components la and lb of linked members of one centre, where they differ.

    In a large family many members are not quite like the centre; comparing
    each with everybody else would be quadratic. But with c the centre's set
    and D what is apart between a set and c, exactly
    |x & y| = |x & c| + |y & c| - |c| + |Dx & Dy|. So x and y are linked if Dx
    and Dy share a certain number R of elements, which is at least one where x
    and y are in different components. Two sets that share R elements share one
    among the first |D| - R + 1 in any common order. With the rarest first,
    joining on these elements gives few pairs, and all that are linked.
    """
    label = F.coalesce("label", "node").alias("label")
    member = tested.withColumnRenamed("b", "node").join(labels, "node", "left").select("a", "node", "na", "nb", "common", "apart", label)
    split = member.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("a")
    member = stash(member.join(split, "a"), "members")
    beside = member.select("a", "node", F.explode("apart").alias("shingle"))
    rare = beside.groupBy("a", "shingle").agg(F.count("*").alias("n"))
    ordered = beside.join(rare, ["a", "shingle"]).groupBy("a", "node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order"))
    placed = ordered.select("a", "node", F.size("order").alias("size"), F.posexplode("order").alias("place", "o"))
    placed = placed.where("o.n > 1").select("a", "node", "size", "place", F.col("o.shingle").alias("shingle"))
    placed = stash(placed.join(member.drop("apart"), ["a", "node"]), "placed")
    needed = F.ceil((F.col("x.nb") + F.col("y.nb")) * percent / (100 + percent)).cast("int") - (F.col("x.common") + F.col("y.common") - F.col("x.na"))
    first = (F.col("x.place") <= F.col("x.size") - needed) & (F.col("y.place") <= F.col("y.size") - needed)
    differ = (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.shingle") == F.col("y.shingle"))
    pairs = placed.alias("x").join(placed.alias("y"), same & differ & first).select(
        F.col("x.a").alias("c"), F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"), needed.alias("needed")
    )
    apart = lambda name: member.select(F.col("a").alias("c"), F.col("node").alias(name), F.col("apart").alias(f"apart_{name}"))
    both = pairs.distinct().join(apart("a"), ["c", "a"]).join(apart("b"), ["c", "b"])
    linked = both.where(F.size(F.array_intersect("apart_a", "apart_b")) >= F.col("needed"))
    return linked.select("la", "lb")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, unchanged.

    Rows that repeat a kept doc_id with an equal set all stay; so do rows
    without an id. Where a doc_id stands on a kept row and on one that isn't,
    with another text, the latter is told by its set.
    """
    classes = stash(_classes(docs, shingle, percent), "classes")
    gone = classes.where("not kept and doc_id is not null").select("doc_id", "set").distinct()
    mixed_ = stash(gone.select("doc_id").join(classes.where("kept"), "doc_id", "left_semi").distinct(), "mixed")
    if mixed_.isEmpty():
        ids = stash(gone.select("doc_id").distinct(), "gone")
        bits = stash(sieve(ids, "doc_id"), "sieve")
        rest = sifted(docs, "doc_id", bits).join(ids, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
        return sifted(docs, "doc_id", bits, within=False).union(rest)
    told = docs.select("doc_id", "text").join(mixed_, "doc_id", "left_semi").distinct()
    kind = dict(docs.dtypes)["doc_id"]
    told = told.mapInArrow(lambda batches: _told(shingle, batches), f"doc_id {kind}, text string, set binary")
    texts = told.join(gone, ["doc_id", "set"], "left_semi").select("doc_id", "text")
    ids = gone.select("doc_id").distinct().join(mixed_, "doc_id", "left_anti")
    return docs.join(ids, "doc_id", "left_anti").join(texts, ["doc_id", "text"], "left_anti").select(*(f"`{c}`" for c in docs.columns))


def _told(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"]):
            digests = _digests(*shingle_sets(batch["text"][a:b], size))
            yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["text"][a:b], digests], ["doc_id", "text", "set"])
