"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles. Documents of one set form a class (128-bit hash
of the sorted set), whose smallest doc_id stands for it. Under each permutation both the smallest
and the largest hash of a set are kept, so ``PERMUTATIONS`` hash evaluations give twice as many
signature values; bands of ``BAND`` permutations (twice as many values) are bucket keys. Two sets of
similarity 0.8 share no bucket with a chance of (1 - 0.8**6)**40 = 5e-6.

Buckets are never expanded into pairs at once. First each bucket's most central member (the one
whose buckets are fullest) is held against the others on full sets, and the links joined to
components; then the documents of buckets that still hold several components are joined on their
rarest shingles, and what meets there is held against each other on full sets. So every pair in a
bucket is joined, or refuted on full sets or by the bounds that such sets keep.

Defined results: a text with fewer words than a shingle is one shingle, its whole sequence; null
and wordless texts have an empty set and link with nothing; rows that share a doc_id are one
document (in ``one_of_each`` each is its own); a row without doc_id stays and has no component; an
empty table gives an empty one; of equal sets the smallest doc_id stands for all; texts of any length are
read whole, in slices of whole texts; extra columns pass through, helper columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm import words as X
from spanwarden.llm.common import cut, cut_counted, fresh, join_small, quoted
from spanwarden.llm.components import components

SHINGLE = 5
PERCENT = 80
PERMUTATIONS = 120
BAND = 3
#: Ids of this many documents are broadcast (8 bytes each) rather than texts shuffled.
BROADCAST_IDS = 500_000
#: Keys of shared buckets and shingles are as many as documents, so only few are broadcast.
BROADCAST_KEYS = 10_000
_SEED = X.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=X.U64) * X.U64(0xA0761D6478BD642F))
_FLIP = (_SEED[:PERMUTATIONS] >> X.U64(32)).astype(np.uint32)
_TIMES = (_SEED[PERMUTATIONS:] >> X.U64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text)."""
    w = X.split(raw, bounds, X.space_separated(), fold=True)
    gram, whole = X.grams(w, k)
    key, doc = gram[whole], w.doc[: len(gram)][whole]
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        parts = []
        for n in np.unique(w.counts[few]).tolist():
            at = few[w.counts[few] == n]
            parts.append((X.mix(X.grams(w, n)[0][w.first[at]] + X.U64(n)), at))
        key = np.concatenate([key, *[p[0] for p in parts]])
        doc = np.concatenate([doc, *[p[1] for p in parts]])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    edge = np.searchsorted(doc, np.arange(len(bounds)))
    sets = [np.unique(key[edge[i] : edge[i + 1]]) for i in range(len(bounds) - 1)]
    first = np.zeros(len(bounds), np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate([*sets, np.empty(0, X.U64)]), first


def signatures(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts with a set) x (2 * PERMUTATIONS): the smallest and largest hash under each permutation."""
    start = first[:-1][np.diff(first) > 0]
    out = np.empty((len(start), 2 * PERMUTATIONS), np.uint32)
    if not len(start):
        return out
    short = (key >> X.U64(32)).astype(np.uint32)
    for i in range(PERMUTATIONS):
        h = (short ^ _FLIP[i]) * _TIMES[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, 2 * i] = np.minimum.reduceat(h, start)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, start)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    n = PERMUTATIONS // BAND
    values = signature.reshape(len(signature), n, 2 * BAND).astype(X.U64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=X.U64), values.shape[:2]).copy()
    for i in range(2 * BAND):
        key = X.mix(key * X.U64(0x9FB21C651E98DF25) + values[:, :, i])
    return key.view(np.int64)


def _signed(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, raw, bounds in X.blocks(batch.column("text")):
            key, first = shingle_sets(raw, bounds, k)
            n = np.diff(first)
            full = n > 0
            sums = np.zeros((2, len(key) + 1), X.U64)
            np.cumsum(key, out=sums[0, 1:])
            np.cumsum(X.mix(key ^ X.U64(0x94D049BB133111EB)), out=sums[1, 1:])
            h1, h2 = (X.mix(s[first[1:]] - s[first[:-1]] + n.astype(X.U64)).view(np.int64) for s in sums)
            keys = bands(signatures(key, first))
            width = keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(h1), pa.array(h2), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])


def _sets(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, raw, bounds in X.blocks(batch.column("text")):
            key, first = shingle_sets(raw, bounds, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)))], names=["id", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def _alike(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _joined(apart: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links between documents (rep, component) of different components; ``known`` pairs have been judged.

    Sets are ordered from the rarest shingle on. Two sets that are similar enough share one among the
    first of each, and the first that they share leaves enough places behind it (prefix and position
    bounds of Bayardo, Ma and Srikant, 2007, and Xiao et al., 2008). So copies that differ from
    one another by too much meet only in shingles that few of them have, not all with all.
    """
    own = cut(apart.join(sets.withColumnRenamed("id", "rep"), "rep").withColumn("n", F.size("shingles").cast("long")))
    tokens = own.select("rep", F.explode("shingles").alias("token"))
    shared, n_shared = cut_counted(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"))
    order = join_small(tokens, shared, ["token"], n_shared, "inner", BROADCAST_KEYS).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("order"))
    # shingles of one set alone come before all others and meet nothing
    first = order.join(own.select("rep", "component", "n"), "rep").withColumn("alone", F.col("n") - F.size("order"))
    probed = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")).cast("int")
    placed = cut(first.select("rep", "component", "n", "alone", F.posexplode(F.slice("order", F.lit(1), probed)).alias("at", "o")).select("rep", "component", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("o.token").alias("token")))
    x = placed.select("token", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("px"))
    indexed = F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent))
    y = placed.filter(indexed).select("token", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("py"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    enough = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    met = x.alias("l").join(y.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("cx") != F.col("cy")) & smaller & _alike("nx", "ny", percent) & enough)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _linked(pairs.join(known, ["a", "b"], "left_anti"), sets, percent)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    signed = cut(rows.mapInArrow(partial(_signed, k=shingle), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))
    real = signed.filter("n_shingles > 0 and doc_id is not null")

    classes, n_classes = cut_counted(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "rep"))
    placed = join_small(signed.drop("bands"), classes, ["h1", "h2"], n_classes)
    placed = placed.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    single = join_small(real, classes, ["h1", "h2"], n_classes).filter(F.coalesce("rep", "doc_id") == F.col("doc_id"))
    every = single.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))

    full, n_keys = cut_counted(every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    members = cut(join_small(every, full, ["key"], n_keys, "inner", BROADCAST_KEYS).distinct())
    ids, n_ids = cut_counted(members.groupBy("rep").agg(F.sum("c").alias("score")))
    wanted = ids.select(F.col("rep").alias("doc_id"))
    sets = cut(join_small(rows, wanted, ["doc_id"], n_ids, "inner", BROADCAST_IDS).mapInArrow(partial(_sets, k=shingle), "id long, shingles array<long>").distinct())

    scored = members.join(ids, "rep")
    centre = scored.groupBy("key").agg(F.max(F.struct(F.col("score"), (-F.col("rep")).alias("r"), F.col("n").alias("m"))).alias("top"))
    stars = join_small(members, centre, ["key"], n_keys, "inner", BROADCAST_KEYS).withColumn("a", -F.col("top.r")).withColumn("m", F.col("top.m"))
    stars = cut(stars.filter((F.col("a") != F.col("rep")) & _alike("n", "m", percent)).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())
    links = cut(_linked(stars, sets, percent))
    part, n_part = cut_counted(components(links, "a", "b"))

    # what shares a bucket and is still apart, by component
    whole = cut(ids.select("rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")))
    in_key = members.join(whole, "rep")
    split = in_key.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    apart = cut(join_small(in_key.select("key", "rep", "component"), split, ["key"], n_keys, "inner", BROADCAST_KEYS).select("rep", "component").distinct())
    more, n_more = cut_counted(_joined(apart, sets, stars, percent))
    if n_more:
        part, n_part = cut_counted(components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b"))

    out = join_small(placed, part.select(F.col("node").alias("rep"), "component"), ["rep"], n_part)
    # rows that share a doc_id are one document: the id's own component holds for all of them
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each group (smallest doc_id, rows without one last), with their own columns.

    Here every row is a document of its own, known by the hash of its doc_id and text, so rows that
    share a doc_id, or have none, are judged by their own texts; of rows equal in both one stays.
    """
    key, keep, group, same = (fresh(c, docs.columns) for c in ("_row", "_keep", "_group", "_same"))
    rows = docs.withColumn(key, F.xxhash64(F.col(quoted(doc_id)), F.col(quoted(text)).isNull(), F.col(quoted(text))))
    found = near_duplicates(rows, key, text, **options).filter("n_shingles > 0").select(F.col("doc_id").alias(key), F.col("component_id").alias(group))
    found = cut(found.groupBy(key, group).agg(F.count("*").alias(same)))
    many, n_many = cut_counted(found.groupBy(group).agg(F.sum(same).alias("c")).filter("c > 1").select(group))
    linked, n = cut_counted(join_small(found, many, [group], n_many, "inner", BROADCAST_IDS))
    place = F.struct(F.col(quoted(doc_id)).isNull().alias("none"), F.col(quoted(doc_id)).alias("id"), F.col(key).alias("row")).alias("place")
    places = join_small(rows.select(key, place), linked, [key], n, "inner", BROADCAST_IDS)
    first = cut(places.groupBy(group).agg(F.min("place")["row"].alias(keep)))
    told = join_small(linked, first, [group], n, "inner", BROADCAST_IDS).drop(group)
    rows = join_small(rows, told, [key], n, "left", BROADCAST_IDS).filter(F.col(keep).isNull() | (F.col(keep) == F.col(key)))
    alone = rows.filter(F.coalesce(F.col(same), F.lit(1)) == 1)
    return alone.unionByName(rows.filter(F.col(same) > 1).dropDuplicates([key])).select(*[quoted(c) for c in docs.columns])
