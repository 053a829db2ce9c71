"""Benchmark decontamination by winnowing.

Both sides are cut into folded words. Of every 6 consecutive 8-word grams the smallest hash is kept
as a fingerprint, so any 13 consecutive words that a document shares with a benchmark item contain
a fingerprint that both sides keep. Fingerprints are joined; each hit is extended to the 13-word
windows through it, which are looked up whole and mark the document's words. Items of fewer than 13
words (one window, the whole item) are looked up by the hash of all their words.

A benchmark of at most ``block_bytes`` of text is held by every task, so documents are never
shuffled. Beyond that fingerprints, and the windows of texts that share one, are joined by key;
items of fewer than 13 words are then looked up in blocks of that size, one narrow pass each.

Defined results: a null or empty text has no words, no hits and isn't contaminated; an item without
words never occurs; repeated items count once by id; an item without id marks words but isn't
listed; repeated rows are judged each; an empty table gives an empty one, an empty benchmark hits nothing;
texts of any length are read whole; extra columns pass through, and added columns whose names are
taken get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm import words as X
from spanwarden.llm.common import cut, fresh, join_small, quoted

WINDOW = 13
GRAM = 8
PER_WINDOW = WINDOW - GRAM + 1
BLOCK_BYTES = 32 << 20
#: Documents with this share of hit words are contaminated: 1 in ...
SHARE = 20
#: Fingerprints, windows (8 to 40 bytes) and texts with hits that are broadcast at most.
BROADCAST_KEYS, BROADCAST_TEXTS = 500_000, 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Chained passes before their result is written down.
CHAIN = 4


def _slide(x: np.ndarray, k: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every k consecutive values."""
    have = 1
    while have < k:
        step = min(have, k - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def winnow(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints: grams that are the smallest of a window of their text."""
    gram, whole = X.grams(w, GRAM)
    if len(gram) < PER_WINDOW:
        return np.empty(0, np.int64), np.empty(0, X.U64)
    full = whole[: len(gram) - PER_WINDOW + 1] & (w.doc[: len(gram) - PER_WINDOW + 1] == w.doc[WINDOW - 1 :])
    least = np.where(full, _slide(gram, PER_WINDOW, np.minimum), X.U64(0))
    padded = np.zeros(len(least) + 2 * (PER_WINDOW - 1), X.U64)
    padded[PER_WINDOW - 1 : PER_WINDOW - 1 + len(least)] = least
    at = np.flatnonzero((_slide(padded, PER_WINDOW, np.maximum) == gram) & whole)
    return at, gram[at]


@dataclass
class Index:
    keys: np.ndarray  # sorted fingerprints of long items
    windows: np.ndarray  # sorted distinct hashes of long items' windows
    first: np.ndarray  # of each window's items in ``item``
    item: np.ndarray  # the distinct items of each window
    ids: np.ndarray  # str or None
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words: sorted hashes and their items


def _words(column: pa.Array, limit: int = X.CHUNK) -> Iterator[tuple[int, int, X.Words]]:
    table = X.alphanumeric()
    for i, j, raw, bounds in X.blocks(column, limit):
        yield i, j, X.split(raw, bounds, table, fold=True)


def index(ids: list, texts: list) -> Index:
    _, _, w = next(_words(pa.array(texts, pa.large_string()), 1 << 40))
    _, keys = winnow(w)
    gram, whole = X.grams(w, WINDOW)
    pairs = np.unique(np.stack([gram[whole], w.doc[: len(gram)][whole].astype(X.U64)], 1), axis=0) if len(gram) else np.empty((0, 2), X.U64)
    windows, first = np.unique(pairs[:, 0], return_index=True)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in set(w.counts[(w.counts > 0) & (w.counts < WINDOW)].tolist()):
        items = np.flatnonzero(w.counts == n)
        gram, _ = X.grams(w, n)
        found = gram[w.first[items]]
        by = np.argsort(found, kind="stable")
        short[n] = (found[by], items[by])
    return Index(np.unique(keys), windows, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), np.array(ids, object), short)


def _places(sorted_keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Where each probe stands in distinct ``sorted_keys``, -1 where it doesn't."""
    if not len(sorted_keys):
        return np.full(len(probes), -1)
    at = np.minimum(np.searchsorted(sorted_keys, probes), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == probes, at, -1)


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) of every number from low up to high of every range."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def extended(w: X.Words, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, place in x.windows) of the texts' windows that stand in long items.

    A fingerprint that both sides keep is extended to the windows through it, each of which is looked up
    whole; a window is looked up once, however many hits lead to it, and is one entry however often it
    stands in the items. So repeated passages cost what they are long, not their number squared.
    """
    at, key = winnow(w)
    at = at[_places(x.keys, key) >= 0]
    gram, whole = X.grams(w, WINDOW)
    if not len(at) or not len(gram):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, start = _expanded(np.maximum(at - PER_WINDOW + 1, 0), np.minimum(at + 1, len(gram)))
    start = np.unique(start)
    start = start[whole[start]]
    place = _places(x.windows, gram[start])
    return start[place >= 0], place[place >= 0]


def occurrences(w: X.Words, x: Index) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """([(starts, words) of occurring windows], distinct (text, item) pairs)."""
    start, place = extended(w, x)
    spans = [(start, WINDOW)]
    # a window's items once for each text that holds it
    held = np.unique(np.stack([w.doc[start], place], 1), axis=0) if len(start) else np.empty((0, 2), np.int64)
    which, at = _expanded(x.first[held[:, 1]], x.first[held[:, 1] + 1])
    pairs = [np.stack([held[which, 0], x.item[at]], 1)]
    for n, (hashes, items) in x.short.items():
        gram, whole = X.grams(w, n)
        start = np.flatnonzero(whole & (_places(np.unique(hashes), gram) >= 0))
        spans.append((start, n))
        held = np.unique(np.stack([w.doc[start].astype(X.U64), gram[start]], 1), axis=0) if len(start) else np.empty((0, 2), X.U64)
        which, at = _expanded(np.searchsorted(hashes, held[:, 1], "left"), np.searchsorted(hashes, held[:, 1], "right"))
        pairs.append(np.stack([held[which, 0].astype(np.int64), items[at]], 1))
    return spans, np.unique(np.concatenate(pairs), axis=0)


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _scan(it: Iterator[pa.RecordBatch], block: Index, text: str, names: dict[str, str], first: bool, joined: tuple[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """Adds what the block's items hit; ``joined`` names columns of long items' windows and ids that were found before."""
    for batch in it:
        for i, j, w in _words(batch.column(text)):
            part = batch.slice(i, j - i)
            n = j - i
            spans: list[list[int]] = [[] for _ in range(n)] if first else part.column(names["spans"]).to_pylist()
            items: list[list[str]] = [[] for _ in range(n)] if first else part.column(names["items"]).to_pylist()
            for d, (starts, known) in enumerate(zip(part.column(joined[0]).to_pylist(), part.column(joined[1]).to_pylist(), strict=True) if joined else ()):
                hit = np.zeros(int(w.counts[d]) + 1, np.int64)
                np.add.at(hit, np.array(starts or [], np.int64), 1)
                np.add.at(hit, np.array(starts or [], np.int64) + WINDOW, -1)
                spans[d] = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]]).astype(np.int8))).tolist()
                items[d] = sorted(known or [])
            windows, pairs = occurrences(w, block)
            if any(len(start) for start, _ in windows):
                hit = np.zeros(len(w.hash) + 1, np.int64)
                for start, k in windows:
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + k, -1)
                hit = np.cumsum(hit)[:-1] > 0
                for d in np.unique(w.doc[hit]).tolist():
                    mine = hit[w.first[d] : w.first[d + 1]].copy()
                    for s, e in np.array(spans[d]).reshape(-1, 2).tolist():
                        mine[s:e] = True
                    spans[d] = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).tolist()
                    found = pairs[np.searchsorted(pairs[:, 0], d) : np.searchsorted(pairs[:, 0], d + 1), 1]
                    items[d] = sorted({*items[d], *(i for i in block.ids[found] if i is not None)})
            own = [c for c in part.schema.names if c not in (names["n_words"], names["spans"], names["items"], *(joined or ()))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array(w.counts.astype(np.int64)), _lists(spans, pa.int32()), _lists(items, pa.string())], names=[*own, names["n_words"], names["spans"], names["items"]])


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    """Items (i, t) in blocks of at most ``limit`` bytes of text (one item at least)."""
    ids: list = []
    texts: list = []
    size = 0
    for row in benchmark.toLocalIterator():
        more = len((row["t"] or "").encode())
        if texts and size + more > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += more
    yield ids, texts


def _fingerprints(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(name, key): each text's distinct fingerprints."""
    for batch in it:
        for i, _, w in _words(batch.column(1)):
            at, key = winnow(w)
            pairs = np.unique(np.stack([w.doc[at].astype(X.U64), key], 1), axis=0) if len(at) else np.empty((0, 2), X.U64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0].astype(np.int64) + i)), pa.array(pairs[:, 1].view(np.int64))], names=names)


def _windows(it: Iterator[pa.RecordBatch], all_: bool) -> Iterator[pa.RecordBatch]:
    """(id, at, key) of the windows of long texts: all, or those through the fingerprints in the third column."""
    for batch in it:
        for i, j, w in _words(batch.column(1)):
            gram, whole = X.grams(w, WINDOW)
            start = np.flatnonzero(whole)
            if not all_ and len(start):
                at, key = winnow(w)
                lists = batch.column(2).slice(i, j - i)
                wanted = np.stack([np.repeat(np.arange(j - i), np.diff(np.asarray(lists.offsets))).astype(X.U64), np.asarray(lists.flatten()).view(X.U64)], 1)
                pair = np.stack([w.doc[at].astype(X.U64), key], 1)
                # the texts' fingerprints that are among those wanted of the same text
                _, back = np.unique(np.concatenate([wanted, pair]), axis=0, return_inverse=True)
                back = back.reshape(-1)
                at = at[np.isin(back[len(wanted) :], back[: len(wanted)])]
                _, near = _expanded(np.maximum(at - PER_WINDOW + 1, 0), np.minimum(at + 1, len(gram)))
                start = np.intersect1d(near, start)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.doc[start] + i)), pa.array((start - w.first[w.doc[start]]).astype(np.int32)), pa.array(gram[start].view(np.int64))], names=["id", "at", "key"])


def _joined(rows: DataFrame, key: str, text: str, items: DataFrame, starts: str, found: str) -> DataFrame:
    """(key, starts, found): by text hash, where windows of long items stand, and the items' ids.

    Fingerprints are joined first; only texts that share one give windows, which are joined whole.
    """
    texts = rows.select(F.col(key).alias("id"), F.col(quoted(text)).alias("t"))
    own = cut(items.mapInArrow(partial(_fingerprints, names=["item", "key"]), "item string, key long").select("key").distinct())
    shared = texts.mapInArrow(partial(_fingerprints, names=["id", "key"]), "id long, key long").distinct()
    shared = join_small(shared, own, ["key"], own.count(), "inner", BROADCAST_KEYS)
    shared = cut(shared.groupBy(F.col("id").alias("s")).agg(F.collect_list("key").alias("keys")))
    near = join_small(texts.withColumnRenamed("id", "s"), shared, ["s"], shared.count(), "inner", BROADCAST_TEXTS).select("s", "t", "keys").dropDuplicates(["s"])
    near = near.mapInArrow(partial(_windows, all_=False), "id long, at int, key long")
    of = cut(items.mapInArrow(partial(_windows, all_=True), "id string, at int, key long").select("key", F.col("id").alias("item")).distinct())
    # a window with its items: rows (text, place), and rows (text, item), never all places with all items
    held = cut(join_small(near, windows := of.select("key").distinct(), ["key"], windows.count(), "inner", BROADCAST_KEYS))
    places = held.groupBy("id").agg(F.collect_set("at").alias(starts))
    ids = join_small(held.select("id", "key").distinct(), of, ["key"], of.count(), "inner", BROADCAST_KEYS).filter("item is not null")
    ids = ids.groupBy(F.col("id").alias("i")).agg(F.collect_set("item").alias(found))
    return cut(places.join(ids, F.col("id") == F.col("i"), "left").select(F.col("id").alias(key), starts, found))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """(columns ``keep`` of docs with n_words, spans of hit words, items, n_hit, contaminated; the added columns' names)."""
    keep = docs.columns if keep is None else keep
    names = {c: fresh(c, docs.columns) for c in ("n_words", "spans", "items", "n_hit", "contaminated")}
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, text])])
    own = list(rows.schema.fields)
    added = [T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], T.ArrayType(T.IntegerType())), T.StructField(names["items"], T.ArrayType(T.StringType()))]
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("i"), F.col(quoted(item_text)).alias("t"))
    joined = None
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > block_bytes:
        # long items are joined; short ones, a line of text each, are looked up in blocks
        count = F.regexp_count(F.col("t"), F.lit(WORD))
        key, *joined = (fresh(c, docs.columns) for c in ("_text", "_starts", "_found"))
        rows = rows.withColumn(key, F.xxhash64(F.col(quoted(text))))
        told = _joined(rows, key, text, items.filter(count >= WINDOW), *joined)
        rows = join_small(rows, told, [key], told.count(), "left", BROADCAST_TEXTS).drop(key)
        items = items.filter(count < WINDOW)
    for n, (ids, texts) in enumerate(_blocks(items, block_bytes)):
        block = index(ids, texts) if texts else index([], [""])
        rows = rows.mapInArrow(partial(_scan, block=block, text=text, names=names, first=n == 0, joined=tuple(joined) if joined and n == 0 else None), T.StructType(own + added))
        if n % CHAIN == CHAIN - 1:
            rows = cut(rows)
    spans, n_words = F.col(names["spans"]), F.col(names["n_words"])
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn(names["n_hit"], hit)
    rows = rows.withColumn(names["contaminated"], (F.col(names["n_hit"]) > 0) & (F.col(names["n_hit"]) * SHARE >= n_words))
    return rows.select(*[quoted(c) for c in keep], *names.values()), names


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    rows, names = contamination(docs, benchmark, **options)
    return rows.filter(~F.col(names["contaminated"])).select(*[quoted(c) for c in docs.columns])
