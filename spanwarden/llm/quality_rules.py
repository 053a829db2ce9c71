"""Quality rules with adaptive thresholds.

Every text gets exact counts (words, code points in words, symbols, repeated lines, words inside
repeated 5-word windows). Beside the fixed base rule, four ratios are judged against thresholds
that follow the corpus: their distribution per language and source is kept in mergeable quantile
sketches (integer histograms whose cells keep six significant bits, so a quantile is off by less
than 1/32; merging is adding), from which an outer fence is read. A group of few documents takes
its language's merged sketch, a rare language the corpus's. The thresholds are then joined to the
documents by language and source.

Defined results: a null or empty text has no words, hence fails the base rule; null languages and
sources are groups of their own; repeated rows are judged each; a value on a threshold passes; an empty
table gives an empty one; texts of any length are counted whole; extra columns pass through, and added
columns whose names are taken get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm import words as X
from spanwarden.llm.common import cut, fresh, join_small, quoted

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: name: (numerator, denominator, scale, least spread, judged from below too)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 10_000, 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 1_000, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 200, False),
    "word_length": ("word_chars", "n_words", 100, 40, True),
}
FENCE = 6
#: Documents that a group must have for thresholds of its own.
MIN_GROUP = 200
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEADING = (np.arange(256) & 0xC0) != 0x80


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def measure(raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of texts laid end to end."""
    word = X.space_separated()
    w = X.split(raw, bounds, word, fold=False)
    n_docs = len(bounds) - 1
    sums = lambda flags: X.per_doc(flags, bounds)
    out = {"n_words": w.counts, "word_chars": sums(word[raw] & _LEADING[raw]), "n_symbols": sums(_SYMBOLS[raw])}

    cuts = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([bounds[:-1], cuts + 1]))
    ends = np.sort(np.concatenate([cuts, bounds[1:]]))
    line_doc = np.repeat(np.arange(n_docs), 1 + X.per_doc(raw == 10, bounds))
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, start)
    line = X.span_hash(X.prefix(raw, X.BYTE_CODES), start, ends)
    key = X.mix(line + X.mix(line_doc.astype(X.U64)))[has_word]
    owner = line_doc[has_word]
    order = np.lexsort((key, owner))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][same], minlength=n_docs)
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)

    gram, whole = X.grams(w, 5)
    covered = np.zeros(len(w.hash), bool)
    at = np.flatnonzero(whole)
    if len(at):
        hit = at[_repeated(X.mix(gram[at] + X.mix(w.doc[at].astype(X.U64))))]
        for i in range(5):
            covered[hit + i] = True
    out["n_repeat_words"] = X.per_doc(covered, w.first)
    return out


def ratio(counts: dict[str, np.ndarray], name: str) -> np.ndarray:
    top, bottom, scale, _, _ = RATIOS[name]
    return counts[top] * scale // np.maximum(counts[bottom], 1)


def cell(values: np.ndarray) -> np.ndarray:
    """The lower bound of a value's sketch cell: six significant bits are kept."""
    shift = np.maximum(np.frexp(values.astype(float))[1] - 6, 0)
    return (values >> shift) << shift


def _batches(it: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for batch in it:
        for i, j, raw, bounds in X.blocks(batch.column(text)):
            yield batch.slice(i, j - i), measure(raw, bounds)


def _sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows: list[pa.Table] = []
        for part, counts in _batches(iter([batch]), "text"):
            judged = counts["n_words"] > 0
            for name in RATIOS:
                rows.append(pa.table({"lang": part.column("lang"), "source": part.column("source"), "metric": pa.array([name] * len(part)), "cell": pa.array(cell(ratio(counts, name)))}).filter(pa.array(judged)))
        if rows:
            summed = pa.concat_tables(rows).group_by(["lang", "source", "metric", "cell"]).aggregate([([], "count_all")])
            yield from summed.rename_columns([c if c != "count_all" else "n" for c in summed.column_names]).select(["lang", "source", "metric", "cell", "n"]).combine_chunks().to_batches()


def sketches(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, cell, n): the sketches of all documents; adding n merges them."""
    rows = docs.select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(text)).alias("text"))
    parts = rows.mapInArrow(_sketched, "lang string, source string, metric string, cell long, n long")
    return parts.groupBy("lang", "source", "metric", "cell").agg(F.sum("n").alias("n"))


def _summed(rows: DataFrame, names: dict[str, str], lang: str, source: str) -> DataFrame:
    """The same sketches from rows that are measured already."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.col(names[f"r_{r}"]).alias("v")) for r in RATIOS])).alias("m")
    rows = rows.filter(F.col(names["n_words"]) > 0).select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(source)).cast("string").alias("source"), each)
    shift = "greatest(length(bin(m.v)) - 6, 0)"
    return rows.groupBy("lang", "source", "m.metric", F.expr(f"shiftleft(shiftright(m.v, {shift}), {shift})").alias("cell")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, low_*, high_*) of each group, from its own sketch or the next wider one."""
    levels = sketch.groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n"))
    every = levels.groupBy("metric", "cell").agg(F.sum("n").alias("n"))

    def quartiles(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        w = W.partitionBy(*keys, "metric")
        run = df.withColumn("up", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
        return run.groupBy(*keys, "metric").agg(
            F.max("total").alias(f"{tag}_n"),
            F.min(F.when(F.col("up") * 4 >= F.col("total"), F.col("cell"))).alias(f"{tag}_q1"),
            F.min(F.when(F.col("up") * 4 >= F.col("total") * 3, F.col("cell"))).alias(f"{tag}_q3"),
        )

    own = quartiles(sketch, ["lang", "source"], "g")
    wider = quartiles(levels, ["lang"], "l").withColumnRenamed("lang", "l_lang").withColumnRenamed("metric", "l_metric")
    widest = quartiles(every, [], "a").withColumnRenamed("metric", "a_metric")
    at = own.join(wider, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(widest, F.col("metric") == F.col("a_metric"))
    pick = lambda q: F.when(F.col("g_n") >= min_group, F.col(f"g_{q}")).when(F.col("l_n") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    at = at.withColumn("q1", pick("q1")).withColumn("q3", pick("q3"))
    least = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[3])])
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")]) * fence
    at = at.withColumn("high", F.col("q3") + spread).withColumn("low", F.col("q1") - spread)
    return at.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{side}_{k}") for k in RATIOS for side in ("low", "high")])


def _measured(it: Iterator[pa.RecordBatch], text: str, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part, counts in _batches(it, text):
        values = [counts[c] for c in COUNTS] + [ratio(counts, r) for r in RATIOS]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(v.astype(np.int64)) for v in values]], names=[*keep, *names])


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, fence: int = FENCE, min_group: int = MIN_GROUP) -> tuple[DataFrame, dict[str, str]]:
    """(columns ``keep`` of docs with counts, base_failed and kept; the added columns' names)."""
    keep = docs.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, lang, source]))
    names = {c: fresh(c, docs.columns) for c in (*COUNTS, *[f"r_{r}" for r in RATIOS], "base_failed", "kept", "group_lang", "group_source")}
    added = [names[c] for c in (*COUNTS, *[f"r_{r}" for r in RATIOS])]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, T.LongType()) for c in added])
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*carried, text])]).mapInArrow(partial(_measured, text=text, keep=carried, names=added), schema)
    if text in carried:  # texts aren't written down, but measured again
        sketch = sketches(docs, text, lang, source)
    else:
        rows = cut(rows)
        sketch = _summed(rows, names, lang, source)
    fence_table = cut(thresholds(cut(sketch), fence, min_group))
    rows = rows.withColumn(names["group_lang"], F.col(quoted(lang)).cast("string")).withColumn(names["group_source"], F.col(quoted(source)).cast("string"))
    fences = fence_table.select(F.col("lang").alias(names["group_lang"]), F.col("source").alias(names["group_source"]), *[F.col(f"{s}_{r}").alias(f"_{s}_{r}") for r in RATIOS for s in ("low", "high")])
    rows = join_small(rows, fences, [names["group_lang"], names["group_source"]], fence_table.count())
    n = lambda c: F.col(names[c])
    failed = (n("n_words") < MIN_WORDS) | (n("n_repeat_words") * 100 > n("n_words") * MAX_REPEAT_PERCENT)
    outside = F.lit(False)
    for r, (_, _, _, _, both) in RATIOS.items():
        outside = outside | (n(f"r_{r}") > F.col(f"_high_{r}"))
        if both:
            outside = outside | (n(f"r_{r}") < F.col(f"_low_{r}"))
    rows = rows.withColumn(names["base_failed"], failed).withColumn(names["kept"], ~failed & ~F.coalesce(outside, F.lit(False)))
    return rows, names


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows, names = assess(docs, **options)
    return rows.filter(F.col(names["kept"])).select(*[quoted(c) for c in docs.columns])
