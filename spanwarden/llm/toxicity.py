"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand for letters) and
scanned with one Aho-Corasick automaton. The lexicon holds word beginnings and whole words with
their log-odds of toxic against other labelled texts; hits inside exception phrases (a word alone or
with its neighbour that clean texts hold more often than toxic ones) don't count. The sum of weights
is normalised by the logarithm of the length, and a logistic curve gives the score.

Lexicon, exceptions and curve are learned from a bounded sample (``SAMPLE`` labelled rows), whose words
bound the lexicon; scoring covers every whole text in one narrow pass. Entries are word beginnings of
``SHORTEST`` to ``LONGEST`` letters and whole words of any length. Defined results: null and empty texts
have no hits and get the curve's score of none; repeated rows score alike; without labels of both classes
every score is the share of label 1 (or 0.5); an empty table scores nothing; of entries as telling the
shortest stays, of equal ones at a word the first found; extra columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm.common import cut, fresh, quoted
from spanwarden.llm.quality import _logistic
from spanwarden.llm.sampling import labelled, remainder

SAMPLE = 40_000
SHORTEST, LONGEST = 4, 8  # of a word beginning
#: Toxic sample texts that must hold an entry, and the log-odds from which it is one.
MIN_HITS = 5
MIN_WEIGHT = 2.0
#: Letters that look like ASCII ones.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁɡһкмтвнαβεικνορτυχ", "aeopcyxijsdghkmtbhabeikvoptux", strict=True))
#: Digits and signs written for letters. 1 stands for i and for l, so these two are one letter.
STAND_IN = dict(zip("0134578@$l", "oieastbasi", strict=True))


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in map(chr, range(0x20, 0x250)):
        base = unicodedata.normalize("NFKD", c.lower())
        base = "".join(x for x in base if not unicodedata.combining(x)) or " "
        base = base if base.isalnum() else " "
        out[ord(c)] = base
    out |= {ord(k): v for k, v in LOOK_ALIKE.items()} | {ord(k.upper()): v for k, v in LOOK_ALIKE.items()}
    out |= {ord(k): v for k, v in STAND_IN.items()}
    out |= {i: " " for i in range(32)} | {i: "" for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)} | {i: " " for i in range(0x2000, 0x2070) if i not in (0x200B, 0x200C, 0x200D, 0x2060)}
    out |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    return out


TABLE = _table()


def folded(text: str) -> str:
    """Folded words, each with one space before and after it."""
    return " " + " ".join(text.translate(TABLE).split()) + " "


def parts(word: str) -> Iterator[str]:
    """The lexicon entries that a word could give: its beginnings, and itself."""
    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield " " + word[:k]
    if len(word) > 2:
        yield f" {word} "


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    docs = [0, 0]
    for batch in it:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            sums[label].update({p for w in set(folded(text).split()) for p in parts(w)})
            docs[label] += 1
    keys = [*{**sums[0], **sums[1]}, ""]
    yield from pa.table({"entry": keys, "toxic": [sums[1][k] for k in keys[:-1]] + [docs[1]], "clean": [sums[0][k] for k in keys[:-1]] + [docs[0]]}).to_batches(50_000)


def _hits(text: str, automaton) -> Iterator[tuple[int, int, float]]:
    """(end, length, weight) of the heaviest hit at each word."""
    best: dict[int, tuple[int, int, float]] = {}
    for end, (n, weight) in automaton.iter(text):
        start = end - n + 1
        if start not in best or best[start][2] < weight:
            best[start] = (end, n, weight)
    yield from best.values()


def _phrases(text: str, end: int, n: int) -> tuple[str, str, str]:
    """The hit's word, and the word with the one before and after it."""
    start = end - n + 1
    stop = text.find(" ", start + 1)
    word = text[start + 1 : stop]
    before = text[text.rfind(" ", 0, start) + 1 : start]
    after = text[stop + 1 : max(text.find(" ", stop + 1), stop + 1)]
    return word, f"{before} {word}", f"{word} {after}"


def _automaton(lexicon: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, v in lexicon.items():
        out.add_word(k, (len(k), v))
    if lexicon:
        out.make_automaton()
    return out


def total(text: str, automaton, exceptions: set[str]) -> float:
    """The normalised weight of a folded text's hits."""
    if not len(automaton):
        return 0.0
    sum_ = 0.0
    for end, n, weight in _hits(text, automaton):
        if not exceptions or not any(p in exceptions for p in _phrases(text, end, n)):
            sum_ += weight
    return sum_ / np.log2(4 + text.count(" "))


def lexicon(counts: DataFrame) -> dict[str, float]:
    """Entries far more frequent in toxic texts; of nested ones the shortest that is as telling."""
    sums = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    docs = sums.filter("entry = ''").first()
    if docs is None or not docs["toxic"] or not docs["clean"]:
        return {}
    weight = F.log((F.col("toxic") + 0.5) / float(docs["toxic"])) - F.log((F.col("clean") + 0.5) / float(docs["clean"]))
    rows = sums.filter((F.col("entry") != "") & (F.col("toxic") >= MIN_HITS)).withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
    # no more than the sample's words
    found = {r["entry"]: r["weight"] for r in rows.collect()}
    out: dict[str, float] = {}
    for k in sorted(found, key=lambda k: (len(k), k)):
        if not any(out.get(k[:i], -9.0) >= found[k] - 1.0 for i in range(SHORTEST + 1, len(k))):
            out[k] = found[k]
    return out


def _judged(it: Iterator[pa.RecordBatch], entries: dict[str, float]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(entries)
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in it:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            text = folded(text)
            sums[label].update({p for end, n, _ in (_hits(text, automaton) if entries else ()) for p in _phrases(text, end, n)})
    keys = [*(sums[0] | sums[1])]
    yield from pa.table({"phrase": pa.array(keys, pa.string()), "toxic": pa.array([sums[1][k] for k in keys], pa.int64()), "clean": pa.array([sums[0][k] for k in keys], pa.int64())}).to_batches()


def _totals(it: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    automaton, exceptions = _automaton(model["lexicon"]), set(model["exceptions"])
    for batch in it:
        x = [total(folded(t), automaton, exceptions) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("label")], names=["x", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> dict:
    rows = cut(labelled(docs, labels, label, folds, held_out, sample))  # read three times
    entries = lexicon(rows.mapInArrow(_counted, "entry string, toxic long, clean long"))
    phrases = rows.mapInArrow(partial(_judged, entries=entries), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    exceptions = sorted(r["phrase"] for r in phrases.filter("clean >= 3 and clean > 2 * toxic").collect())
    model = {"lexicon": entries, "exceptions": exceptions}
    table = rows.mapInArrow(partial(_totals, model=model), "x double, label int").toPandas().sort_values(["x", "label"])
    x, y = table["x"].to_numpy(float), table["label"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return model | {"slope": 0.0, "offset": float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))}
    slope, offset = _logistic(x, y)
    return model | {"slope": slope, "offset": offset}


def _scored(it: Iterator[pa.RecordBatch], model: str, text: str, keep: list[str], score: str) -> Iterator[pa.RecordBatch]:
    m = json.loads(model)
    automaton, exceptions = _automaton(m["lexicon"]), set(m["exceptions"])
    for batch in it:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            x = np.array([total(folded(t or ""), automaton, exceptions) for t in part.column(text).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * x + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p)], names=[*keep, score])


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs with the score; where the name is taken it gets an underscore."""
    keep = docs.columns if keep is None else keep
    name = fresh(name, keep)
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(partial(_scored, model=json.dumps(model), text=text, keep=keep, score=name), schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = score(docs, train(docs, labels), keep=["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
