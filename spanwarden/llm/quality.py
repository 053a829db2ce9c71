"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: folded words, and 1- to 3-grams of word shapes (case,
digits, symbols, last character, length, whether a word repeats its neighbour). Each indicator is
scaled by its class log-count ratio; a linear hinge-loss model is fitted to them by dual coordinate
descent and interpolated with the naive Bayes direction; a logistic curve through held-back rows of
the sample turns margins into scores.

The fit takes a bounded sample (``SAMPLE`` rows, in one task of an executor); scoring covers every
whole text in one narrow pass. Defined results: null and empty texts get the score of a text
without features; repeated rows score alike; an empty table scores nothing; without labels of both
classes every score is the share of label 1 (or 0.5); texts of any length are read whole; extra columns
pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm import words as X
from spanwarden.llm.common import fresh, quoted
from spanwarden.llm.sampling import labelled, remainder

SAMPLE = 10_000
BITS = 18
SEED = 17
C = 1.0
EPOCHS = 12
MIXED = 0.25  # weight of the support vectors against naive Bayes' mean weight
SMOOTH = 1.0


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
for _low, _high in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _SYMBOL[_low:_high] = True


def features(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed features of each text."""
    w = X.split(raw, bounds, X.space_separated(), fold=True)
    n = len(w.hash)
    size = (w.end - w.start).astype(np.int64)
    parts = [np.minimum(3 * _part(raw, w, t) // np.maximum(size, 1) + (_part(raw, w, t) > 0), 3) for t in (_UPPER, _DIGIT, _SYMBOL)]
    shape = parts[0] + 4 * parts[1] + 16 * parts[2]
    last = np.where(_SYMBOL[raw[w.end - 1]] if n else np.zeros(0, bool), raw[w.end - 1] if n else np.zeros(0, np.uint8), 0).astype(np.int64)
    again = np.zeros(n, np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = ((shape * 128 + last) * 2 + again) * 4 + np.minimum(size // 8, 3)
    s = X.mix(shape.astype(X.U64) + X.U64(0x51ED270B))
    fields = [(w.hash ^ X.U64(0x5DEECE66D), w.doc), (s, w.doc)]
    run = s
    for k in (2, 3):
        run = X.mix(run[:-1] * X.U64(0xC2B2AE3D27D4EB4F) + s[k - 1 :]) if n >= k else np.empty(0, X.U64)
        m = len(run)
        same = w.doc[:m] == w.doc[k - 1 :] if m else np.zeros(0, bool)
        fields.append((run[same], w.doc[:m][same]))
    key = np.concatenate([(X.mix(f) >> X.U64(64 - BITS)).astype(np.int32) for f, _ in fields])
    doc = np.concatenate([d for _, d in fields])
    pair = np.unique((doc.astype(np.int64) << BITS) | key)
    edge = np.searchsorted(pair, np.arange(len(bounds), dtype=np.int64) << BITS)
    flat = (pair & ((1 << BITS) - 1)).astype(np.int32)
    return [flat[edge[i] : edge[i + 1]] for i in range(len(bounds) - 1)]


def _part(raw: np.ndarray, w: X.Words, table: np.ndarray) -> np.ndarray:
    sums = _sums(table[raw])
    return (sums[w.end] - sums[w.start]).astype(np.int64)


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights (and bias) over scaled indicators, by dual coordinate descent."""
    weight, bias = np.zeros_like(ratio), 0.0
    alpha = np.zeros(len(rows))
    scaled = [ratio[r] for r in rows]
    norm = np.array([x @ x for x in scaled]) + 1.0
    # rows are held at equal norm: long texts have more features, not more say
    norm_root = np.sqrt(norm)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            margin = sign[i] * (weight[rows[i]] @ scaled[i] + bias) / norm_root[i]
            new = min(max(alpha[i] + 1.0 - margin, 0.0), c)
            change = (new - alpha[i]) * sign[i] / norm_root[i]
            if change:
                alpha[i] = new
                weight[rows[i]] += change * scaled[i]
                bias += change
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return weight, bias


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps, a little regularised)."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((goal - p) * x).sum() - 1e-3 * slope, (goal - p).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """The model: weights of all features, and the curve."""
    size = 1 << BITS
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return {"weight": np.zeros(size, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))}
    sums = np.full((2, size), SMOOTH)
    for r, k in zip(rows, y, strict=True):
        sums[int(k)][r] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    back = np.arange(len(rows)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back[:] = True
        learn = np.ones(len(rows), bool)
    else:
        learn = ~back
    at = np.flatnonzero(learn)
    weight, bias = descend([rows[i] for i in at], 2.0 * y[at] - 1, ratio)
    mean = np.abs(weight).mean()
    weight = ((1 - MIXED) * mean + MIXED * weight) * ratio
    margin = np.array([_margin(weight, bias * MIXED, rows[i]) for i in np.flatnonzero(back)])
    slope, offset = _logistic(margin, y[back])
    return {"weight": weight.astype(np.float32), "bias": bias * MIXED, "slope": slope, "offset": offset}


def _margin(weight: np.ndarray, bias: float, row: np.ndarray) -> float:
    return float((weight[row].sum() + bias) / np.sqrt(len(row) + 1))


def _fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[np.ndarray] = []
    y: list[int] = []
    for batch in it:
        for i, j, raw, bounds in X.blocks(batch.column("text")):
            rows += features(raw, bounds)
            y += batch.column("label").slice(i, j - i).to_pylist()
    # the order of the rows must not depend on how they were read
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), y[i]))
    rng = np.random.default_rng(SEED)
    order = [order[i] for i in rng.permutation(len(order))]
    model = fit([rows[i] for i in order], np.array([y[i] for i in order], float))
    rest = json.dumps({k: v for k, v in model.items() if k != "weight"})
    yield pa.RecordBatch.from_arrays([pa.array([model["weight"].tobytes()]), pa.array([rest])], names=["weight", "rest"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> dict:
    rows = labelled(docs, labels, label, folds, held_out, sample).repartition(1)
    row = rows.mapInArrow(_fitted, "weight binary, rest string").first()
    if row is None:  # no labelled document
        return fit([], np.empty(0))
    return {"weight": np.frombuffer(row["weight"], np.float32), **json.loads(row["rest"])}


def _scored(it: Iterator[pa.RecordBatch], model: dict, text: str, keep: list[str], score: str) -> Iterator[pa.RecordBatch]:
    weight = model["weight"].astype(float)
    for batch in it:
        for i, j, raw, bounds in X.blocks(batch.column(text)):
            margin = np.array([_margin(weight, model["bias"], r) for r in features(raw, bounds)])
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p)], names=[*keep, score])


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs with the score; where the name is taken it gets an underscore."""
    keep = docs.columns if keep is None else keep
    name = fresh(name, keep)
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(partial(_scored, model=model, text=text, keep=keep, score=name), schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = score(docs, train(docs, labels), keep=["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
