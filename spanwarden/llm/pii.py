"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The base patterns (email, ip, card, phone) are matched as stated, each in time linear in the text.
Beside them, a conditional random field labels the tokens that hold a digit, @ or =. Neighbours in
the text share a chain potential (one table where they stand side by side, one where words lie between).
Tokens that are equal, or similar by one of ``likeness``'s keys (an address with another tag or at another
place of a host, a number with other separators, words of one shape behind the same word), share a skip
potential with the one before of their kind, however far, so every occurrence hangs on all others and
loopy belief propagation makes their labels agree in one document. Tokens that are sure to be personal
data, keys or passwords and lie outside base spans become spans.

All weights and potentials are trained together, by the pseudo-likelihood of each token's label given
its neighbours', on a bounded sample (``SAMPLE`` documents, by a hash of their text, copies once) whose
tokens are labelled by the base patterns and two patterns of secrets. Defined results: null texts
are empty and have no span; repeated rows are judged alike; an empty table has no rows; texts and tokens of
any length are read whole; extra columns pass through, and added columns whose names are taken get an
underscore.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.llm import words as X
from spanwarden.llm.common import fresh, quoted

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELS = ("none", *KINDS)
SAMPLE = 20_000
SURE = 0.9
ROUNDS = 8
BITS = 14
#: Kinds of links between tokens, each with a table of potentials.
LINKS = ("beside", "apart", "skip")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRETS = (re.compile(r"AKIA[0-9A-Z]{16}"), re.compile(r"(?i)(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{8,})"))
_TOKEN = re.compile(r"\S+")
_EVIDENCE = re.compile(r"[0-9@=]")
_EDGES = "\"'.,;:!?()[]{}<>"
_MARK = np.zeros(256, bool)
_MARK[48:58] = True
_MARK[[ord("@"), ord("=")]] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = _LOCAL.match(text[done:at][::-1])
        after = _DOMAIN.match(text, at + 1)
        if before and after:
            yield at - before.end(), after.end()
            done = after.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def tokens(text: str) -> list[tuple[int, int, int, str]]:
    """(number in the text, start, end, word before) of the cores of tokens with evidence."""
    out = []
    before = ""
    for i, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if _EVIDENCE.search(word):
            left = len(word) - len(word.lstrip(_EDGES))
            core = word.strip(_EDGES)
            said = before
            if "=" in core[:-1]:
                cut = core.index("=") + 1
                said, left, core = core[:cut], left + cut, core[cut:]
            quote = len(core) - len(core.lstrip(_EDGES))
            left, core = left + quote, core.strip(_EDGES)
            if core:
                out.append((i, m.start() + left, m.start() + left + len(core), said.lower().strip(_EDGES + "=")))
        before = word
    return out


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", word))))


def token_features(text: str, start: int, end: int, before: str) -> list[int]:
    core = text[start:end]
    digits = sum(c.isdigit() for c in core)
    upper = sum(c.isupper() for c in core)
    names = ["bias", "shape " + _shape(core), "start " + core[:3].lower(), f"length {min(len(core) // 4, 10)}", f"digits {min(digits, 20)}", f"upper {min(upper // 4, 4)}", f"dots {min(core.count('.'), 4)}", f"at {'@' in core}", f"mixed {digits > 0 and digits < len(core)} {upper > 0}", "before " + before]
    names.extend([f"kind {upper > 0} {any(c.islower() for c in core)} {digits > 0} {min(len(core), 48)}", f"given {text[max(0, start - 1) : start] in ('=', chr(34))}"])
    return sorted({zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names})


def likeness(core: str, before: str) -> list[str]:
    """Keys by which a token is equal or similar to others of its text."""
    low = core.lower()
    out = ["as it is " + low]
    name, at, host = low.partition("@")
    if at:
        out += ["address " + name.partition("+")[0].replace(".", "") + "@" + ".".join(host.split(".")[-2:])]
    plain = re.sub(r"[\W_]+", "", low)
    if plain and plain != low:
        out.append("plain " + plain)
    elif plain:
        out.append("plain " + low)
    if before and any(c.isdigit() for c in core):
        out.append(f"behind {before} {_shape(core)}")
    return out


def weak_labels(text: str, found: list[tuple[int, int, int, str]], base: list[tuple[int, int, int]]) -> list[int]:
    spans = [(s, e, k + 1) for k, s, e in base]
    for pattern in _SECRETS:
        spans += [(m.start(m.lastindex or 0), m.end(m.lastindex or 0), len(BASE) + 1) for m in pattern.finditer(text)]
    return [next((k for s, e, k in spans if s < end and start < e), 0) for _, start, end, _ in found]


def edges(text: str, found: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(beside, apart, skip): neighbours in the text with at most one word between or with more, and of each likeness
    the next token like it (as a whole these links join all that are alike)."""
    step = [(i, i + 1) for i in range(len(found) - 1)]
    beside = [(i, j) for i, j in step if found[j][0] - found[i][0] <= 2]
    last: dict[str, int] = {}
    skip = set()
    for i, (_, s, e, before) in enumerate(found):
        for key in likeness(text[s:e], before):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return beside, [x for x in step if x not in set(beside)], sorted(skip)


def _observed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with evidence: its tokens' features and labels, and its edges."""
    for batch in it:
        out = []
        for text in batch.column("text").to_pylist():
            found = tokens(text or "")
            if found:
                out.append(json.dumps([[token_features(text, s, e, b) for _, s, e, b in found], weak_labels(text, found, base_spans(text)), *edges(text, found)]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["seen"])


def fit(seen: list[str], epochs: int = 6) -> dict:
    """Weights and potentials (logarithms) that make each token's label likely given those of its neighbours.

    Stochastic steps on the pseudo-likelihood, with a little shrinking of the potentials; a step moves the
    weights of a token's features and the potentials of its links together.
    """
    k = len(LABELS)
    weight = np.zeros((1 << BITS, k))
    pairs = {name: np.zeros((k, k)) for name in LINKS}
    rows: list[tuple[np.ndarray, int, list[tuple[str, int]]]] = []
    for line in sorted(seen):
        features, labels, *links = json.loads(line)
        near: list[list[tuple[str, int]]] = [[] for _ in labels]
        for name, each in zip(LINKS, links, strict=True):
            for a, b in each:
                near[a].append((name, labels[b]))
                near[b].append((name, labels[a]))
        rows += [(np.array(f), y, n) for f, y, n in zip(features, labels, near, strict=True)]
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            f, y, near = rows[i]
            z = weight[f].sum(axis=0)
            for name, other in near:
                z = z + pairs[name][other]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            weight[f] -= rate * p
            for name, other in near:
                # potentials have no direction
                pairs[name][other] -= 0.1 * rate * p
                pairs[name][:, other] = pairs[name][other]
        for table in pairs.values():
            table *= 0.98
            np.clip(table, -4, 4, out=table)
    used = np.flatnonzero(np.abs(weight).sum(axis=1) > 1e-6)
    return {"at": used.tolist(), "weight": np.round(weight[used], 5).tolist(), **{name: np.round(table, 5).tolist() for name, table in pairs.items()}}


def _fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = [x for batch in it for x in batch.column("seen").to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(seen))])], names=["model"])


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> str:
    """The model, as JSON."""
    rows = docs.select(F.col(quoted(text)).alias("text"))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / n)).distinct()
    row = rows.mapInArrow(_observed, "seen string").repartition(1).mapInArrow(_fitted, "model string").first()
    return json.dumps(fit([])) if row is None else row["model"]


class Field:
    """A trained field, ready for inference."""

    def __init__(self, model: str):
        m = json.loads(model)
        self.weight = np.zeros((1 << BITS, len(LABELS)))
        if m["at"]:
            self.weight[m["at"]] = m["weight"]
        self.potential = [np.exp(np.array(m[name])) for name in LINKS]

    def marginals(self, text: str, found: list[tuple[int, int, int, str]]) -> np.ndarray:
        """Label marginals of the tokens after rounds of loopy sum-product messages."""
        unary = np.array([self.weight[token_features(text, s, e, b)].sum(axis=0) for _, s, e, b in found])
        return self.passed(unary, edges(text, found))

    def passed(self, unary: np.ndarray, each: tuple[list[tuple[int, int]], ...]) -> np.ndarray:
        local = np.exp(unary - unary.max(axis=1, keepdims=True))
        links = [x for part in each for x in part]
        if links:
            # message i goes along a link, message i + len(links) against it
            a = np.array([x for x, _ in links] + [y for _, y in links])
            b = np.array([y for _, y in links] + [x for x, _ in links])
            n = len(links)
            pot = np.array([table for table, part in zip(self.potential, each, strict=True) for _ in part])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            message = np.ones((2 * n, len(LABELS)))
            for _ in range(ROUNDS):
                belief = np.log(local)
                np.add.at(belief, b, np.log(message))
                out = belief[a] - np.log(message[back])
                new = np.einsum("el,elk->ek", np.exp(out - out.max(axis=1, keepdims=True)), pot)
                message = 0.5 * message + 0.5 * new / new.sum(axis=1, keepdims=True)
            belief = np.log(local)
            np.add.at(belief, b, np.log(message))
            local = np.exp(belief - belief.max(axis=1, keepdims=True))
        return local / local.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans that the field adds."""
        found = tokens(text)
        if not found:
            return []
        out = []
        p = self.marginals(text, found)
        for (_, s, e, _), row in zip(found, p, strict=True):
            k = int(row.argmax())
            if k and row[k] >= SURE and not any(x < e and s < y for _, x, y in base):
                out.append((k - 1, s, e))
        return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _found(it: Iterator[pa.RecordBatch], model: str, text: str, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    field = Field(model)
    empty = hashlib.sha256(b"").hexdigest()
    for batch in it:
        column = batch.column(text)
        raw, bounds, _ = X.buffers(column)
        marked = np.zeros(len(batch), np.int64)
        for i, j, part, b in X.blocks(column):
            marked[i:j] = X.per_doc(_MARK[part], b)
        counts = np.zeros((len(BASE) + 2, len(batch)), np.int64)
        hashes, spans = [empty] * len(batch), [""] * len(batch)
        for i in np.flatnonzero(marked).tolist():
            t = raw[bounds[i] : bounds[i + 1]].tobytes().decode()
            base = base_spans(t)
            for k, _, _ in base:
                counts[k, i] += 1
            hashes[i] = hashlib.sha256(told(base).encode()).hexdigest()
            every = base + field.spans(t, base)
            counts[len(BASE), i], counts[len(BASE) + 1, i] = sum(k >= len(BASE) for k, _, _ in every), len(every)
            spans[i] = told(every)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in counts[: len(BASE)]], pa.array(hashes), pa.array(spans), *[pa.array(c) for c in counts[len(BASE) :]]], names=[*keep, *names])


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None) -> DataFrame:
    """Columns ``keep`` of docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_secret and n_spans (of all)."""
    keep = docs.columns if keep is None else keep
    model = train(docs, text) if model is None else model
    names = [fresh(c, [*keep, text]) for c in (*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_secret", "n_spans")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.StringType() if c in names[4:6] else T.LongType()) for c in names])
    return docs.select(*[quoted(c) for c in dict.fromkeys([*keep, text])]).mapInArrow(partial(_found, model=model, text=text, keep=keep, names=names), schema)
