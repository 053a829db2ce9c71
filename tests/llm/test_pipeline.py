"""The pipeline's run() against plain Python, stage by stage, and the verdicts that it rests on."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from spanwarden.llm import line_dedup, packing, quality, quality_rules, toxicity
from tests_llm_brute import components, levenshtein, low_words, plain_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_corpus():
    random.seed(31)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 8))) for _ in range(600)]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    lines = lambda: "\n".join(text(random.randint(8, 20)) for _ in range(random.randint(2, 5)))
    bench = [text(30) for _ in range(6)] + [text(5), None]
    texts = [lines() for _ in range(60)]
    shared = text(15)
    texts += [f"{lines()}\n{shared}" for _ in range(8)] + [f"{lines()}\n{shared[:-1]}" for _ in range(3)] + [f"{lines()}\nAll rights reserved." for _ in range(5)]
    copied = " ".join(text(60).split())
    texts += [copied, copied + " " + vocabulary[3], copied.replace(" ", "  "), copied]
    texts += [f"{text(40)} {bench[k]} {text(20)}" for k in range(4)] + [bench[6], f"{text(12)} {bench[6]}"]
    texts += [None, "", "one two", "\n\n", "go away " * 30, "# $ % & | < > " * 20 + text(40)]
    rows = [(i if i % 17 else None, t, "en" if i % 3 else None, f"s{i % 2}", 1) for i, t in enumerate(texts)]
    return rows + [(7, lines(), "en", "s0", 1), (7, lines(), "en", "s0", 1), rows[5]], bench


def measured(t):
    w = plain_words(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = (t or "").split("\n")
    seen, repeated = set(), 0
    for x in lines:
        if plain_words(x):
            repeated += x in seen
            seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": repeated, "n_repeat_words": len(covered), "n_lines": len(lines)}


def cell(v):
    shift = max(v.bit_length() - 6, 0)
    return (v >> shift) << shift


def quartile(values, share):
    """The least value that so many fourths of all do not exceed."""
    values = sorted(values)
    return next(v for i, v in enumerate(values, 1) if i * 4 >= len(values) * share and (i == len(values) or values[i] != v))


def quality_verdicts(rows, min_group=quality_rules.MIN_GROUP):
    counts = [measured(r[1]) for r in rows]
    out = [not (c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]) for c in counts]
    for top, bottom, scale, least, both in quality_rules.RATIOS.values():
        ratio = [c[top] * scale // max(c[bottom], 1) for c in counts]
        groups = collections.defaultdict(list)
        for r, c, x in zip(rows, counts, ratio, strict=True):
            if c["n_words"]:
                for key in ((r[2], r[3]), r[2:3], ()):
                    groups[key].append(cell(x))
        for i, (r, x) in enumerate(zip(rows, ratio, strict=True)):
            own = next((g for k in ((r[2], r[3]), r[2:3]) if len(g := groups.get(k, [])) >= min_group), groups[()])
            q1, q3 = quartile(own, 1), quartile(own, 3)
            spread = max(q3 - q1, least) * quality_rules.FENCE
            out[i] = out[i] and not (x > q3 + spread or (both and x < q1 - spread))
    return counts, out


@pytest.mark.parametrize("min_group, keep", [(200, None), (20, None), (200, ["doc_id"]), (20, ["doc_id"])])
def test_quality_counts_thresholds_and_verdicts(spark, min_group, keep):
    rows, _ = make_corpus()
    rows += [(900 + i, " ".join(["word"] * 3 + [f"w{j}" * (1 + i % 9) for j in range(20)]) + " #" * (i % 4) * i, "en", "s1", 1) for i in range(60)]
    got, names = quality_rules.assess(spark.createDataFrame(rows, SCHEMA), min_group=min_group, keep=keep)
    counts, kept = quality_verdicts(rows, min_group)
    want = collections.Counter((str(r[0]), *c.values(), k) for r, c, k in zip(rows, counts, kept, strict=True))
    assert collections.Counter((str(r["doc_id"]), *(r[names[c]] for c in counts[0]), r[names["kept"]]) for r in got.collect()) == want
    assert sum(kept) not in (0, len(kept))


def run_plainly(spark, rows, bench):
    """What each stage leaves: lists of (doc_id, text)."""
    stage = [(r[0], r[1]) for r, k in zip(rows, quality_verdicts(rows)[1], strict=True) if k]
    yield stage
    # line dedup: places ordered by id, row hash and position
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(stage)], "i int, doc_id long, text string")
    order = {r["i"]: r["row"] for r in df.select("i", line_dedup._row(df, "doc_id", "text").alias("row")).collect()}
    first = {}
    takes = lambda x: len(x) >= 30 or any(c.isalnum() for c in x)
    at = lambda i, n: (stage[i][0] is None, stage[i][0] or 0, order[i], n)
    for i, (_, t) in enumerate(stage):
        for n, x in enumerate(t.split("\n")):
            if takes(x):
                first[x] = min(first.get(x, at(i, n)), at(i, n))
    long = [x for x in first if len(x) >= 30]
    near = {b for b in long for a in long if a != b and abs(len(a) - len(b)) <= 2 and first[a] < first[b] and levenshtein(a, b) <= 2}
    left = []
    for i, (d, t) in enumerate(stage):
        lines = t.split("\n")
        keep = [x for n, x in enumerate(lines) if not takes(x) or (x not in near and first[x] == at(i, n))]
        if len(keep) == len(lines) or "".join(keep).strip():
            left.append((d, "\n".join(keep)))
    stage = left
    yield stage
    sets = []
    for _, t in stage:
        w = low_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = components(len(stage), [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(stage)], "i int, doc_id long, text string")
    order = {r["i"]: r["row"] for r in df.select("i", line_dedup._row(df, "doc_id", "text").alias("row")).collect()}
    best = {}
    for i, (d, _) in enumerate(stage):
        place = (d is None, d or 0, order[i], i)
        best[top[i]] = min(best.get(top[i], place), place)
    stage = [r for i, r in enumerate(stage) if not sets[i] or best[top[i]][3] == i]
    yield stage
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[j : j + 13]) for t in bench if (w := words(t)) for j in range(max(len(w) - 12, 1))}
    clean = []
    for d, t in stage:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    yield clean


def test_run_against_plain_stages(spark, tmp_path):
    rows, bench = make_corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = lambda found: sorted((str(d), t) for d, t in found)
    before = len(rows)
    for (name, stage), want in zip(corpus_pipeline.STAGES, run_plainly(spark, rows, bench), strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        assert told((r["doc_id"], r["text"]) for r in docs.collect()) == told(want), name
        assert len(want) < before or name == "line_dedup", name
        before = len(want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = collections.Counter((str(d), min(packing.LONGEST, len(plain_words(t)) - k)) for d, t in want for k in range(0, len(plain_words(t)), packing.LONGEST))
    assert collections.Counter((str(r["doc_id"]), r["n_tokens"]) for r in packed) == pieces
    lengths = collections.Counter(r["n_tokens"] for r in packed)
    ends = packing.boundaries(sorted(lengths), [lengths[n] for n in sorted(lengths)], packing.BUCKETS)
    for r in packed:
        assert r["bucket"] == next(e for e in ends if e >= r["n_tokens"])
    for b in ends:
        fit = max(1, packing.BUDGET // b)
        assert sorted(r["batch"] * fit + r["slot"] for r in packed if r["bucket"] == b) == list(range(sum(r["bucket"] == b for r in packed)))


def test_an_empty_corpus_runs_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dual_descent_reaches_the_optimum():
    """The fitted weights against a projected-gradient solution of the same dual problem."""
    rng = np.random.default_rng(5)
    ratio = rng.normal(size=40)
    rows = [np.sort(rng.choice(40, size=rng.integers(1, 12), replace=False)) for _ in range(60)]
    sign = np.where(rng.random(60) < 0.5, -1.0, 1.0)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = ratio[r], 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = (sign[:, None] * x) @ (sign[:, None] * x).T + np.eye(60) * 0
    alpha = np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha - 0.02 * (g @ alpha - 1), 0, 1.0)
    best = 0.5 * alpha @ g @ alpha - alpha.sum()
    weight, bias = quality.descend(rows, sign, ratio, c=1.0, epochs=3000)
    w = np.append(weight, bias)
    primal = 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    assert abs(primal + best) < 1e-2 * max(1, abs(best))


def test_lexicon_totals_against_plain_search():
    rng = random.Random(8)
    entries = {" " + w: rng.uniform(1, 3) for w in ("idio", "idiot", "scum", "trash")} | {" bad ": 1.5, " trash ": 4.0}
    exceptions = {"trash can", "bad", "not bad"}
    automaton = toxicity._automaton(entries)
    for _ in range(300):
        text = toxicity.folded(" ".join(rng.choices(["1d1ot", "idiots", "scum", "trash", "can", "bad", "not", "good", "TRASHY", "ѕcum"], k=rng.randint(0, 9))))
        words, want = text.split(), 0.0
        for i, w in enumerate(words):
            fits = [v for k, v in entries.items() if f" {w} ".startswith(k)]
            phrases = {w, f"{words[i - 1] if i else ''} {w}", f"{w} {words[i + 1] if i + 1 < len(words) else ''}"}
            if fits and not phrases & exceptions:
                want += max(fits)
        assert toxicity.total(text, automaton, exceptions) == pytest.approx(want / np.log2(4 + text.count(" ")))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_tables(spark, module, label):
    rows = [(i, f"some idiot text {i % 5} number {i}", 0.25) for i in range(60)] + [(3, "some idiot text 3 number 3", 0.5), (None, "x", 0.1), (100, None, 0.1), (101, "", 0.1), (102, "word " * 50_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 0)], f"doc_id long, {label} int")
    model = module.train(docs, labels)
    out = module.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "score_"] and out.count() == len(rows)
    got = collections.defaultdict(set)
    for r in out.collect():
        assert 0 <= r["score_"] <= 1
        got[r["text"] or ""].add(r["score_"])
    assert all(len(v) == 1 for v in got.values())
    assert module.classified(docs.filter("false"), labels).count() == 0
