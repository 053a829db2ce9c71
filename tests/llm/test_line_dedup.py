"""The whole line dedup query against brute force: ids that are missing or repeated, ties, templates, thresholds by length."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanwarden.llm import line_dedup, queries
from spanwarden.llm.common import cut, sifted

SCHEMA = "doc_id long, text string, row int, at string, _row string"
SMALL = ((0, 2), (60, 3), (80, 4))


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(rows, spark, ladder, short):
    """What each distinct (doc_id, text) gives: (n_lines, n_removed, n_near, n_links, text or None where it is dropped)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id long, text string")
    order = {r["i"]: r["row"] for r in df.select("i", line_dedup._row(df, "doc_id", "text").alias("row")).collect()}
    takes = lambda x: len(x) >= 30 or (short and any(c.isalnum() for c in x))
    places, first = [], {}
    for i, (d, t) in enumerate(rows):
        for at, line in enumerate(t.split("\n") if t is not None else []):
            if takes(line):
                places.append((i, at, line))
                place = (d is None, d or 0, order[i], at)
                first[line] = min(first.get(line, place), place)
    long = sorted(x for x in first if len(x) >= 30)
    links = {x: [] for x in first}
    for j, b in enumerate(long):
        for a in long[:j]:
            t = line_dedup.edits_at(min(len(a), len(b)), ladder)
            if abs(len(a) - len(b)) <= t and apart(a, b) <= t:
                links[a].append(b)
                links[b].append(a)
    near = {x: any(first[y] < first[x] for y in links[x]) for x in first}
    out = []
    for i, (d, t) in enumerate(rows):
        lines = t.split("\n") if t is not None else []
        own = [(at, line) for k, at, line in places if k == i]
        gone = {at for at, line in own if near[line] or first[line] != (d is None, d or 0, order[i], at)}
        left = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        out.append((len(lines), len(gone), sum(near[x] for _, x in own), sum(len(links[x]) for _, x in own), t if not gone else left if left.strip() else None))
    return out


def corpus():
    random.seed(21)
    letters = "abcdefgh é𝒳"
    word = lambda n: "".join(random.choice(letters) for _ in range(n))
    rows = [(1, "A line that stands here first and in others later"), (None, "A line that stands here first and in others later\nThis one stands nowhere else at all"), (None, "Neither does this one stand anywhere\nxyz")]
    rows += [(5, "one of two documents that share an id\nshort"), (5, "the other document that shares the id\nshort"), (5, "the other document that shares the id\nshort")]
    rows += [(6, "\n".join(["the same line many times in one text"] * 7 + ["", "", "--", "--"])), (7, None), (8, ""), (9, "\n\n"), (None, None), (None, "")]
    # templates: a number in a fixed sentence
    rows += [(100 + k, f"the record with the number {k:03d} of the archive has been opened") for k in range(0, 300, 7)]
    for n in (30, 58, 59, 60, 61, 63, 64, 79, 80, 81, 83, 84, 85, 140):
        base = word(n)
        for k in (0, 1, 2, 3, 4, 5):
            b = list(base)
            for j in range(k):
                at = (j + 1) * len(b) // (k + 1)
                b[at : at + random.randint(0, 1)] = random.choice(["", "X", "Y"])
            rows.append((1000 + 10 * n + k, "".join(b) + random.choice(["", "\nshort", "\n" + word(40)])))
    rows += [rows[20], rows[20], rows[0], (3000, "x " * 20_000 + "\n" + rows[0][1])]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("short", [False, True])
def test_counts_and_texts(spark, short):
    rows = corpus()
    want = expected(rows, spark, SMALL, short)
    df = spark.createDataFrame([(*r, 3, "at", "clash") for r in rows], SCHEMA)
    got = sorted(map(str, line_dedup.counted(df, ladder=SMALL, short=short).collect()))
    assert got == sorted(f"Row(doc_id={d}, n_lines={w[0]}, n_removed={w[1]}, n_near={w[2]}, n_links={w[3]})" for (d, _), w in zip(rows, want, strict=True))
    assert sum(w[3] for w in want) > 500 and sum(w[1] for w in want) > 80
    left = line_dedup.without_repeats(df, ladder=SMALL, short=short)
    assert left.columns == df.columns
    stay = sorted((str(d), str(w[4])) for (d, t), w in zip(rows, want, strict=True) if t is None or w[4] is not None)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == stay


@pytest.mark.parametrize("crowd, crowds", [(0, 1000), (0, 0)])
def test_crowded_segments(spark, monkeypatch, crowd, crowds):
    rows = corpus()
    df = spark.createDataFrame([(*r, 3, "at", "clash") for r in rows], SCHEMA)
    want = sorted(map(str, line_dedup.counted(df, ladder=SMALL).collect()))
    monkeypatch.setattr(line_dedup.candidates, "__defaults__", (crowd, crowds))
    assert sorted(map(str, line_dedup.counted(df, ladder=SMALL).collect())) == want


def test_beyond_the_broadcast_limits(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 3, "at", "clash") for r in rows], SCHEMA)
    want = sorted(map(str, line_dedup.counted(df, ladder=SMALL).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.counted(df, ladder=SMALL).collect())) == want


def test_probes_hold_every_pair_within_the_threshold(spark):
    """Each ladder's classes, at their edges: lines one edit too far apart are candidates at most by chance."""
    random.seed(4)
    lines = []
    for n in (357, 358, 359, 360, 361, 363, 364, 476, 478, 480, 482, 484, 485, 700):
        base = [random.choice("abcdefgh ") for _ in range(n)]
        lines.append("".join(base))
        for k in (2, 3, 4):
            b = list(base)
            for j in range(k):
                at = (j + 1) * len(b) // (k + 1)
                b[at : at + random.randint(0, 1)] = random.choice(["", "X"])
            lines.append("".join(b))
    ladder = ((0, 2), (360, 3), (480, 4))
    want = expected([(i, t) for i, t in enumerate(lines)], spark, ladder, False)
    got = line_dedup.counted(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), ladder=ladder).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: w[3] for i, w in enumerate(want)} and sum(w[3] for w in want) > 40


def long_lines(spark):
    """Documents of one long line each, some of them copies or an edit apart; the bytes of their texts."""
    random.seed(6)
    texts = ["".join(random.choices("abcdefghijklmnop ", k=700)) for _ in range(2500)]
    texts += [t[:350] + "X" + t[351:] for t in texts[:250]] + texts[250:300]
    return cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)), sum(map(len, texts))


def dealt(spark, df):
    """The rows, sorted, and the bytes that were shuffled for them."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    rows = sorted(map(str, df().collect()))
    return rows, written() - before


def test_f1_stage_deals_out_no_probe_with_its_text(spark, monkeypatch):
    df, size = long_lines(spark)
    stage = lambda: corpus_pipeline.line_stage(spark, df, "")
    want, _ = dealt(spark, stage)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    got, moved = dealt(spark, stage)
    assert got == want and len(want) == 2500
    assert moved < 3 * size


def test_f2_crowded_lines_deal_out_no_probe_with_its_text(spark, monkeypatch):
    df, size = long_lines(spark)
    count = lambda: line_dedup.counted(df, short=True)
    want, _ = dealt(spark, count)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup.candidates, "__defaults__", (0, 0))
    got, moved = dealt(spark, count)
    assert got == want and sum("n_links=1" in r for r in want) == 500
    assert moved < 3 * size


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_sifted_keeps_every_row_that_is_asked_for(spark, n):
    left = spark.range(-20_000, 20_000).selectExpr("id as h", "'x' as _x", "id % 7 as _words")
    right = cut(spark.range(n).selectExpr("id * 3 as h"))
    got = sifted(left, "h", right, n)
    assert got.columns == left.columns
    kept = [r["h"] for r in got.collect()]
    assert len(kept) == len(set(kept)) and {3 * i for i in range(n) if 3 * i < 20_000} <= set(kept)
    assert len(kept) <= n + 40


def test_f1_query_counts_in_the_texts_that_are_left(spark, monkeypatch, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted((str(d), *w[:4]) for (d, _), w in zip(rows, expected(rows, spark, line_dedup.LADDER, True), strict=True))
    query = lambda: sorted((str(r["doc_id"]), *r[1:]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect())
    assert query() == want
    # the texts are dealt out
    monkeypatch.setattr(line_dedup, "BROADCAST_GONE", 0)
    assert query() == want and any(removed == lines > 0 for _, lines, removed, _, _ in want)
    # where no line is taken out of a text, none is counted
    monkeypatch.setattr(line_dedup, "_left", lambda text, at: F.col(text), raising=False)
    assert query() == [(d, lines, 0, near, links) for d, lines, _, near, links in want]


def test_f1_text_of_many_lines_is_split_once(spark):
    # split for each of its lines it took 27 seconds, else less than one
    lines = [f"{k:07d} stands in this line of the text {k * 7919 % 100_003}" for k in range(20_000)]
    df = cut(spark.createDataFrame([("\n".join(lines), [1, 3, 19_999]), ("a\nb", [0, 1]), ("a\nb", []), ("a\n", [0]), (None, None)], "text string, at array<int>"))
    began = time.monotonic()
    left = [r["left"] for r in df.select(line_dedup._left("text", "at").alias("left")).collect()]
    assert time.monotonic() - began < 12
    assert sorted(map(str, left)) == sorted(map(str, ["\n".join([lines[0], lines[2], *lines[4:-1]]), None, "a\nb", "", None]))
