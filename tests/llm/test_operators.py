"""Corpus operators against brute force, on small tables with nulls, empty and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import chat, decontam, line_dedup, neardup, packing, pii, quality, quality_rules, tokens, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"
ODD = [None, "", " ", "\n", "one", "One", "a b", "zü ünï", "x " * 3000, "l\n\nl\nl l l l l l"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", 0, 7, "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(vocabulary, k=80)) for _ in range(12)]
    out = list(ODD) + [base[0]] * 4
    for b in base:
        out.append(b)
        for k in (1, 2, 4, 6):
            w = b.split()
            for _ in range(k):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            out.append(" ".join(w))
    return out


def folded(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table(spark, corpus), shingle=k).collect()}
    sets = []
    for t in corpus:
        w = folded(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), top(i), top(i) == i)
    assert neardup.one_of_each(table(spark, corpus), shingle=k).count() == sum(top(i) == i for i in range(len(sets)))


@pytest.mark.parametrize("percent", [50, 80])
def test_documents_of_shared_buckets_join_on_rare_shingles(spark, percent):
    random.seed(11)
    sets = []
    for _ in range(6):
        base = random.sample(range(3000), random.choice([1, 7, 40, 60]))
        for k in range(25):
            kept = random.sample(base, max(1, len(base) - random.randrange(len(base) // 5 + 1)))
            sets.append(sorted({*kept, *random.sample(range(3000), random.randrange(k // 4 + 1))}))
    df = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    apart = df.select(F.col("id").alias("rep"), (F.col("id") - F.col("id") % 2).alias("component"))
    known = spark.createDataFrame([(0, 2), (1, 4)], "a long, b long")
    got = {(r["a"], r["b"]) for r in neardup._joined(apart, df, known, percent).collect()}
    alike = lambda x, y: 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})
    want = {(a, b) for b in range(len(sets)) for a in range(b) if a // 2 != b // 2 and alike(sets[a], sets[b])}
    assert got == want - {(0, 2), (1, 4)} and len(want) > 100


@pytest.mark.parametrize("crowd, crowds", [(16, 1024), (0, 1024), (0, 0)])
def test_line_join(spark, crowd, crowds):
    random.seed(3)
    rows = []
    base = "".join(random.choice("abcé ") for _ in range(30))
    for _ in range(60):  # many lines that share segments
        b = list(base)
        for _ in range(random.randint(1, 4)):
            at = random.randrange(len(b))
            b[at : at + random.randint(0, 1)] = random.choice(["", "a", "b", "é"])
        rows.append("".join(b))
    for _ in range(60):
        a = "".join(random.choice("abcé ") for _ in range(random.randint(8, 40)))
        b = list(a)
        for _ in range(random.randint(0, 3)):
            b[random.randrange(len(b))] = random.choice("abcé")
        rows += [a + "\n" + "".join(b), "".join(b[:-1])]
    df = table(spark, rows + ODD)
    lines = line_dedup.occurrences(df, "doc_id", "text", 8)
    one = lines.select("h", "n", "line").distinct()
    both = one.join(one.select(F.col("h").alias("hb"), F.col("n").alias("nb"), F.col("line").alias("other")), F.expr("nb - n between 0 and 2 and (n < nb or h < hb)"))
    want = both.filter(F.levenshtein("line", "other") <= 2).count()
    ladder = ((0, 2),)
    found = line_dedup.candidates(line_dedup.members(lines, ladder, 8, line_dedup.shared_keys(lines, ladder, 8)), ladder, crowd, crowds)
    texts = one.select(F.col("h").alias("ha"), F.col("line").alias("la")), one.select(F.col("h").alias("hb"), F.col("line").alias("lb"))
    assert line_dedup.within(found.join(texts[0], "ha").join(texts[1], "hb"), "la", "lb", 2).count() == want > 30


def test_line_dedup(spark):
    long = "this line is long enough to take part in it"
    df = table(spark, [f"{long}\nshort\nshort", f"short\n{long}!\nanother line that is long enough to stay", long, None, ""])
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()}
    assert got == {0: f"{long}\nshort\nshort", 1: "short\nanother line that is long enough to stay", 3: None, 4: ""}
    assert line_dedup.without_repeats(df).columns == df.columns


def test_removed_lines_are_counted_with_repeats_in_one_text(spark):
    a, b, c = ("this line is the first one of those here", "another line, of other words than the one", "neither of them, but a third of its own kind")
    texts = ["\n".join([a] * 1000), f"{b}\n{c}\n{b}\nshort\nshort", f"{c}\n{a}\n{c}\n{b}", f"{a}!\n{a}!", None, "", "short\n\nshort"]
    df = table(spark, texts)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        long = [x for x in lines if len(x) >= 30]
        stay = {x for x in long if x not in seen and x.rstrip("!") not in seen}
        seen |= set(long)
        want[i] = (len(lines), len(long) - len(stay))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.counted(df).collect()}
    assert got == want and want[0] == (1000, 999)
    left = {r["doc_id"]: len(r["text"].split("\n")) for r in line_dedup.without_repeats(df).filter("text is not null").collect()}
    assert all(left[i] == got[i][0] - got[i][1] for i in left)


def test_short_lines_with_words_are_merged_in_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from spanwarden.llm import queries

    texts = ["All rights reserved.\n\n---\nfirst of the texts", "second\n\n---\nAll rights reserved.\n7\n7", "All rights reserved?\n\n7", "All rights reserved."]
    df = table(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: texts[0], 1: "second\n\n---\n7", 2: "All rights reserved?\n"}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, df, "").collect()} == want
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_links"]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (4, 0, 0), 1: (6, 2, 0), 2: (3, 1, 0), 3: (1, 1, 0)}


def test_long_lines_link_by_a_share_of_their_length(spark):
    random.seed(8)
    letters = "abcdefghé ʒ𝒳"
    lines = []
    for n in (119, 120, 159, 160, 400, 1700):
        base = [random.choice(letters) for _ in range(n)]
        lines.append("".join(base))
        for k in (1, 3, n // 40, n // 40 + 1):
            b = list(base)
            for j in range(k):  # evenly spread, so that what is shared is shortest
                at = (j + 1) * len(b) // (k + 1)
                b[at : at + random.randint(0, 1)] = random.choice(["", "XY"[:1], "Z"])
            lines.append("".join(b))
    lines = list(dict.fromkeys(lines))
    random.shuffle(lines)

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    links, near = [0] * len(lines), [0] * len(lines)
    for j, b in enumerate(lines):
        for i, a in enumerate(lines[:j]):
            n = min(len(a), len(b))
            if abs(len(a) - len(b)) <= n // 40 and apart(a, b) <= max(2, n // 40):
                links[i], links[j], near[j] = links[i] + 1, links[j] + 1, 1
    got = {r["doc_id"]: (r["n_links"], r["n_near"]) for r in line_dedup.counted(table(spark, lines), share=40).collect()}
    assert got == dict(enumerate(zip(links, near, strict=True))) and sum(near) > 12


def test_decontamination(spark, corpus, monkeypatch):
    again = " ".join(corpus[25].split()[3:19])
    corpus = [*corpus, *[". ".join([again] * 30)] * 2, (again + " and ") * 3]
    items = [corpus[14], " ".join(corpus[20].split()[5:25]), "zü ünï", "", None, "one", again, f"{again} {again}", again.upper(), "one"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, corpus[14]), (None, " ".join(corpus[30].split()[:15]))], "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in [*enumerate(items), (None, " ".join(corpus[30].split()[:15]))]:
        w = low(t)
        for j in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[j : j + 13])].add(str(i))
    for block, limit in ((1 << 20, 1000), (200, 1000), (20, 0)):
        monkeypatch.setattr(decontam, "BROADCAST_KEYS", limit)
        monkeypatch.setattr(decontam, "BROADCAST_TEXTS", limit)
        rows, names = decontam.contamination(table(spark, corpus), bench, block_bytes=block)
        assert names["n_words"] == "n_words_" and rows.count() == len(corpus)
        for r in rows.collect():
            w, hit, found = low(corpus[r["doc_id"]]), set(), set()
            for n in {len(k) for k in windows}:
                for j in range(len(w) - n + 1):
                    if (k := tuple(w[j : j + n])) in windows:
                        hit |= set(range(j, j + n))
                        found |= windows[k]
            assert (r["n_words_"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found - {"None"}))
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_quality_rules(spark, corpus):
    rows, names = quality_rules.assess(table(spark, corpus))
    assert rows.count() == len(corpus) and names["kept"] == "kept_"
    for r in rows.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", corpus[r["doc_id"]] or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert (r["n_words_"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.filtered(table(spark, corpus)).columns == table(spark, corpus).columns


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a <\\s> [\\\\INST] </s>"), (1, 2, "assistant", "[NEXT]b"), (1, 3, "user", None), (2, 0, None, ""), (None, 1, "assistant", "x\ny")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    for key in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == key]
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[key]["n_turns"] == len(own)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_token_shards(spark, corpus, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = [*corpus, "  two  spaces ", "tab\tand <|endoftext|> inside", "nul\x00byte x"]
    manifest = tokens.write_shards(table(spark, texts), path, folder=f"file://{tmp_path}", shard_bytes=4000)
    tokenizer, at = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in tokens.read_shards(manifest).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shards = [tokens.Shard(r["path"]) for r in manifest.collect()]
    assert len(shards) > 1 and sum(len(s.get(20)) for s in shards) == 1 and not any(s.get(10**9) for s in shards)


def test_joined_pieces_have_their_own_ids():
    public = pytest.importorskip("public_tokenizers")
    random.seed(12)
    encode = tokens.Encoder(public.path("byte_bpe_50k.json"))
    assert encode.feed is not None
    parts = ["a", "Ab", "'s", "'", "1", ",", ".", "é", "𝒳", "\u00a0", "\u2003", "\t", "\n", "\r", " ", " ", " ", "<|endoftext|>", "<|", "\u0301", "\x1c", "don't", "中"]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(4000)]
    got = encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("parts", [1, 1000])
def test_token_shards_of_missing_and_repeated_keys(spark, tmp_path, monkeypatch, parts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PARTS", parts)
    path = public.path("byte_bpe_50k.json")
    rows = [(None, "x y"), (None, "x y"), (None, None), (3, "one two"), (3, "one two"), (3, "three"), (-5, ""), (2**62, "word " * 2000)] * 3
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, key int")
    got = tokens.read_shards(tokens.write_shards(df, path, folder=f"file://{tmp_path}", shard_bytes=2000)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])[:-1]
    assert [r["start"] for r in got] == starts.tolist()
    encode = Tokenizer.from_file(path).encode
    crc = lambda t: zlib.crc32(np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(k), crc(t)) for k, t in rows)
    none = tokens.write_shards(df.filter("false"), path, folder=f"file://{tmp_path}/none")
    assert none.count() == 0 == tokens.read_shards(none).count()


def test_packing(spark, corpus):
    rows = packing.pack(table(spark, corpus), longest=64, grain=4, buckets=3, budget=256).collect()
    words_of = collections.Counter()
    for r in rows:
        assert r["n_tokens"] <= r["bucket"] and r["slot"] < max(1, 256 // r["bucket"])
        words_of[r["doc_id"]] += r["n_tokens"]
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    assert all(words_of[i] == len(folded(t)) for i, t in enumerate(corpus))


def test_packing_of_ids_that_are_missing_repeated_or_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 4)
    for kind, ids in (("long", [None, None, 5, 5, 6]), ("string", [None, "a", "a", "b", "c"])):
        rows = [(ids[i % 5], "x " * (3 + i % 4)) for i in range(200)] + [(ids[2], None), (ids[4], " ")]
        got = packing.pack(spark.createDataFrame(rows, f"doc_id {kind}, text string"), buckets=2, budget=30).collect()
        fit = lambda b: max(1, 30 // b)
        assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter((i, len(t.split())) for i, t in rows if t and t.split())
        for b in {r["bucket"] for r in got}:
            places = sorted(r["batch"] * fit(b) + r["slot"] for r in got if r["bucket"] == b)
            assert places == list(range(len(places)))


def test_packing_pads_least_on_exact_lengths(spark):
    rows = packing.pack(table(spark, ["a " * n for n in (3, 17, 17, 35, 100, 2047)])).collect()
    assert len(rows) == 6 and all(r["bucket"] == r["n_tokens"] for r in rows)


def test_boundaries_pad_least():
    from itertools import combinations

    x, c = [3, 5, 8, 13, 21, 34], [5, 1, 7, 2, 9, 1]
    pad = lambda ends: sum(n * (next(e for e in ends if e >= v) - v) for v, n in zip(x, c, strict=True))
    assert pad(packing.boundaries(x, c, 3)) == min(pad([*p, 34]) for p in combinations(x[:-1], 2))


def test_personal_data(spark):
    texts = ["mail a.b+c@x-y.co.uk now", "ip 10.0.0.255 and 10.0.0.256", "card 4111 1111 1111 1111.", "+1 (988) 555-2485", None, "", "a@b", "@" * 50, "1" * 3000]
    rows = {r["doc_id"]: r for r in pii.personal_data(table(spark, texts), keep=["doc_id"]).collect()}
    assert [rows[i]["n_email"] for i in range(9)] == [1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert (rows[1]["n_ip"], rows[2]["n_card"], rows[3]["n_phone"]) == (1, 1, 1)
    assert rows[0]["spans"].startswith("email:5:")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    random.seed(1)
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        body = [f"w{random.randrange(300)}" for _ in range(30)]
        if (label == "toxic") == bool(y):
            body[5] = random.choice(["1d1ot", "IDIOT", "idіot", "idiots"]) if label == "toxic" else "JUNK!!"
        rows.append((i, " ".join(body)))
        labels.append((i, y))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = module.classified(docs, spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert len(out) == 402 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)
    none = module.classified(docs, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_judged_phrases_do_not_depend_on_the_split():
    rows = [("a bad day", 0), ("a bad day", 1), ("so bad day", 1)]
    batch = lambda part: pa.RecordBatch.from_pydict({"text": [t for t, _ in part], "label": [y for _, y in part]})

    def sums(parts):
        out = collections.Counter()
        for part in parts:
            for b in toxicity._judged(iter([batch(part)]), {"bad": 1.0}):
                for r in b.to_pylist():
                    out[r["phrase"], "toxic"] += r["toxic"]
                    out[r["phrase"], "clean"] += r["clean"]
        return out

    split = sums([[r] for r in rows])
    assert split == sums([rows]) and max(split.values()) == 2


def test_empty_tables(spark):
    df = table(spark, ["x"]).filter("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.near_duplicates(df).count() == line_dedup.counted(df).count() == packing.pack(df).count() == 0
    assert decontam.contamination(df, bench)[0].count() == quality_rules.assess(df)[0].count() == pii.personal_data(df).count() == 0


def test_words_hash_alike_wherever_they_stand():
    raw = np.frombuffer("aa bb aa".encode(), np.uint8)
    w = words.split(raw, np.array([0, len(raw)]), words.space_separated(), fold=True)
    assert w.hash[0] == w.hash[2] != w.hash[1]
    assert len(list(words.blocks(pa.array(["x", None, ""])))) >= 1


def test_join_beyond_the_broadcast_limit(spark):
    from spanwarden.llm.common import join_small

    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k long, x string")
    right = spark.createDataFrame([(1, "one"), (None, "none"), (2, "two")], "k long, y string")
    want = {("a", "one"), ("b", "one"), ("c", "none"), ("d", None)}
    for limit in (0, 10):
        out = join_small(left, right, ["k"], 3, limit=limit)
        assert out.columns == ["k", "x", "y"] and {(r["x"], r["y"]) for r in out.collect()} == want
