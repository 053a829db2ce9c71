"""Sources, gates, containers, Go, reports and streaming, on literal inputs."""

import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import audit, binary, detect, files, golang, report, rewriting, scan
from spanwarden.plans.lineage import cut
from spanwarden.plans.shipping import ship
from spanwarden.sources import directory
from spanwarden.streaming import scan as streaming

SCHEMA = "path string, text string"


def units(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_evidence_is_cut_by_bytes(spark):
    line = "// refined with Claude " + "é" * 100
    found = detect.origins(units(spark, a_md=line)).first()
    assert found["evidence"] == ("// refined with Claude " + "é" * 47) + "..." and len(found["evidence"].encode()) == 120
    odd = detect.origins(units(spark, a_md="// refined with Claude. " + "é" * 100)).first()["evidence"]
    assert odd == "// refined with Claude. " + "é" * 46 + "�..."
    stamp = detect.stamps(units(spark, a_md="# Generated with Claude " + "é" * 80)).first()["evidence"]
    assert stamp == "# Generated with Claude " + "é" * 48


def test_the_allowlist_reads_2048_bytes(spark):
    head = "é" * 1020 + "\n"
    allowed = "// Code generated by protoc\n# Generated by Copilot\n"
    assert detect.stamps(units(spark, a_go=head[900:] + allowed)).count() == 0
    assert detect.stamps(units(spark, a_go=head + allowed)).count() == 1


def test_hints_fold_as_the_expressions_do(spark):
    texts = {"a_md": "// ask CLAUDE", "b_md": "// Khat", "c_md": "Aſ an AI model", "d_md": "// github  coPilot", "e_md": "Sure,   here's one"}
    got = rows(detect.origins(units(spark, **texts)), "path", "rule_id")
    assert got == [("a.md", "origin.named.claude"), ("c.md", "origin.style.boilerplate"), ("d.md", "origin.named.copilot"), ("e.md", "origin.style.boilerplate")]


@pytest.mark.parametrize("text, shown", [
    ("a\tb", "a\\tb"), ("x​y", "x<U+200B>y"), ("x y", "x<U+00A0>y"), ("x y", "x<U+2002>y"), ("x️y", "x<U+FE0F>y"), ("x\U000e0041y", "x<U+0E0041>y"),
    ("x؜y", "x<U+061C>y"), ("end  \t", "end  \\t"), ("end  ", "end"), ("é" * 130, "é" * 120 + "..."),
])
def test_snippets(spark, text, shown):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(audit.snippet(df["t"])).first()[0] == shown


def test_enriched(spark):
    u = units(spark, a_md="first\nsecond ​ here\nthird", b_png="x")
    found = audit.merged(audit.with_rules(detect.unicode_marks(u).withColumn("detector_order", F.lit(0))))
    r = audit.enriched(found, u).first()
    assert (r["snippet"], r["symbol"]) == ("second <U+200B> here", "U+200B")


def test_text_detectors_leave_binaries_out(spark):
    u = units(spark, a_md="x​", b_png="x​", c_docx="x​", d_txt="%PDF x​")
    assert rows(detect.detect(u), "path", "rule_id") == [("a.md", "unicode.zwsp")]


def test_containers_by_format(spark):
    mark = '<meta name="generator" content="Claude">'
    u = units(spark, a_html=mark, b_md="---\ntitle: hello\ngenerator: Claude\n- x\n\n# y\nafter: z\n---\nbody", c_txt=mark, d_svg="<svg><!-- jumb --><metadata>jumbf here</metadata></svg>", e_txt=" <svg><!-- claude --></svg>", f_html='<meta name="generator" content="WordPress">')
    got = rows(detect.container_marks(u), "path", "rule_id", "evidence", "replacement")
    assert got == [
        ("a.html", "container.html_meta", mark, ""), ("b.md", "container.md_front_matter", "generator", "---\ntitle: hello\nafter: z\n---\n"),
        ("d.svg", "container.svg_metadata", "<metadata>jumbf here</metadata>", ""), ("e.txt", "container.svg_metadata", "svg comment", ""),
    ]


@pytest.mark.parametrize("needle", ["jumb", "c2ma", "contentauth", "cai:"])
@pytest.mark.parametrize("kind", ["png", "jpeg", "webp", "pdf", "docx", "odt"])
def test_every_container_knows_all_needles(kind, needle):
    assert binary.inspect(f"a.{kind}", binary.sample(kind, f"x {needle} y"))


def test_png_names_count_and_pictures_stay():
    other = b"\x89PNG\r\n\x1a\n" + binary._chunk(b"IHDR", b"\0" * 13) + binary._chunk(b"caIx", b"nothing") + binary._chunk(b"IEND", b"")
    assert binary.inspect("a.png", other) is None
    named = other.replace(binary._chunk(b"caIx", b"nothing"), binary._chunk(b"juMx", b"b jumb"))
    assert binary.inspect("a.png", named)
    kept = other.replace(binary._chunk(b"caIx", b"nothing"), binary._chunk(b"iCCP", b"c2pa"))
    assert binary.inspect("a.png", kept) is None


def test_decode_and_counters(spark):
    data = [("a.go", b"\xef\xbb\xbfx"), ("b.txt", b"\xc3("), ("c.bin", b"a\0b"), ("d.png", b"x"), ("e.odt", b"x"), ("f.txt", b"")]
    df = spark.createDataFrame(data, "path string, content binary")
    got = {r["path"]: r for r in files.decoded(df).collect()}
    assert [got["a.go"][k] for k in ("kind", "language", "charset", "has_bom", "skipped")] == ["text", "go", "utf-8", True, False]
    assert got["b.txt"]["charset"] == "unknown" and got["b.txt"]["text"] == "�(" and got["c.bin"]["skipped"]
    assert tuple(files.counters(files.decoded(df)).first()) == (5, 1, 3, 1, 1)
    assert tuple(files.counters(files.decoded(df, force_text=True)).first()) == (6, 0, 4, 1, 1)


@pytest.mark.parametrize("glob, name, fits", [("a/**", "a", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("[a-c].go", "x/b.go", True), ("[^a].go", "a.go", False), ("\\*.go", "*.go", True), ("\\*.go", "a.go", False)])
def test_more_globs(glob, name, fits):
    import re

    assert bool(re.search(files.glob_pattern(glob).replace(r"\z", r"\Z"), name)) == fits


@pytest.mark.parametrize("hidden", [False, True])
def test_directory_source(spark, tmp_path, hidden):
    ship(spark)
    for name, body in {"a.md": "x​", "sub/b.go": "y", "sub/LICENSE": "z", "node_modules/c.go": "w", ".d.md": "v", "big.md": "x" * 100}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    df = directory.walked(spark, [str(tmp_path)], max_bytes=50, hidden=hidden)
    want = {("a.md", 4), ("sub/b.go", 1)} | ({(".d.md", 1)} if hidden else set())
    assert {(r["rel_path"], r["length"]) for r in df.collect()} == want
    assert {bytes(r["content"]) for r in df.filter("rel_path = 'a.md'").collect()} == {"x​".encode()}
    one = directory.walked(spark, [str(tmp_path / "a.md")], include=("*.md",), hidden=hidden).collect()
    assert [r["rel_path"] for r in one] == ["a.md"]
    with pytest.raises(Exception):
        directory.walked(spark, [str(tmp_path / "none")], hidden=hidden).count()


GO = 'package p\n\n//go:generate stringer\nvar s = "hi​"\nvar t = `\n# Generated with Claude\n`\nfunc scаn() { scan := scаn(\'"\') }\n'


def test_go_sources(spark):
    u = units(spark, a_go=GO, b_go=GO + "}", c_go="no package\nvar s = \"​\"", d_md=GO)
    ship(spark)
    found = scan.scan(u).filter("family <> 'heuristic'")
    got = rows(found, "path", "rule_id", "clean", "reason")
    plain = [("stamp.generated_by_ai", "strip", None), ("unicode.zwsp", "strip", None)]
    assert [x for x in got if x[0] == "a.go"] == [("a.go", "homoglyph.ident", "normalize", None)] * 2 + [("a.go", "unicode.zwsp", "report_only", "string_literal")]
    assert [x[1:] for x in got if x[0] == "b.go"] == plain and [x[1:] for x in got if x[0] == "d.md"] == plain
    assert [x[1:] for x in got if x[0] == "c.go"] == [("unicode.zwsp", "strip", None)]
    marks = golang.identifier_marks(u).filter("path = 'a.go'").collect()
    assert {r["replacement"] for r in marks} == {"scan2"} and sorted((r["line"], r["col"]) for r in marks) == [(8, 6), (8, 23)]
    assert rows(golang.protected(u), "reason") == [("go_generate",), ("string_literal",), ("string_literal",)]


@pytest.mark.parametrize("name, plain", [("scаn", "scan"), ("б", "ident"), ("1а", "x1a"), ("ογx", "oyx")])
def test_ascii_names(name, plain):
    assert golang.ascii_name(name) == plain


def test_agent_without_votes(spark):
    found = audit.merged(audit.with_rules(detect.detect(units(spark, a_md="x​", b_md="Hope this helps"))))
    assert tuple(audit.picked(found).first()) == ("unknown", "unknown (forensic marks)", "likely")
    assert tuple(audit.picked(found.filter("family = 'heuristic'")).first()) == ("generic", "likely AI-generated", "heuristic")
    assert tuple(audit.picked(found.filter("false")).first()) == ("none", "none", "none")


def test_own_messages_win(spark):
    df = spark.createDataFrame([("a", "unicode.zwsp", "", "mine"), ("b", "unicode.zwsp", "report_only", ""), ("c", "no.rule", None, None)], "path string, rule_id string, clean string, message string")
    got = {r["path"]: (r["clean"], r["message"], r["family"]) for r in audit.with_rules(df).collect()}
    assert got == {"a": ("strip", "mine", "unicode"), "b": ("report_only", "Zero-width space (U+200B)", "unicode"), "c": ("strip", "", "unicode")}


def test_reports(spark):
    ship(spark)
    u = units(spark, b_md="x​", a_md="// Co-authored-by: Cursor <c@x.io>\n" + "word " * 80)
    raw, merged = cut(scan.raw(u)), cut(scan.scan(u))
    r = report.report(u, raw, merged, {"scanned": 2, "skipped": 1, "texts": 2, "images": 0, "docs": 0})
    out = {}
    for how in ("", "json", "yml", "sarif"):
        to = io.StringIO()
        report.write(to, how, r)
        out[how] = to.getvalue()
    told = json.loads(out["json"])
    assert [f["span"]["file"] for f in told["findings"]] == ["a.md", "b.md"] and told["score"]["agent"] == "cursor" and told["detector_hits"] == {"stamp": 1, "unicode": 1}
    sarif = json.loads(out["sarif"])["runs"][0]
    assert [x["ruleId"] for x in sarif["results"]] == [x["id"] for x in sarif["tool"]["driver"]["rules"]] == ["stamp.co_authored_by_ai", "unicode.zwsp"]
    assert sarif["results"][1]["message"]["text"] == "symbol U+200B · x<U+200B>" and sarif["results"][1]["locations"][0]["physicalLocation"]["region"]["byteLength"] == 3
    assert "2 files scanned, 1 skipped" in out[""] and "  A      1:2       unicode.zwsp  certain" in out[""] and "likely agent  Cursor" in out[""] and "         a.md" in out[""]
    assert "files_scanned: 2" in out["yml"] and '- ' not in out["yml"].split("findings:")[0].replace("- \"", "") and 'rule_id: "unicode.zwsp"' in out["yml"]
    none = report.report(u, raw.filter("false"), merged.filter("false"), {"scanned": 0, "skipped": 0, "texts": 0, "images": 0, "docs": 0})
    to = io.StringIO()
    report.write(to, "json", none)
    assert json.loads(to.getvalue())["findings"] is None
    with pytest.raises(ValueError):
        report.write(to, "xml", r)


def test_rewriting(spark):
    long = "word " * 100
    u = units(spark, a_md="​" + long, b_go="x = 1 // " + long[:90] + "\n​", c_md=long, d_png="​" + long)
    found = audit.merged(audit.with_rules(detect.unicode_marks(u).withColumn("detector_order", F.lit(0))))
    assert rows(rewriting.planned(u, found), "path", "rule_id", "start", "end") == [("a.md", "statwm.layer_b_prose", 0, 503), ("b.go", "statwm.layer_b_comment", 6, 99)]
    assert rewriting.planned(u, found, force=True).count() == 3
    assert rewriting.strength("Code") == "code" and rewriting.strength("x") == "paraphrase" and rewriting.backend("openai-compatible") == "openai"
    with pytest.raises(ValueError):
        rewriting.strength("x", strict=True)
    replies = spark.createDataFrame([('{"rewrite": "a"}',), ("```go\nb\n```",), (" c ",)], "t string")
    assert [r[0] for r in replies.select(rewriting.answer(replies["t"])).collect()] == ["a", "b", "c"]
    notes = rewriting.comment_texts(units(spark, a_go="/* one two */\n// three\n# x\ny"), 3)
    assert rows(notes, "number", "body") == [(0, "one two"), (1, "three")]


def test_addresses(spark):
    ship(spark)
    assert files.endpoint_allowed("http://127.0.0.1:1/x") and files.endpoint_allowed("https://localhost") and not files.endpoint_allowed("http://x.example") and files.endpoint_allowed("http://x.example", remote=True) and not files.endpoint_allowed("ftp://localhost")
    df = spark.createDataFrame([("8.8.8.8", True), ("10.0.0.1", False), ("::1", False), ("100.64.0.1", True), ("fe80::1", False), ("::ffff:10.0.0.1", False), ("x", False), (None, False)], "a string, want boolean")
    assert df.filter(files.is_public(df["a"]) != df["want"]).count() == 0
    data = spark.createDataFrame([(gzip.compress(b"<a/>"),), (b"<b/>",), (gzip.compress(b"x" * 99),), (b"\x1f\x8bno",)], "d binary")
    assert [r[0] and bytes(r[0]) for r in data.select(files.gunzipped(data["d"], 50)).collect()] == [b"<a/>", b"<b/>", None, None]


def test_streaming_scan(spark, tmp_path):
    ship(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "vendor").mkdir(parents=True)
    (folder / "a.md").write_text("x​")
    (folder / "vendor" / "b.md").write_text("x​")
    streaming.scan(spark, str(folder), str(out)).awaitTermination()
    (folder / "c.md").write_text("# Generated with Claude\n")
    streaming.scan(spark, str(folder), str(out)).awaitTermination()
    got = spark.read.parquet(f"{out}/batch=*")
    assert {(r["path"].rsplit("/", 1)[1], r["rule_id"]) for r in got.collect()} == {("a.md", "unicode.zwsp"), ("c.md", "stamp.generated_by_ai"), ("c.md", "origin.named.claude")}
