"""The front, and sitemaps from stored bodies."""

import gzip
import io
import json

import pytest

from spanwarden.api import Scan
from spanwarden.operators import binary
from spanwarden.sources import sitemap


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("x​y\n// Co-authored-by: Cursor <c@x.io>\nz\n")
    (tmp_path / "b.png").write_bytes(binary.sample("png", "Generated by Claude"))
    (tmp_path / "c.bin").write_bytes(b"a\0b\xe2\x80\x8b")
    (tmp_path / "d.go").write_text('package p\nvar s = "​"\n')
    scan = Scan.of_folder(spark, str(tmp_path))
    got = sorted((r["path"].rsplit("/", 1)[1], r["rule_id"], r["clean"]) for r in scan.findings.filter("family <> 'heuristic'").collect())
    assert got == [("a.md", "stamp.co_authored_by_ai", "strip"), ("a.md", "unicode.zwsp", "strip"), ("b.png", "container.png_metadata", "strip"), ("d.go", "unicode.zwsp", "report_only")]
    out = io.StringIO()
    scan.write(out, "json")
    told = json.loads(out.getvalue())
    assert (told["files_scanned"], told["files_skipped"], told["image_files"]) == (3, 1, 1) and told["detector_hits"]["container"] == 1
    assert scan.fails("certain") and not scan.fails("none")
    cleaned = {r["path"].rsplit("/", 1)[1]: (bytes(r["content"]), r["changed"]) for r in scan.cleaned().collect()}
    assert cleaned["a.md"] == (b"xy\nz\n", True) and cleaned["d.go"][1] is False and cleaned["b.png"][1]
    left = scan.after().findings.filter("clean <> 'report_only'")
    assert left.count() == 0
    assert (tmp_path / "a.md").read_text().startswith("x​")
    forced = Scan.of_folder(spark, str(tmp_path / "c.bin"), force_text=True)
    assert [r["rule_id"] for r in forced.findings.collect()] == ["unicode.zwsp"]


def test_disabled_rules(spark):
    df = spark.createDataFrame([("a.md", "x​ ")], "path string, text string")
    assert [r["rule_id"] for r in Scan.of_texts(df, disabled=("unicode.zwsp",)).findings.collect()] == ["unicode.nbsp"]


def site(spark, **bodies):
    urls = {k.replace("__", "/").replace("_", "."): v for k, v in bodies.items()}
    return spark.createDataFrame([(f"https://h.example/{k}", v if isinstance(v, bytes) else v.encode()) for k, v in urls.items()], "url string, content binary")


def locs(*paths, tag="urlset"):
    return f"<{tag}>" + "".join(f"<x><loc> https://h.example/{p} </loc></x>" for p in paths) + f"</{tag}>"


def test_sitemaps(spark):
    plain = site(spark, sitemap_xml=locs("m1.xml", "m2.xml", "sitemap.xml", tag="sitemapindex"), m1_xml=gzip.compress(locs("a", "b").encode()), m2_xml=locs("b", "c"))
    assert [(r["url"][18:], r["level"]) for r in sitemap.collected(plain, "https://h.example").collect()] == [("a", 1), ("b", 1), ("c", 1)]
    assert sitemap.collected(plain, "https://h.example", most=2).count() == 2
    robots = site(spark, robots_txt="User-agent: *\nSitemap: https://h.example/own.xml\n", own_xml=locs("d"))
    assert [r["url"] for r in sitemap.collected(robots, "https://h.example").collect()] == ["https://h.example/d"]
    named = sitemap.collected(robots, "https://h.example", sitemap="https://h.example/own.xml")
    assert named.count() == 1
    with pytest.raises(ValueError):
        sitemap.collected(site(spark, sitemap_xml="<urlset><url><loc>https://other.example/</loc></url></urlset>"), "https://h.example")
