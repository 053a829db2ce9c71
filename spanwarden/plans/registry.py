"""The registered audit queries; their SQL is in ``oracles``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwarden.functions.catalog import FALLBACK, rules
from spanwarden.operators import audit, binary, detect, files, rewriting
from spanwarden.operators import scan as scanning
from spanwarden.plans.oracles import ORACLES
from spanwarden.plans.shipping import ship
from spanwarden.sources.marked import marked_documents, marked_pages

COLUMNS = ("path", "rule_id", "start", "end", "evidence")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_documents(spark, sf_dir).select("path", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_pages(spark, sf_dir).select("path", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the marked documents, with rules, merged."""
    return audit.merged(audit.with_rules(detect.detect(docs(spark, sf_dir))))


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = docs(spark, sf_dir).unionByName(pages(spark, sf_dir))
    found = audit.with_rules(detect.detect(both, containers=True))
    return found.groupBy("rule_id", "family", "severity").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))


def rule_catalog(spark, sf_dir):
    return rules(spark)


def rule_explain(spark, sf_dir):
    asked = spark.createDataFrame([("unicode.zwsp",), ("unicode.bidi",), ("no.such.rule",)], "asked string")
    spec = rules(spark)
    df = asked.join(F.broadcast(spec), F.col("asked") == F.col("id"), "left")
    return df.select("asked", F.col("id").isNotNull().alias("known"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("family", "severity", "confidence", "clean"), FALLBACK, strict=False)])


def _paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folders = ("src", ".git", "vendor/x", "docs/deep", "testdata/a/b")
    folder = reduce(lambda acc, x: F.when(F.col("doc_id") % 5 == x[0], x[1]).otherwise(acc), enumerate(folders), F.lit(""))
    names = ("LICENSE", "go.sum", "a_test.go", "main.go", "note.md", "license.txt", "x.YAML")
    name = reduce(lambda acc, x: F.when(F.col("doc_id") % 7 == x[0], x[1]).otherwise(acc), enumerate(names), F.lit(""))
    return d.select(F.concat_ws("/", folder, F.col("doc_id").cast("string"), name).alias("rel_path"), (F.col("n_chars") * 1000).alias("length"))


def walk_filter(spark, sf_dir):
    return files.walked(_paths(spark, sf_dir), ("**/*.go", "*.md", "testdata/**"), ("*_test.go",)).select("rel_path", "length")


def classify_language(spark, sf_dir):
    return docs(spark, sf_dir).select("path", files.language(F.col("path")).alias("language"))


def classify_kind(spark, sf_dir):
    df = marked_documents(spark, sf_dir)
    data = F.encode(F.concat(F.when(F.col("doc_id") % 4 == 1, "%PDF-1.4").otherwise(F.lit("")), "text"), "UTF-8")
    data = F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit(b"\x00"), data)).when(F.col("doc_id") % 4 == 3, F.concat(F.lit(b"\xff\xd8"), data)).otherwise(data)
    return df.select("path", files.kind(F.col("path"), data).alias("kind"))


def comment_regions(spark, sf_dir):
    return detect.comments(docs(spark, sf_dir)).select("path", F.col("number").cast("long").alias("number"), "region", F.col("region_offset").cast("long").alias("region_offset"))


def _of(detector, source=docs, **options):
    return lambda spark, sf_dir: detector(source(spark, sf_dir), **options).select(*COLUMNS)


def unicode_cleaning(spark, sf_dir):
    return audit.with_rules(detect.unicode_marks(docs(spark, sf_dir))).groupBy("rule_id", "clean", "replacement").agg(F.count("*").alias("n"))


def finding_positions(spark, sf_dir):
    return detect.unicode_marks(docs(spark, sf_dir)).select("path", "rule_id", "start", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


def svg_findings(spark, sf_dir):
    """Pages' markup behind marks of SVG files."""
    mark = "case page_id % 5 when 0 then '<svg><metadata>made by OpenAI</metadata></svg>' when 1 then '<svg><!-- claude --></svg>' when 2 then '<svg generator=\"Midjourney\"></svg>' when 3 then '<svg generator=\"Midjourney\"><!-- gemini --></svg>' else '<svg><metadata>plain</metadata></svg>' end"
    return detect.svg_marks(table(spark, sf_dir, "pages").select(F.expr("concat('p/', cast(page_id as string), '.svg')").alias("path"), F.concat(F.expr(mark), F.col("html")).alias("text"))).select(*COLUMNS)


def front_matter_keys(spark, sf_dir):
    return detect.front_matter(docs(spark, sf_dir)).select("path", F.array_join("kept", "\n").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


def merge_dedup(spark, sf_dir):
    df = audit.with_rules(detect.detect(docs(spark, sf_dir)))
    twice = df.unionByName(df.withColumn("detector_order", F.col("detector_order") + 10))
    return audit.merged(twice, disabled=("unicode.nbsp",)).select("path", "start", "end", "rule_id", F.col("detector_order").cast("long").alias("detector_order"))


def merge_protect(spark, sf_dir):
    df = audit.with_rules(detect.detect(docs(spark, sf_dir)))
    protect = docs(spark, sf_dir).select("path", F.lit(3).alias("p_start"), F.lit(9).alias("p_end"), F.lit("string").alias("reason"), F.lit(0).alias("p_order"))
    return audit.merged(df, protect).select("path", "start", "end", "rule_id", "clean", "protected", "reason")


def detector_hits(spark, sf_dir):
    return audit.detector_hits(detect.detect(docs(spark, sf_dir)))


def layer_counts(spark, sf_dir):
    """Raw hits of detectors by layer."""
    return audit.layer_counts(detect.detect(docs(spark, sf_dir), containers=True))


def layer_tags(spark, sf_dir):
    """Merged findings by the layer that their rule tells."""
    found = audit.merged(audit.with_rules(detect.detect(docs(spark, sf_dir), containers=True)))
    return found.groupBy(audit.layer().alias("layer")).agg(F.count("*").alias("n"))


def container_dispatch(spark, sf_dir):
    both = docs(spark, sf_dir).unionByName(pages(spark, sf_dir))
    return detect.container_marks(both).select(*COLUMNS, "replacement")


def score_evidence(spark, sf_dir):
    return audit.told(findings(spark, sf_dir))


def score_agent_fallback(spark, sf_dir):
    """Agents where nothing names one: by marks alone, by mentions' family alone, by nothing."""
    found = findings(spark, sf_dir)
    parts = (("marks", found.filter("family = 'unicode'")), ("mentions", found.filter("rule_id = 'origin.style.boilerplate'")), ("nothing", found.filter("false")))
    return reduce(DataFrame.unionByName, [audit.picked(df).withColumn("given", F.lit(name)) for name, df in parts])


def _binary_units(spark, sf_dir):
    df = marked_documents(spark, sf_dir)
    data = F.encode("text", "UTF-8")
    data = F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit(b"\x00"), data)).when(F.col("doc_id") % 7 == 3, F.concat(F.lit(b"\xef\xbb\xbf"), data)).when(F.col("doc_id") % 7 == 4, F.concat(F.lit(b"\xc3("), data)).otherwise(data)
    return df.select("path", data.alias("content"))


def decode_units(spark, sf_dir):
    return files.decoded(_binary_units(spark, sf_dir)).select("path", "kind", "language", "charset", "has_bom", "skipped")


def file_counters(spark, sf_dir):
    return files.counters(files.decoded(_binary_units(spark, sf_dir)))


def file_counters_forced(spark, sf_dir):
    return files.counters(files.decoded(_binary_units(spark, sf_dir), force_kind="container", force_text=True))


def finding_snippets(spark, sf_dir):
    units = docs(spark, sf_dir)
    return audit.enriched(findings(spark, sf_dir), units).select("path", "rule_id", "start", "end", "snippet", "symbol")


def finding_order(spark, sf_dir):
    w = W.partitionBy("path").orderBy("start", F.desc("end"), "rule_id")
    return findings(spark, sf_dir).select("path", "start", "end", "rule_id", F.row_number().over(w).cast("long").alias("place"))


def kind_suffix(spark, sf_dir):
    return guess_kind(spark, sf_dir).select("page_id", files.suffix_of(F.col("kind")).alias("suffix"))


def resolve_url(spark, sf_dir):
    ship(spark)
    reference = F.expr("case page_id % 4 when 0 then '/a/b?q=1' when 1 then 'https://x.example/y' when 2 then '' else '#part' end")
    base = F.concat(F.lit("https://h.example/dir/p"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", files.resolved(base, reference).alias("resolved"))


def public_addresses(spark, sf_dir):
    ship(spark)
    heads = ("10.1", "172.16", "192.168", "127.0", "169.254", "224.0", "8.8", "100.64")
    address = reduce(lambda acc, x: F.when(F.col("page_id") % 9 == x[0], F.concat(F.lit(x[1] + ".0."), (F.col("page_id") % 200 + 1).cast("string"))).otherwise(acc), enumerate(heads), F.lit("0.0.0.0"))
    return table(spark, sf_dir, "pages").select("page_id", files.is_public(address).alias("public"))


def comment_bodies(spark, sf_dir):
    return rewriting.comment_texts(docs(spark, sf_dir), 20).select("path", F.col("number").cast("long").alias("number"), "body")


def layerb_plan(spark, sf_dir):
    return rewriting.planned(docs(spark, sf_dir), findings(spark, sf_dir))


def model_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"rewrite": "'), word, F.lit('"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```text\n"), word, F.lit("\n```"))).otherwise(F.concat(F.lit("  "), word, F.lit(" ")))
    return c.select("conv_id", "turn", rewriting.answer(reply).alias("answer"))


def _go_units(spark, sf_dir):
    """A Go source for each document: an identifier of mixed script beside its plain name, a mark in a string and in code."""
    body = F.concat(
        F.lit("// Package p holds "), F.col("doc_id").cast("string"), F.lit("\npackage p\n\n//go:generate stringer\nvar s = \"hi\u200b\" // plain\nvar t = `\n# Generated with Claude\n`\n// Generated with Claude\nfunc sc\u0430n() { scan2 := sc\u0430n; _ = scan2 }\nfunc "),
        F.when(F.col("doc_id") % 2 == 0, "scan").otherwise(F.lit("other")), F.lit("() {\u200b}\n"), F.when(F.col("doc_id") % 5 == 0, "}").otherwise(F.lit("")),
    )
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("go/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), body.alias("text"))


def go_findings(spark, sf_dir):
    """Identifiers, protected marks and stamps of Go sources; those with a bracket too many are texts like others."""
    found = scanning.scan(_go_units(spark, sf_dir)).filter("detector in ('unicode', 'stamp', 'astgo')")
    return found.groupBy("rule_id", "evidence", "replacement", "clean", "protected", "reason").agg(F.count("*").alias("n"))


def confidence_histogram(spark, sf_dir):
    c = F.when(F.col("confidence").isin("certain", "likely"), F.col("confidence")).otherwise(F.lit("heuristic"))
    return findings(spark, sf_dir).groupBy(c.alias("confidence")).agg(F.count("*").alias("n"))


def fail_on(spark, sf_dir):
    df = findings(spark, sf_dir)
    names = ("none", "any", "certain", "likely", "heuristic", "unheard")
    family = F.col("family")
    return df.groupBy(family).agg(*[audit.fails(df, n).alias(f"fail_{n}") for n in names])


def score_family_caps(spark, sf_dir):
    return audit.family_sums(findings(spark, sf_dir))


def score_percent(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return audit.percent(findings(spark, sf_dir), n)


def score_agent_votes(spark, sf_dir):
    return audit.votes(findings(spark, sf_dir))


def score_agent_pick(spark, sf_dir):
    return audit.picked(findings(spark, sf_dir))


def clean_text(spark, sf_dir):
    return audit.cleaned(docs(spark, sf_dir), findings(spark, sf_dir)).filter("text <> cleaned").select("path", F.md5(F.encode("cleaned", "UTF-8")).alias("digest"))


def clean_greedy(spark, sf_dir):
    spans = audit.planned(findings(spark, sf_dir))
    return spans.select("path", F.inline("spans")).select("path", "start", "end", "rule_id")


def clean_verify(spark, sf_dir):
    """What is left after cleaning, by rule: only what is reported but not cleaned."""
    after = audit.cleaned(docs(spark, sf_dir), findings(spark, sf_dir)).select("path", F.col("cleaned").alias("text"))
    return audit.with_rules(detect.unicode_marks(after)).groupBy("rule_id", "clean").agg(F.count("*").alias("n"))


def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", audit.redacted(F.col("text")).alias("r"), "text").filter("r <> text").select("doc_id", F.md5(F.encode("r", "UTF-8")).alias("digest"))


def snippet_escape(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n", -1)).alias("number", "line")
    return docs(spark, sf_dir).select("path", lines).select("path", F.col("number").cast("long").alias("number"), audit.snippet(F.col("line")).alias("snippet")).filter(F.contains("snippet", F.lit("<U+")) | F.contains("snippet", F.lit("\\t")))


def layerb_survey(spark, sf_dir):
    return audit.survey(docs(spark, sf_dir), findings(spark, sf_dir))


def lexical_divergence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "text", F.lead("text").over(w).alias("after")).filter("after is not null").select("conv_id", "turn", F.round(audit.divergence(F.col("text"), F.col("after")), 6).alias("divergence"))


def select_candidate(spark, sf_dir):
    """Of each conversation's later turns the one that a rewrite of its first would be."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(w))
    first = c.filter("k = 1").select("conv_id", F.col("text").alias("original"))
    scored = c.filter("k > 1").join(first, "conv_id").withColumn("score", F.round(audit.candidate_score(F.col("original"), F.col("text")), 6))
    best = scored.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "k"))).filter("n = 1")
    return best.select("conv_id", F.col("turn").alias("chosen"), "score")


def guess_kind(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ct = F.expr("case page_id % 4 when 0 then 'text/html; charset=utf-8' when 1 then 'image/png' when 2 then '' else 'text/plain' end")
    return p.select("page_id", files.guess_kind(F.col("url"), F.col("html"), ct).alias("kind"))


def origin_allowed(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    o = files.origin(F.col("url"))
    host = F.regexp_replace(F.col("url"), r"^https?://([^/?#]*)(?s:.*)\z", "$1")
    plain = files.origin(F.concat(F.lit("http://"), host, F.lit("/")))
    return p.select("page_id", o.alias("origin"), files.origin_allowed(o, plain).alias("from_http"), files.origin_allowed(plain, o).alias("to_http"))


def parse_sitemap(spark, sf_dir):
    """A sitemap that names each page's address and an image; half of them packed."""
    ship(spark)
    address = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<urlset xmlns:image='http://www.google.com/schemas/sitemap-image/1.1'><url><loc> "), address, F.lit(" </loc><image:image><image:loc>https://a.example/i.png</image:loc></image:image></url></urlset>"))
    data = files.gunzipped(files.gzipped(F.encode(xml, "UTF-8")))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.sitemap_locations(F.decode(data, "UTF-8"))).alias("place", "loc")).select("page_id", F.col("place").cast("long").alias("place"), "loc")


def sarif_rows(spark, sf_dir):
    return audit.sarif_rows(findings(spark, sf_dir))


def _lookalike(spark, sf_dir):
    return audit.merged(audit.with_rules(detect.detect(docs(spark, sf_dir), aggressive=True)), aggressive=True)


def aggressive_clean(spark, sf_dir):
    return _lookalike(spark, sf_dir).filter("family = 'unicode'").groupBy("rule_id", "clean", "replacement").agg(F.count("*").alias("n"))


def binary_metadata(spark, sf_dir):
    """Files of six kinds with a document's words in their metadata, every other one marked."""
    ship(spark)
    return binary.scanned(binary.samples(spark, table(spark, sf_dir, "documents"))).select("path", "rule_id", "evidence")


def scrub_text(spark, sf_dir):
    """Texts without their invisible marks, whatever else they hold."""
    texts = docs(spark, sf_dir).filter(detect.payload(F.col("path"), F.col("text")))
    return audit.scrubbed(texts).filter("text <> cleaned").select("path", F.md5(F.encode("cleaned", "UTF-8")).alias("digest"), F.col("removed").cast("long").alias("removed"))


def nfkc(spark, sf_dir):
    ship(spark)
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\ufb01le \uff21 "), "text").alias("text"))
    return binary.normalised(df, "text").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def mixed_script(spark, sf_dir):
    """Words that mix Latin with Cyrillic or Greek."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    df = docs(spark, sf_dir).select("path", word.alias("word"))
    return df.filter(F.col("word").rlike(r"\p{IsLatin}") & F.col("word").rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))


QUERIES = {
    "findings_by_rule": findings_by_rule, "rule_catalog": rule_catalog, "rule_explain": rule_explain, "walk_filter": walk_filter, "classify_language": classify_language,
    "classify_kind": classify_kind, "comment_regions": comment_regions, "unicode_findings": _of(detect.unicode_marks), "unicode_aggressive": _of(detect.unicode_marks, aggressive=True),
    "unicode_cleaning": unicode_cleaning, "finding_positions": finding_positions, "c2pa_findings": _of(detect.c2pa_marks), "c2pa_page_findings": _of(detect.c2pa_marks, pages),
    "stamp_findings": _of(detect.stamps), "origin_findings": _of(detect.origins), "html_findings": _of(detect.html_marks, pages), "svg_findings": svg_findings,
    "front_matter_keys": front_matter_keys, "merge_dedup": merge_dedup, "merge_protect": merge_protect, "detector_hits": detector_hits, "layer_counts": layer_counts,
    "confidence_histogram": confidence_histogram, "fail_on": fail_on, "score_family_caps": score_family_caps, "score_percent": score_percent, "score_agent_votes": score_agent_votes,
    "score_agent_pick": score_agent_pick, "clean_text": clean_text, "clean_greedy": clean_greedy, "clean_verify": clean_verify, "redact_secrets": redact_secrets,
    "snippet_escape": snippet_escape, "layerb_survey": layerb_survey, "lexical_divergence": lexical_divergence, "select_candidate": select_candidate, "guess_kind": guess_kind,
    "origin_allowed": origin_allowed, "parse_sitemap": parse_sitemap, "sarif_rows": sarif_rows, "aggressive_clean": aggressive_clean, "binary_metadata": binary_metadata,
    "nfkc": nfkc, "mixed_script": mixed_script,
    "layer_tags": layer_tags, "container_dispatch": container_dispatch, "score_evidence": score_evidence, "score_agent_fallback": score_agent_fallback, "decode_units": decode_units, "file_counters": file_counters, "file_counters_forced": file_counters_forced, "finding_snippets": finding_snippets, "finding_order": finding_order, "kind_suffix": kind_suffix, "resolve_url": resolve_url, "public_addresses": public_addresses, "comment_bodies": comment_bodies, "layerb_plan": layerb_plan, "model_answers": model_answers, "go_findings": go_findings, "scrub_text": scrub_text,
}
