"""Detectors: units (path, text) to findings (path, rule_id, start, end, evidence, replacement, clean).

Each is a narrow pass of pattern generators. ``start`` and ``end`` are byte offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwarden.functions.re2 import re2
from spanwarden.functions.spans import hits, once

# Code points of the named rules, in the order they are tried.
INVISIBLE = {"zwsp": "\u200b", "zwnj": "\u200c", "zwj": "\u200d", "word_joiner": "\u2060", "bom": "\ufeff", "soft_hyphen": "\u00ad"}
SPACES = {"nbsp": "\u00a0", "nnbsp": "\u202f", "figure_space": "\u2007", "thin_space": "\u2009", "hair_space": "\u200a", "em_space": "\u2003", "en_space": "\u2002"}
BIDI = "\u202a-\u202e\u2066-\u2069\u200e\u200f\u061c"
VARIATION, SUPPLEMENT = "\ufe00-\ufe0f", "\U000e0100-\U000e01ef"
TAGS = "\U000e0001\U000e0020-\U000e007f"
MORE_SPACES = "\u1680\u2000\u2001\u2004-\u2006\u2008\u205f\u3000"
FORMAT = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u2061-\u2064\u206a-\u206f\ufff9-\ufffb"
OTHER_CF = "\u0890\u0891\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a"
EMOJI = "\U0001f300-\U0001faff\u2600-\u27bf\u2b00-\u2bff\U0001f1e6-\U0001f1ff\U0001f004-\U0001f0ff"
SKIPPED = "\ufe00-\ufe0f\U0001f3fb-\U0001f3ff"
# Cyrillic and Greek letters and the Latin ones that they look like; fullwidth forms follow a rule.
CONFUSABLE = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i",
    "\u0458": "j", "\u0455": "s", "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H",
    "\u041e": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0425": "X", "\u0406": "I", "\u0408": "J", "\u03bf": "o",
    "\u03b1": "a", "\u03bd": "v", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u03c7": "x", "\u03b9": "i", "\u0391": "A",
    "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039a": "K", "\u039c": "M", "\u039d": "N",
    "\u039f": "O", "\u03a1": "P", "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X",
}
CONFUSABLE |= {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
RTL = r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}]"
EVERY = "[" + "".join(INVISIBLE.values()) + "".join(SPACES.values()) + BIDI + VARIATION + SUPPLEMENT + TAGS + MORE_SPACES + FORMAT + OTHER_CF + "]"

ALLOWED = re2(r"(?i)code generated by (protoc|easyjson|stringer|mockgen|wire|sqlc|oapi-codegen)|Code generated .* DO NOT EDIT")
# Stamp and origin patterns (RE2).
STAMPS = {
    "stamp.co_authored_by_ai": r"(?i)^\s*(?://|#|--|/\*|\*)?\s*Co-authored-by:\s*.*(Cursor|Copilot|Claude|ChatGPT|OpenAI|Devin|Gemini|Codex)\b",
    "stamp.generated_by_ai": r"(?i)^\s*(?://|#|--|/\*|\*)?\s*(Generated by|Generated with)\s+.*(Copilot|Cursor|Claude|ChatGPT|OpenAI|Devin|Gemini)\b",
    "stamp.ai_generated": r"(?i)^\s*(?://|#|--|/\*|\*|<!--)?\s*(AI-generated|Generated by AI|This (file|code) was generated by (an )?AI)\b",
    "stamp.html_ai_comment": r"(?i)<!--\s*(Copilot|Cursor|Claude|ChatGPT|OpenAI|Devin)\b.*?-->",
    "stamp.ai_boilerplate": r"(?i)(Sure, here'?s|As an AI|I'?d be happy to|Let me know if you need|Here is a simple implementation|Hope this helps!|Of course! Here's)",
}
ORIGINS = {
    "origin.named.claude": (r"(?i)\b(claude|anthropic)\b", 2),
    "origin.named.chatgpt": (r"(?i)\b(chatgpt|chat\s*gpt)\b", 2),
    "origin.named.gemini": (r"(?i)\b(gemini|google\s+bard)\b", 2),
    "origin.named.copilot": (r"(?i)\b(github\s+)?copilot\b", 2),
    "origin.named.cursor": (r"(?i)\bcursor\s+(agent|tab|composer)\b", 2),
    "origin.style.boilerplate": (r"(?i)(sure,?\s+here'?s|as an ai|i'?d be happy to|let me know if you need|hope this helps|of course!?\s+here)", 3),
}
C2PA = {
    "c2pa.structured": r"(?s)-----BEGIN C2PA MANIFEST-----.*?-----END C2PA MANIFEST-----",
    "c2pa.html_script": r"""(?is)<script\b[^>]*type\s*=\s*["']application/c2pa["'][^>]*>.*?</script>""",
    "c2pa.html_link": r"""(?is)<link\b[^>]*rel\s*=\s*["']c2pa-manifest["'][^>]*/?>""",
}
#: What a text must hold, in lower case, for a pattern to match it.
C2PA_HINTS = {"c2pa.structured": "-----begin c2pa manifest-----", "c2pa.html_script": "application/c2pa", "c2pa.html_link": "c2pa-manifest"}
STAMP_HINTS = ("co-authored-by:", "generated by", "generated with", "ai-generated", "was generated by", "<!--", "sure, here", "as an ai", "be happy to", "let me know if you need", "here is a simple", "hope this helps!", "of course! here")
ORIGIN_HINTS = ("claude", "anthropic", "chat", "gemini", "google", "copilot", "cursor", "sure", "as an ai", "be happy to", "let me know if you need", "hope this helps", "of course")
VS_RUN = f"[{VARIATION}{SUPPLEMENT}]{{16,}}"
# Hints of generators (RE2), and needles.
GENERATOR = r"(?i)claude|anthropic|openai|chatgpt|gemini|synthid|copilot|midjourney|dall.?e|stable.?diffusion|cursor|codex"
META_NAME = r"(?i)generator|ai[-_ ]?generated|claude|anthropic|openai|gemini|synthid|c2pa|content.?credential|provenance|digital.?source|aigc"
NEEDLES = ("c2pa", "contentcredentials", "digitalsourcetype", "trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "algorithmicmedia", "aigc", "ai generated", "generated by", "claude", "anthropic", "openai", "synthid", "dcterms:provenance")
C2PA_NEEDLES = ("c2pa", "jumb", "c2ma", "contentcredentials", "contentauth", "cai:")
AI_NEEDLES = (*NEEDLES, *C2PA_NEEDLES)
META_TAG = r"(?is)<meta\b[^>]*>"
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>.*?</script>"""
DATA_AI = r"""(?i)\sdata-ai[\w-]*\s*=\s*["'][^"']*["']"""
FRONT_KEYS = ("generator", "ai", "ai_generated", "ai-generated", "claude", "anthropic", "openai", "gemini", "synthid", "c2pa", "content_credentials", "contentcredentials", "provenance", "digital_source_type", "digitalsourcetype", "created_with", "createdwith", "model", "llm")
SVG_BLOCKS = (r"(?is)<metadata\b[^>]*>.*?</metadata\s*>", r"(?is)<x:xmpmeta\b[^>]*>.*?</x:xmpmeta\s*>")
SVG_COMMENT, SVG_GENERATOR = r"(?s)<!--.*?-->", r"""(?i)\s(inkscape:version|sodipodi:docname|generator)\s*=\s*"[^"]*\""""
# Comment regions (RE2), tried in order.
COMMENTS = (
    r"^[ \t\r]*((?:(?://|<!--|/\*|--|#)(?s:.*))|(?:\*(?:[ */](?s:.*))?))\z",
    r"(?s)^.*?[ \t\r](//.*)\z",
    r"(?s)^.*?[ \t\r](<!--.*)\z",
    r"(?s)^.*?[ \t\r](#.*)\z",
)


def _finding(df: DataFrame, rule: Column | str, evidence: Column, replacement: Column | None = None, clean: Column | None = None) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return df.select("path", rule.alias("rule_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "line", "col", evidence.alias("evidence"), (replacement if replacement is not None else F.lit("")).alias("replacement"), (clean if clean is not None else F.lit(None).cast("string")).alias("clean"))


def unicode_marks(units: DataFrame, aggressive: bool = False) -> DataFrame:
    """Invisible and look-alike code points; the first rule that fits wins."""
    pattern = EVERY if not aggressive else EVERY[:-1] + "".join(CONFUSABLE) + "]"
    # most code points fail the first two ranges, so Java never tries the many that follow
    pattern = f"[\u00a0\u00ad\u034f-\U0010ffff&&{pattern}]"
    df = hits(units, "text", pattern).withColumn("before", F.expr("substring(text, 1, at)")).withColumn("after", F.expr("substring(text, at + 2)"))
    c = F.col("hit")
    is_ = lambda chars: c.rlike(f"^[{chars}]\\z")
    prev = F.regexp_extract("before", f"(?s)(.)[{SKIPPED}]*\\z", 1)
    next_ = F.regexp_extract("after", f"(?s)^[{SKIPPED}]*(.)", 1)
    emoji = lambda x: x.rlike(f"^[{EMOJI}]\\z")
    prev_any = F.regexp_extract("before", "(?s)(.)\\z", 1)
    flag = F.lit(aggressive)
    rule = F.when(c == INVISIBLE["zwsp"], "unicode.zwsp")
    rule = rule.when(c == INVISIBLE["zwnj"], F.when(~flag & prev.rlike(r"^(?=[^\x00-\x7f])\p{L}\z"), None).otherwise(F.lit("unicode.zwnj")))
    rule = rule.when(c == INVISIBLE["zwj"], F.when(emoji(prev) & emoji(next_), None).otherwise(F.lit("unicode.zwj")))
    for name in ("word_joiner", "bom", "soft_hyphen"):
        rule = rule.when(c == INVISIBLE[name], f"unicode.{name}")
    for name, char in SPACES.items():
        rule = rule.when(c == char, f"unicode.{name}")
    rule = rule.when(is_(BIDI), "unicode.bidi")
    rule = rule.when(is_(VARIATION), F.when(~flag & is_("\ufe0e\ufe0f") & emoji(prev), None).otherwise(F.lit("unicode.vs")))
    rule = rule.when(is_(SUPPLEMENT), "unicode.vs_supplement")
    rule = rule.when(is_(TAGS), F.when(~flag & emoji(prev_any), None).otherwise(F.lit("unicode.tags")))
    rule = rule.when(is_(MORE_SPACES), "unicode.space_homoglyph").when(is_(FORMAT), "unicode.format").when(is_(OTHER_CF), "unicode.other_cf")
    near = F.regexp_extract("before", r"(\p{L})\P{L}*\z", 1)
    near = F.when(near != "", near).otherwise(F.regexp_extract("after", r"^\P{L}*(\p{L})", 1))
    rule = rule.when(near.rlike(r"\p{IsLatin}"), "unicode.confusable")
    replacement = F.when(is_("".join(SPACES.values()) + MORE_SPACES), " ").otherwise(F.lit(""))
    if aggressive:
        replacement = F.when(F.col("rule_id") == "unicode.confusable", F.translate(c, "".join(CONFUSABLE), "".join(CONFUSABLE.values()))).otherwise(replacement)
    clean = F.when((F.col("rule_id") == "unicode.bidi") & (flag | ~F.col("text").rlike(RTL)), "strip")
    df = df.withColumn("rule_id", rule).filter("rule_id is not null")
    code = F.hex(F.encode(c, "UTF-32"))
    code = F.regexp_replace(code, "^0{1,4}", "")
    return _finding(df, F.col("rule_id"), F.concat(F.lit("U+"), code), replacement, clean)


def low(text: Column) -> Column:
    """The text in lower case, as the hints want it: K and s have one more form each that folds to them."""
    return F.translate(F.lower(text), "\u212a\u017f", "ks")


def hinted(df: DataFrame, text: str, hints: Sequence[str]) -> DataFrame:
    """Rows whose text holds a hint: literal searches, over a text folded once, that spare most rows the expressions."""
    out = F.lit(False)
    for n in hints:
        out = out | F.contains("_low", F.lit(n))
    return once(df, _low=low(F.col(text))).filter(out).drop("_low")


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` bytes; what the cut leaves of a code point becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def c2pa_marks(units: DataFrame) -> DataFrame:
    """Provenance manifests embedded in text."""
    parts = [_finding(hits(hinted(units, "text", [C2PA_HINTS[rule]]), "text", re2(p)), rule, clipped(F.col("hit"), 80)) for rule, p in C2PA.items()]
    parts.append(_finding(hits(units, "text", VS_RUN), "c2pa.unstructured", F.lit("variation selector run")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lines(units: DataFrame, hints: Sequence[str] = ()) -> DataFrame:
    """(path, number from 0, last, line, offset, bytes of the text, allowed): each line with its byte offset.

    With hints, only lines that hold one, of texts that do. What is asked of the whole text is told by
    columns, so lines don't carry it.
    """
    if hints:
        units = hinted(units, "text", hints)
    head = F.substring(F.col("text").cast("binary"), 1, 2048).cast("string")
    cut = units.withColumn("all", F.split("text", "\n", -1)).withColumn("bytes", F.octet_length("text")).withColumn("allowed", F.make_valid_utf8(head).rlike(ALLOWED))
    sums = F.aggregate("all", F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))"), lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
    cut = cut.withColumn("offsets", sums)
    cut = cut.select("path", "bytes", "allowed", F.size("all").alias("of"), "offsets", F.posexplode("all").alias("number", "line"))
    if hints:
        cut = hinted(cut, "line", hints)
    return cut.select("path", "bytes", "allowed", "number", (F.col("number") == F.col("of") - 1).alias("last"), "line", F.get("offsets", F.col("number")).alias("offset"))


def comment_region(line: Column) -> Column:
    """The comment on a line, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(COMMENTS):
        found = F.regexp_extract(line, re2(p), 1)
        out = F.when(found != "", found).otherwise(out)
    return out


def comments(units: DataFrame, hints: Sequence[str] = ()) -> DataFrame:
    df = once(lines(units, hints), region=comment_region(F.col("line"))).filter("region is not null")
    return df.withColumn("region_offset", F.octet_length("line") - F.octet_length("region"))


def _stacked(df: DataFrame, patterns: dict[str, str], text: str) -> DataFrame:
    """One row for each pattern that the text column matches."""
    found = F.filter(F.array(*[F.when(F.col(text).rlike(re2(p)), F.lit(r)) for r, p in patterns.items()]), lambda r: r.isNotNull())
    return df.withColumn("rule_id", F.explode(found))


def stamps(units: DataFrame) -> DataFrame:
    """Assistants' stamps in comments; the span runs through the line's end unless that ends the text."""
    df = comments(units, STAMP_HINTS)
    df = _stacked(df, STAMPS, "region").filter("not (allowed and rule_id in ('stamp.generated_by_ai', 'stamp.ai_generated'))")
    # a newline that ends the text stays
    ends_text = F.col("offset") + F.octet_length("line") + 1 >= F.col("bytes")
    df = df.withColumn("start", F.col("offset") + F.col("region_offset")).withColumn("end", F.col("offset") + F.octet_length("line") + F.when(ends_text, 0).otherwise(1))
    df = df.withColumn("evidence", F.trim(F.regexp_replace("region", "^[\\t\\n\\r ]+|[\\t\\n\\r ]+\\z", ""))).withColumn("col", F.length("line") - F.length("region") + 1).withColumn("line", F.col("number") + 1)
    return _finding(df, F.col("rule_id"), clipped(F.col("evidence"), 120))


def origins(units: DataFrame) -> DataFrame:
    """Soft mentions of assistants: the first few of each rule and text."""
    df = once(lines(units, ORIGIN_HINTS), region=comment_region(F.col("line")))
    blank = F.trim(F.regexp_replace("line", "[\\t\\n\\r\\f ]+", " ")) == ""
    whole = F.when(~blank & ~F.ltrim(F.regexp_replace("line", "^[\\t ]+", "")).rlike(r"^[{\[]"), F.col("line"))
    df = once(df, scanned=F.coalesce("region", whole)).filter("scanned is not null")
    df = _stacked(df, {r: p for r, (p, _) in ORIGINS.items()}, "scanned")
    most = F.when(F.col("rule_id") == "origin.style.boilerplate", 3).otherwise(2)
    df = df.withColumn("place", F.row_number().over(W.partitionBy("path", "rule_id").orderBy("number"))).filter("place <= 3").filter(F.col("place") <= most)
    df = df.withColumn("start", F.col("offset") + F.octet_length("line") - F.octet_length("scanned")).withColumn("end", F.col("offset") + F.octet_length("line"))
    evidence = F.when(F.octet_length("scanned") > 120, F.concat(clipped(F.col("scanned"), 117), F.lit("..."))).otherwise(F.col("scanned"))
    df = df.withColumn("col", F.octet_length("line") - F.octet_length("scanned") + 1).withColumn("shown", evidence).withColumn("line", F.col("number") + 1)
    return _finding(df, F.col("rule_id"), F.col("shown"))


def holds_any(text: Column, needles: Sequence[str]) -> Column:
    folded = low(text)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(folded, F.lit(n))
    return out


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, names in any case."""
    value = F.regexp_extract(tag, rf"""(?is)[\s]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)[\s]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)[\s]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 3)
    return F.concat(value, single, bare)


def html_marks(units: DataFrame) -> DataFrame:
    """Generator hints, provenance JSON-LD and data-ai attributes; generators of content systems are exempt."""
    tag = hits(hinted(units, "text", ["<meta"]), "text", re2(META_TAG))
    hit = F.col("hit")
    name = F.lower(attribute(hit, "name"))
    name = F.when(name != "", name).otherwise(F.lower(attribute(hit, "property")))
    system = (name == "generator") & ~hit.rlike(re2(GENERATOR))
    ai = holds_any(hit, ("contentcredential", *AI_NEEDLES)) | hit.rlike(re2(META_NAME))
    tag = _finding(tag.filter(~system & ai), "container.html_meta", clipped(hit, 80))
    ld = hits(hinted(units, "text", ["application/ld+json"]), "text", re2(JSON_LD)).filter(hit.rlike(re2(META_NAME)) | holds_any(hit, ("digitalsourcetype", "trainedalgorithmicmedia", "softwareagent", "c2pa")))
    data = hits(hinted(units, "text", ["data-ai"]), "text", re2(DATA_AI))
    return tag.unionByName(_finding(ld, "container.html_meta", F.lit("json-ld provenance"))).unionByName(_finding(data, "container.html_meta", clipped(hit, 80)))


def svg_marks(units: DataFrame) -> DataFrame:
    """Provenance blocks and comments; generator attributes only where nothing else is found."""
    hit = F.col("hit")
    parts = [_finding(hits(units, "text", re2(p)).filter(holds_any(hit, ("rdf:", "xmp", *AI_NEEDLES)) | hit.rlike(re2(META_NAME))), "container.svg_metadata", clipped(hit, 80)) for p in SVG_BLOCKS]
    parts.append(_finding(hits(units, "text", re2(SVG_COMMENT)).filter(hit.rlike(re2(META_NAME))), "container.svg_metadata", F.lit("svg comment")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rest = _finding(hits(units, "text", re2(SVG_GENERATOR)).filter(hit.rlike(re2(GENERATOR)) | hit.rlike(re2(META_NAME))), "container.svg_metadata", clipped(hit, 80))
    return found.unionByName(rest.join(found.select("path").distinct(), "path", "left_anti"))


def front_matter(units: DataFrame) -> DataFrame:
    """(path, head, kept array, dropped array): front matter lines without provenance keys and what hangs on them.

    Indented lines, list items, comments and blank lines share the fate of the key before them.
    """
    head = F.regexp_extract("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", 0)
    block = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    df = units.filter(F.col("text").startswith("---")).withColumn("head", head).withColumn("block", block).filter("head <> ''")
    zero = F.expr("named_struct('drop', false, 'kept', cast(array() as array<string>), 'gone', cast(array() as array<string>))")

    def step(acc: Column, x: Column) -> Column:
        key = F.regexp_extract(x, r"^([A-Za-z0-9_.-]+)[\t\n\f\r ]*:", 1)
        value = F.regexp_extract(x, r"(?s)^[A-Za-z0-9_.-]+[\t\n\f\r ]*:(.*)", 1)
        hangs = x.rlike(r"(?s)^([ \t-]|\s*\z|\s*#)")
        named = F.lower(key).isin(*FRONT_KEYS) | key.rlike(re2(META_NAME)) | value.rlike(re2(META_NAME))
        drop = F.when(hangs, acc["drop"]).otherwise((key != "") & named)
        return F.struct(drop.alias("drop"), F.when(drop, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), F.when(drop & ~hangs, F.array_append(acc["gone"], key)).otherwise(acc["gone"]).alias("gone"))

    df = df.withColumn("folded", F.aggregate(F.split("block", "\n", -1), zero, step))
    return df.filter(F.size("folded.gone") > 0).select("path", "head", F.col("folded.kept").alias("kept"), F.col("folded.gone").alias("dropped"))


def front_marks(units: DataFrame) -> DataFrame:
    """A finding for each front matter that holds provenance; its replacement is what is left of it."""
    kept = F.regexp_replace(F.array_join("kept", "\n"), r"\A\n+|\n+\z", "")
    df = front_matter(units).withColumn("start", F.lit(0)).withColumn("end", F.octet_length("head")).withColumn("line", F.lit(1)).withColumn("col", F.lit(1))
    replacement = F.when(kept.rlike(r"\S"), F.concat(F.lit("---\n"), kept, F.lit("\n---\n"))).otherwise(F.lit(""))
    return _finding(df, "container.md_front_matter", F.array_join("dropped", ", "), replacement)


def text_format(path: Column, text: Column) -> Column:
    """The container format of a text unit: html, svg or markdown by suffix, svg also by its first element; or null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    looks = F.regexp_replace(F.substring(text, 1, 4096), r"^[ \t\r\n]+", "").startswith("<") & F.contains(F.lower(F.substring(text, 1, 512)), F.lit("<svg"))
    out = F.when(ext == ".svg", "svg").when(ext.isin(".html", ".htm"), "html").when(ext.isin(".md", ".markdown", ".mdx"), "markdown")
    return out.when(~ext.isin(*BINARY_SUFFIXES) & looks, "svg")


def container_marks(units: DataFrame) -> DataFrame:
    """Findings of the text formats that containers come in, each unit by its own format."""
    df = units.withColumn("format", text_format(F.col("path"), F.col("text")))
    out = None
    for name, find in (("html", html_marks), ("markdown", front_marks), ("svg", svg_marks)):
        found = find(df.filter(F.col("format") == name))
        out = found if out is None else out.unionByName(found)
    return out


DETECTORS = {"unicode": unicode_marks, "c2pa": c2pa_marks, "stamp": stamps, "origin": origins}
#: Suffixes of images and binary containers.
BINARY_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".pdf", ".docx", ".odt")


def payload(path: Column, text: Column) -> Column:
    """Whether text detectors read a unit: neither its suffix nor its first bytes make it an image or a binary container."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    zipped = text.startswith("PK") & (F.contains(F.substring(text, 1, 65536), F.lit("word/document.xml")) | (F.contains(F.substring(text, 1, 65536), F.lit("content.xml")) & F.contains(F.substring(text, 1, 65536), F.lit("meta.xml"))))
    return ~ext.isin(*BINARY_SUFFIXES) & ~text.startswith("%PDF") & ~zipped


def detect(units: DataFrame, aggressive: bool = False, containers: bool = False) -> DataFrame:
    """Findings of all text detectors, with the detector's name and its place in the order.

    ``containers`` adds those of text formats; the text detectors leave images and binary containers out.
    """
    texts = units.filter(payload(F.col("path"), F.col("text")))
    parts = {"unicode": unicode_marks(texts, aggressive), "c2pa": c2pa_marks(texts), "stamp": stamps(texts), "origin": origins(texts)}
    if containers:
        parts["container"] = container_marks(units)
    out = None
    for i, (name, df) in enumerate(parts.items()):
        df = df.withColumn("detector", F.lit(name)).withColumn("detector_order", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out
