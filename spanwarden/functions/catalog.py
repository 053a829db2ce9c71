"""The rule catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, family, severity, confidence, cleaning, description.
_CERTAIN = (
    ("c2pa.unstructured", "c2pa", "error", "strip", "C2PA unstructured text embedding (variation-selector run)"),
    ("c2pa.structured", "c2pa", "error", "strip", "C2PA structured ASCII armour manifest block"),
    ("c2pa.html_script", "c2pa", "error", "strip", "C2PA HTML script manifest (type=application/c2pa)"),
    ("c2pa.html_link", "c2pa", "error", "strip", "C2PA HTML link rel=c2pa-manifest"),
    ("container.png_metadata", "c2pa", "error", "strip", "PNG C2PA / EXIF / text provenance chunks"),
    ("container.jpeg_metadata", "c2pa", "error", "strip", "JPEG APP11 JUMBF/C2PA or AI EXIF/XMP segments"),
    ("container.webp_metadata", "c2pa", "error", "strip", "WebP RIFF C2PA / EXIF / XMP provenance chunks"),
    ("container.html_meta", "metadata", "warning", "strip", "HTML AI generator / C2PA / JSON-LD provenance markup"),
    ("container.md_front_matter", "metadata", "warning", "strip", "Markdown YAML front matter with AI provenance keys"),
    ("container.svg_metadata", "metadata", "warning", "strip", "SVG metadata / XMP provenance blocks"),
    ("container.pdf_metadata", "metadata", "warning", "strip", "PDF XMP / Info Producer-Creator AI provenance (qpdf linearize when available)"),
    ("container.docx_metadata", "metadata", "warning", "strip", "DOCX docProps / customXml AI provenance"),
    ("container.odt_metadata", "metadata", "warning", "strip", "ODT meta.xml generator / creator AI provenance"),
    ("homoglyph.ident", "homoglyph", "error", "normalize", "Identifier mixes Latin and lookalike scripts"),
    ("homoglyph.yaml_key", "homoglyph", "error", "normalize", "YAML key mixes Latin and lookalike scripts"),
    ("homoglyph.json_key", "homoglyph", "error", "normalize", "JSON key mixes Latin and lookalike scripts"),
    ("stamp.co_authored_by_ai", "stamp", "warning", "strip", "Co-authored-by trailer naming an AI agent"),
    ("stamp.generated_by_ai", "stamp", "warning", "strip", "Generated-by header naming an AI agent"),
    ("stamp.ai_generated", "stamp", "warning", "strip", "Explicit AI-generated marker"),
    ("stamp.html_ai_comment", "stamp", "warning", "strip", "HTML/Markdown comment naming an AI agent"),
    ("unicode.zwsp", "unicode", "warning", "strip", "Zero-width space (U+200B)"),
    ("unicode.zwnj", "unicode", "warning", "strip", "Zero-width non-joiner (U+200C)"),
    ("unicode.zwj", "unicode", "warning", "strip", "Zero-width joiner (U+200D) outside an emoji sequence"),
    ("unicode.word_joiner", "unicode", "warning", "strip", "Word joiner (U+2060)"),
    ("unicode.bom", "unicode", "warning", "strip", "Byte order mark (U+FEFF)"),
    ("unicode.soft_hyphen", "unicode", "warning", "strip", "Soft hyphen (U+00AD)"),
    ("unicode.bidi", "unicode", "error", "report_only", "Bidirectional control character"),
    ("unicode.vs", "unicode", "warning", "strip", "Unicode variation selector"),
    ("unicode.vs_supplement", "unicode", "warning", "strip", "Unicode variation selector supplement"),
    ("unicode.tags", "unicode", "error", "strip", "Unicode tag character (language tags / steganography)"),
    ("unicode.nbsp", "unicode", "warning", "normalize", "No-break space (U+00A0)"),
    ("unicode.nnbsp", "unicode", "warning", "normalize", "Narrow no-break space (U+202F)"),
    ("unicode.figure_space", "unicode", "warning", "normalize", "Figure space (U+2007)"),
    ("unicode.thin_space", "unicode", "warning", "normalize", "Thin space (U+2009)"),
    ("unicode.hair_space", "unicode", "warning", "normalize", "Hair space (U+200A)"),
    ("unicode.em_space", "unicode", "warning", "normalize", "Em space (U+2003)"),
    ("unicode.en_space", "unicode", "warning", "normalize", "En space (U+2002)"),
    ("unicode.space_homoglyph", "unicode", "warning", "normalize", "Exotic space homoglyph (Ogham, en/em quad, ideographic, ...)"),
    ("unicode.format", "unicode", "warning", "strip", "Invisible format control (CGJ, Mongolian FVS, invisible math ops, ...)"),
    ("unicode.other_cf", "unicode", "warning", "strip", "Other Unicode format (Cf) control not covered by a named rule"),
    ("unicode.confusable", "unicode", "warning", "normalize", "Latin lookalike (Cyrillic/Greek/fullwidth) in Latin context (--aggressive)"),
)
_OTHER = (
    ("stamp.ai_boilerplate", "stamp", "info", "likely", "strip", "Likely AI-assistant boilerplate prose"),
    ("origin.named.claude", "heuristic", "info", "heuristic", "report_only", "Soft mention of Claude/Anthropic without formal stamp"),
    ("origin.named.chatgpt", "heuristic", "info", "heuristic", "report_only", "Soft mention of ChatGPT/OpenAI without formal stamp"),
    ("origin.named.gemini", "heuristic", "info", "heuristic", "report_only", "Soft mention of Gemini/Bard without formal stamp"),
    ("origin.named.copilot", "heuristic", "info", "heuristic", "report_only", "Soft mention of GitHub Copilot without formal stamp"),
    ("origin.named.cursor", "heuristic", "info", "heuristic", "report_only", "Soft mention of Cursor agent without formal stamp"),
    ("origin.style.boilerplate", "heuristic", "info", "heuristic", "report_only", "Assistant-style boilerplate phrasing (origin hint)"),
    ("statwm.layer_b_prose", "heuristic", "info", "heuristic", "rewrite", "Statistical token-sampling watermark reduction via paraphrase (Layer B)"),
    ("statwm.layer_b_comment", "heuristic", "info", "heuristic", "rewrite", "Comment paraphrase to break n-gram sampling watermarks (Layer B)"),
    ("statwm.ast_transform", "heuristic", "info", "heuristic", "rewrite", "AST token transform (rename/reorder) against sampling watermarks"),
)
RULES = tuple((i, f, s, "certain", c, d) for i, f, s, c, d in _CERTAIN) + _OTHER
COLUMNS = ("id", "family", "severity", "confidence", "clean", "description")
#: What an unknown id is taken for.
FALLBACK = ("unicode", "warning", "certain", "strip", "")


def rules(spark: SparkSession) -> DataFrame:
    """The 51 rules; small and fixed, so joins may broadcast it."""
    return spark.createDataFrame(list(RULES), ", ".join(f"{c} string" for c in COLUMNS))
