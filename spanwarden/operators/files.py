"""Files and addresses: walking rules, kinds, languages, origins, sitemaps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders and files that a walk leaves out.
SKIPPED_DIRS = (".git", "node_modules", "vendor", "dist", "bin", ".idea", ".vscode")
SKIPPED_FILES = ("license", "licence", "copying", "notice", "patents", "go.sum", "go.work.sum", "coverage.txt", "coverage.out", ".ds_store")
# Languages and kinds by suffix, and the suffix of a kind.
LANGUAGES = {"go": (".go",), "yaml": (".yaml", ".yml"), "json": (".json",), "markdown": (".md", ".markdown", ".mdx"), "html": (".html", ".htm", ".xml", ".svg"), "image": (".png", ".jpg", ".jpeg", ".webp"), "container": (".pdf", ".docx", ".odt")}
SUFFIX_KINDS = ((".png", "png"), (".jpg", "jpeg"), (".jpeg", "jpeg"), (".svg", "svg"), (".pdf", "pdf"), (".docx", "docx"), (".odt", "odt"), (".html", "html"), (".htm", "html"), (".md", "markdown"), (".markdown", "markdown"), (".txt", "text"))
KIND_SUFFIX = {"png": ".png", "jpeg": ".jpg", "svg": ".svg", "pdf": ".pdf", "docx": ".docx", "odt": ".odt", "html": ".html", "markdown": ".md"}
MAX_BYTES = 8 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def language(path: Column) -> Column:
    out = F.lit("text")
    for name, ends in LANGUAGES.items():
        out = F.when(extension(path).isin(*ends), name).otherwise(out)
    return out


def starts(data: Column, head: bytes) -> Column:
    return F.substring(data, 1, len(head)) == F.lit(head)


def holds(data: Column, part: bytes, within: int) -> Column:
    return F.contains(F.substring(data, 1, within), F.lit(part))


def kind(path: Column, data: Column) -> Column:
    """image, container, text, or null for a binary that nothing reads."""
    image = extension(path).isin(*LANGUAGES["image"]) | starts(data, b"\x89PNG\r\n\x1a\n") | starts(data, b"\xff\xd8") | (starts(data, b"RIFF") & (F.substring(data, 9, 4) == F.lit(b"WEBP")) & (F.octet_length(data) >= 12))
    office = holds(data, b"word/document.xml", 65536) | (holds(data, b"content.xml", 65536) & holds(data, b"meta.xml", 65536))
    container = extension(path).isin(*LANGUAGES["container"]) | starts(data, b"%PDF") | (starts(data, b"PK") & office)
    return F.when(image, "image").when(container, "container").when(holds(data, b"\x00", 8192), F.lit(None)).otherwise("text")


def glob_pattern(glob: str) -> str:
    """A Java pattern for a glob: * and ? stay within a folder, [...] is a class, \\ escapes, ** crosses folders
    (a/** fits a itself, too); a glob without / also fits the name alone."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "/**":
            out, i = out + "(?:/.*)?", len(glob)
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            body = "^/" + body[1:] if body[0] == "^" else body
            out, i = out + "[" + body.replace("[", "\\[").replace("&&", "&\\&") + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return ("(?s)^" if "/" in glob else "(?s)^(?:.*/)?") + out + r"\z"


def walked(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files (rel_path, length) that a walk reads."""
    name = F.lower(F.regexp_extract("rel_path", r"([^/]*)\z", 1))
    folders = F.split("rel_path", "/")
    ok = ~F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED_DIRS))
    ok = ok & ~name.isin(*SKIPPED_FILES) & ~name.startswith("license.") & ~name.startswith("licence.") & (F.col("length") <= max_bytes)
    any_ = lambda globs: F.col("rel_path").rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    if include:
        ok = ok & any_(include)
    if exclude:
        ok = ok & ~any_(exclude)
    return files.filter(ok)


def guess_kind(url: Column, text: Column, content_type: Column) -> Column:
    """A page's kind by content type, then address, then content."""
    ct = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    has = lambda x: F.contains(ct, F.lit(x))
    out = F.when(has("html"), "html").when(ct == "image/png", "png").when(ct == "image/jpeg", "jpeg").when(has("svg"), "svg").when(ct == "application/pdf", "pdf").when(has("wordprocessingml"), "docx").when(has("opendocument.text"), "odt").when(has("markdown"), "markdown").when(ct == "text/plain", "text")
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#](?s:.*)\z", ""))
    for end, name in SUFFIX_KINDS:
        out = out.when(path.endswith(end), name)
    low, head = F.lower(F.substring(text, 1, 500)), F.regexp_replace(text, r"^[ \t\r\n]+", "")
    out = out.when(starts(text.cast("binary"), b"\x89PNG\r\n\x1a\n"), "png").when(starts(text.cast("binary"), b"\xff\xd8"), "jpeg")
    return out.when(text.startswith("%PDF"), "pdf").when(F.contains(low, F.lit("svg")) & head.startswith("<"), "svg").when(F.contains(low, F.lit("<html")) | head.startswith("<"), "html").otherwise("text")


def origin(url: Column) -> Column:
    """scheme://host:port in lower case with default ports, or null (not http, or with a user)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(rest, r":[0-9]*\z", "")), r"\.\z", "")
    port = F.regexp_extract(rest, r":([0-9]+)\z", 1)
    port = F.when(port != "", port).otherwise(F.when(scheme == "https", "443").otherwise("80"))
    return F.when(scheme.isin("http", "https") & (host != "") & ~F.contains(rest, F.lit("@")), F.concat(scheme, F.lit("://"), host, F.lit(":"), port))


def origin_allowed(candidate: Column, expected: Column) -> Column:
    """The same origin, or its upgrade from http on port 80 to https on port 443."""
    raised = F.when(expected.startswith("http:") & expected.endswith(":80"), F.concat(F.lit("https"), F.regexp_replace(F.substring(expected, 5, 1 << 20), r":80\z", ":443")))
    return F.coalesce((candidate == expected) | (candidate == raised), F.lit(False))


def sitemap_locations(xml: Column) -> Column:
    """Every loc of a sitemap, at any depth and of any namespace."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda x: F.trim(x))


def suffix_of(kind: Column) -> Column:
    """The suffix that a kind's files get; text's for others."""
    out = F.lit(".txt")
    for name, suffix in KIND_SUFFIX.items():
        out = F.when(kind == name, suffix).otherwise(out)
    return out


def decoded(units: DataFrame, force_kind: str = "", force_text: bool = False) -> DataFrame:
    """Units (path, content binary) with kind, language, charset, has_bom, skipped and text.

    Binaries that nothing reads are skipped unless ``force_text``; ``force_kind`` overrides what was found.
    Invalid UTF-8 makes the charset unknown; in ``text`` such bytes are U+FFFD.
    """
    path, data = F.col("path"), F.col("content")
    found = kind(path, data)
    skipped = found.isNull() & F.lit(not force_text)
    own = F.lit(force_kind) if force_kind else F.coalesce(found, F.lit("text"))
    spoken = F.when(found.isin("image", "container"), found).otherwise(language(path))
    valid = F.is_valid_utf8(data.cast("string"))
    return units.select(
        *units.columns, own.alias("kind"), spoken.alias("language"), F.when((F.coalesce(found, F.lit("")) == "text") & ~valid, "unknown").otherwise(F.lit("utf-8")).alias("charset"),
        F.coalesce(starts(data, b"\xef\xbb\xbf"), F.lit(False)).alias("has_bom"), skipped.alias("skipped"), F.make_valid_utf8(data.cast("string")).alias("text"),
    )


def counters(decoded_units: DataFrame) -> DataFrame:
    """One row: files scanned and skipped, and of the scanned ones texts, images and documents."""
    there = ~F.col("skipped")
    image, container = there & (F.col("kind") == "image"), there & (F.col("kind") == "container")
    return decoded_units.agg(F.count_if(there).alias("scanned"), F.count_if("skipped").alias("skipped"), F.count_if(there & ~image & ~container).alias("texts"), F.count_if(image).alias("images"), F.count_if(container).alias("docs"))


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, reference: pd.Series) -> pd.Series:
    """References resolved against base addresses (RFC 3986)."""
    from urllib.parse import urljoin

    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, reference, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def is_public(address: pd.Series) -> pd.Series:
    """Whether an IP address is none of loopback, private, link-local, multicast and unspecified; shared (CGNAT) ones pass."""
    import ipaddress

    def one(x: str | None) -> bool:
        try:
            ip = ipaddress.ip_address(x or "")
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        own = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
        return not (ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified or any(ip in n for n in own if n.version == ip.version))

    return address.map(one)


def endpoint_allowed(url: str, remote: bool = False) -> bool:
    """Whether a model's address may be called: http(s), and on this machine unless ``remote``."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    return parts.scheme in ("http", "https") and bool(host) and (remote or host in ("localhost", "::1") or host.startswith("127."))


def gzipped(data: Column) -> Column:
    """Bytes, packed by gzip."""

    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        import gzip

        return column.map(lambda x: None if x is None else gzip.compress(x))

    return run(data)


def gunzipped(data: Column, most: int = 64 << 20) -> Column:
    """Bytes, unpacked where they start like gzip, ``most`` at most; null where they can't be unpacked or are more."""

    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        import zlib

        def one(x: bytes | None) -> bytes | None:
            if x is None or not x.startswith(b"\x1f\x8b"):
                return x if x is None or len(x) <= most else None
            try:
                out = zlib.decompressobj(31).decompress(x, most + 1)
            except zlib.error:
                return None
            return out if len(out) <= most else None

        return column.map(one)

    return run(data)
