"""Binary containers: provenance in PNG, JPEG, WebP, PDF, DOCX and ODT, one Python pass over the bytes.

``inspect`` returns (rule, labels, cleaned bytes) or None: malformed data give no finding, and neither
do data that cleaning leaves as they are.
"""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spanwarden.operators.detect import AI_NEEDLES, C2PA_NEEDLES, GENERATOR, META_NAME

ZIP_LIMIT = 128 << 20
_GENERATOR, _META = re.compile(GENERATOR.encode()), re.compile(META_NAME.encode())
_PACKET = re.compile(rb"(?is)<\?xpacket begin.*?<\?xpacket end[^?]*\?>")
_INFO = re.compile(rb"(?i)/(Producer|Creator)\s*\((?:\\.|[^\\)])*\)")


def looks(data: bytes, needles: tuple[str, ...]) -> bool:
    low = data.lower()
    return any(n.encode() in low for n in needles)


def png(data: bytes) -> tuple[str, bytes] | None:
    head = b"\x89PNG\r\n\x1a\n"
    if not data.startswith(head):
        return None
    out, at, labels = [head], 8, []
    # Chunks that stay whatever they hold.
    structural = (b"IHDR", b"IDAT", b"IEND", b"PLTE", b"tRNS", b"gAMA", b"pHYs", b"sRGB", b"cHRM", b"iCCP")
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            return None
        body = data[at + 8 : at + 8 + n]
        drop = name in (b"caBX", b"juMB", b"jumb") or name[:2] == b"c2"
        drop = drop or (name in (b"eXIf", b"tEXt", b"zTXt", b"iTXt") and looks(body, AI_NEEDLES))
        drop = drop or (name not in structural and name not in (b"eXIf", b"tEXt", b"zTXt", b"iTXt") and looks(name + body, C2PA_NEEDLES))
        if drop:
            labels.append(name.decode("latin-1"))
        else:
            out.append(data[at : at + 12 + n])
        at += 12 + n
        if name == b"IEND":
            return (",".join(labels), b"".join(out)) if labels else None
    return None


def jpeg(data: bytes) -> tuple[str, bytes] | None:
    if not data.startswith(b"\xff\xd8"):
        return None
    out, at, labels = [data[:2]], 2, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker in (0xDA, 0xD9):
            out.append(data[at:])
            return (",".join(labels), b"".join(out)) if labels else None
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2 or at + 2 + n > len(data):
            return None
        body = data[at + 4 : at + 2 + n]
        app = 0xE0 <= marker <= 0xEF
        if marker == 0xEB or ((app or marker == 0xFE) and looks(body, AI_NEEDLES)):
            labels.append(f"APP{marker - 0xE0}" if app else "COM")
        else:
            out.append(data[at : at + 2 + n])
        at += 2 + n
    return None


def webp(data: bytes) -> tuple[str, bytes] | None:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP" or struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        return None
    chunks, at, labels = [], 12, []
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > len(data):
            return None
        body = data[at + 8 : at + 8 + n]
        if name.lower() == b"c2pa" or (name in (b"EXIF", b"XMP ", b"ICCP") and looks(body, AI_NEEDLES)):
            labels.append(name.decode("latin-1").strip())
        else:
            chunks.append([name, body])
        at += 8 + n + n % 2
    if at < len(data) or not labels:
        return None
    have = {c[0] for c in chunks}
    for c in chunks:
        if c[0] == b"VP8X" and c[1]:
            flags = c[1][0]
            for name, bit in ((b"ICCP", 0x20), (b"EXIF", 0x08), (b"XMP ", 0x04)):
                if name not in have:
                    flags &= ~bit
            c[1] = bytes([flags]) + c[1][1:]
    body = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return ",".join(labels), b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def pdf(data: bytes) -> tuple[str, bytes] | None:
    """Blank packets and producers in place: lengths, and so offsets, stay."""
    if not data.startswith(b"%PDF"):
        return None
    labels: list[str] = []

    def packet(m: re.Match) -> bytes:
        if looks(m[0], AI_NEEDLES):
            labels.append("XMP")
            return b" " * len(m[0])
        return m[0]

    def info(m: re.Match) -> bytes:
        if _GENERATOR.search(m[0]) or looks(m[0], AI_NEEDLES):
            labels.append(m[1].decode())
            head = m[0].index(b"(") + 1
            return m[0][:head] + b" " * (len(m[0]) - head - 1) + b")"
        return m[0]

    out = _INFO.sub(info, _PACKET.sub(packet, data))
    return (",".join(dict.fromkeys(labels)), out) if out != data else None


def _parts(data: bytes) -> dict[str, bytes] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > ZIP_LIMIT:
                return None
            out, left = {}, ZIP_LIMIT
            for i in z.infolist():
                with z.open(i) as f:
                    out[i.filename] = f.read(left + 1)
                left -= len(out[i.filename])
                if left < 0:
                    return None
            return out
    except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError):
        return None


def _zip(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _field(body: bytes, name: str, labels: list[str], only_ai: bool = True) -> bytes:
    pattern = re.compile(rf"(?is)(<{name}\b[^>]*>)(.*?)(</{name}\s*>)".encode())

    def scrub(m: re.Match) -> bytes:
        if only_ai and not (_GENERATOR.search(m[2]) or looks(m[2], AI_NEEDLES)) or not m[2]:
            return m[0]
        labels.append(name)
        return m[1] + m[3]

    return pattern.sub(scrub, body)


def docx(data: bytes) -> tuple[str, bytes] | None:
    parts, labels = _parts(data), []
    if parts is None or "word/document.xml" not in parts:
        return None
    out = {}
    for name, body in parts.items():
        if name.startswith("customXml/") or (name == "docProps/custom.xml" and (looks(body, AI_NEEDLES) or _META.search(body))):
            labels.append(name)
            continue
        if name.startswith("docProps/"):
            for field in ("dc:creator", "cp:lastModifiedBy", "Application", "AppVersion"):
                body = _field(body, field, labels)
        out[name] = body
    if labels and "[Content_Types].xml" in out:
        out["[Content_Types].xml"] = re.sub(rb'(?is)<Override\b[^>]*PartName="/(?:customXml/[^"]*|docProps/custom\.xml)"[^>]*/>', b"", out["[Content_Types].xml"])
    return (",".join(dict.fromkeys(labels)), _zip(out)) if labels else None


def odt(data: bytes) -> tuple[str, bytes] | None:
    parts, labels = _parts(data), []
    if parts is None or not {"content.xml", "meta.xml"} <= set(parts):
        return None
    out = {}
    for name, body in parts.items():
        if name == "meta.xml":
            body = _field(_field(body, "meta:generator", labels, only_ai=False), "dc:creator", labels)
        elif name not in ("content.xml", "styles.xml", "mimetype", "META-INF/manifest.xml") and looks(body, AI_NEEDLES):
            labels.append(name)
            continue
        out[name] = body
    return (",".join(dict.fromkeys(labels)), _zip(out)) if labels else None


READERS = {"png": png, "jpeg": jpeg, "webp": webp, "pdf": pdf, "docx": docx, "odt": odt}
SUFFIXES = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".webp": "webp", ".pdf": "pdf", ".docx": "docx", ".odt": "odt"}


def format_of(path: str, data: bytes) -> str | None:
    """By suffix, else by the first bytes."""
    dot = path.rfind(".")
    name = SUFFIXES.get(path[dot:].lower()) if dot >= 0 else None
    if name:
        return name
    for head, kind in ((b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"RIFF", "webp"), (b"%PDF", "pdf")):
        if data.startswith(head):
            return kind
    if data.startswith(b"PK"):
        return "docx" if b"word/document.xml" in data[:65536] else "odt" if b"content.xml" in data[:65536] else None
    return None


def inspect(path: str, data: bytes) -> tuple[str, str, bytes] | None:
    name = format_of(path, data)
    found = READERS[name](data) if name else None
    return (f"container.{name}_metadata", found[0], found[1]) if found else None


def scanned(units: DataFrame) -> DataFrame:
    """(path, rule_id, evidence, before, after): findings of binary units (path, content), with their sizes."""

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in it:
            rows = [(p, *f[:2], len(c), len(f[2])) for p, c in zip(pdf_["path"], pdf_["content"], strict=True) if c is not None and (f := inspect(p, bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "rule_id", "evidence", "before", "after"]).astype({"before": "int64", "after": "int64"})

    return units.select("path", "content").mapInPandas(scan, "path string, rule_id string, evidence string, before long, after long")


def cleaned(units: DataFrame) -> DataFrame:
    """(path, content): units whose provenance is taken out; others as they are."""

    def clean(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in it:
            yield pd.DataFrame({"path": pdf_["path"], "content": [f[2] if (f := inspect(p, bytes(c))) else c for p, c in zip(pdf_["path"], pdf_["content"], strict=True)]})

    return units.select("path", "content").mapInPandas(clean, "path string, content binary")


def normalised(df: DataFrame, text: str) -> DataFrame:
    """The text column in normal form KC."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in it:
            pdf_[text] = [None if t is None else unicodedata.normalize("NFKC", t) for t in pdf_[text]]
            yield pdf_

    return df.mapInPandas(run, df.schema)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def sample(kind: str, mark: str) -> bytes:
    """A small file of a kind with a mark in its metadata."""
    m = mark.encode()
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"Comment\0" + m) + _chunk(b"IDAT", zlib.compress(b"\0\0")) + _chunk(b"IEND", b"")
    if kind == "jpeg":
        return b"\xff\xd8\xff\xfe" + struct.pack(">H", len(m) + 2) + m + b"\xff\xda\0\x02data\xff\xd9"
    if kind == "webp":
        chunks = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in ((b"VP8X", b"\x04" + b"\0" * 9), (b"VP8 ", b"pix!"), (b"XMP ", m)))
        return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks
    if kind == "pdf":
        return b"%PDF-1.4\n<< /Producer (" + m + b") /Creator (Word) >>\n%%EOF"
    if kind == "docx":
        return _zip({"word/document.xml": b"<w/>", "docProps/core.xml": b"<c><dc:creator>" + m + b"</dc:creator></c>"})
    return _zip({"content.xml": b"<o/>", "meta.xml": b"<m><dc:creator>" + m + b"</dc:creator></m>"})


def samples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(path, content): a file for each document, of six kinds, with its first words as metadata, every other one marked."""
    kinds = list(READERS)

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in it:
            rows = []
            for i, text in zip(pdf_["doc_id"].tolist(), pdf_["text"], strict=True):
                words = "by hand " + "".join(c for c in (text or "")[:200] if c.isascii() and (c.isalpha() or c == " "))
                rows.append((f"f/{i}.{kinds[i % 6]}", sample(kinds[i % 6], "Generated by Claude " + words if i // 6 % 2 else words)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return docs.select("doc_id", "text").mapInPandas(build, "path string, content binary")
