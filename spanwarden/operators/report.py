"""Reports of a scan: JSON, YAML, table, SARIF, written row by row.

The totals are a few aggregates; findings come in their order through ``toLocalIterator``, so a report
holds one partition at a time. For results of any size write the findings' DataFrame itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.operators import audit

DISCLAIMER = "Marks are hints of tools, not proof of authorship."
LEVELS = {"error": "error", "warning": "warning"}
FIELDS = ("rule_id", "family", "severity", "confidence", "message", "evidence", "snippet", "symbol", "clean", "replacement")
_PAINT = {"head": "\033[1;36m", "strong": "\033[1;31m", "mild": "\033[33m", "weak": "\033[2m", "plain": "\033[36m"}


@dataclass
class Report:
    """The totals of a scan, and its findings (path, start, end, line, col, and FIELDS)."""

    findings: DataFrame
    counts: dict[str, int]
    hits: dict[str, int]
    score: dict[str, Any]
    eligible: list[str] = field(default_factory=list)
    after: dict[str, Any] | None = None

    def rows(self) -> Iterator[dict[str, Any]]:
        for r in audit.ordered(self.findings).toLocalIterator():
            yield r.asDict()

    def layers(self) -> dict[str, int]:
        return {"a": sum(self.hits.get(d, 0) for d in ("unicode", "stamp", "astgo", "c2pa")), "files": self.hits.get("container", 0), "b": len(self.eligible)}


def score(findings: DataFrame, scanned: int) -> dict[str, Any]:
    """percent, agent, label, confidence, agents (votes) and evidence of a scan."""
    voted = {r["agent"]: r["hard"] + r["soft"] for r in audit.votes(findings).collect()}  # an agent each
    out = {"percent": audit.percent(findings, scanned).first()["percent"], **audit.picked(findings).first().asDict(), "agents": voted}
    return out | {"evidence": [r["evidence"] for r in audit.told(findings).orderBy("place").collect()]}


def report(units: DataFrame, raw: DataFrame, findings: DataFrame, counts: dict[str, int], eligible: int = 8) -> Report:
    """A report of merged ``findings``; ``raw`` are the detectors' hits before merging."""
    hits = {r["detector"]: r["hits"] for r in audit.detector_hits(raw).collect()}  # a row a detector
    worth = [r["path"] for r in audit.survey(units, findings).filter("recommended").orderBy("path").limit(eligible).collect()]
    return Report(audit.enriched(findings, units), counts, hits, score(findings, counts["scanned"]), worth)


def _finding(r: dict[str, Any]) -> dict[str, Any]:
    span = {"file": r["path"], "start": r["start"], "end": r["end"], "line": r.get("line"), "col": r.get("col")}
    rest = {k: r[k] for k in FIELDS if r.get(k)}
    return {"rule_id": r["rule_id"], "span": span, **{k: v for k, v in rest.items() if k != "rule_id"}}


def _totals(r: Report) -> dict[str, Any]:
    c = r.counts
    out = {"files_scanned": c["scanned"], "files_skipped": c["skipped"], "text_files": c["texts"], "image_files": c["images"], "doc_files": c["docs"]}
    out |= {"detector_hits": r.hits, "layers": r.layers(), "score": r.score, "disclaimer": DISCLAIMER}
    return out | ({"after": r.after} if r.after else {})


def write_json(out: TextIO, r: Report) -> None:
    head = json.dumps(_totals(r), indent=2, ensure_ascii=False)
    out.write(head[:-2] + ',\n  "findings": ')
    first = True
    for row in r.rows():
        out.write(("[" if first else ",") + "\n    " + json.dumps(_finding(row), indent=2, ensure_ascii=False).replace("\n", "\n    "))
        first = False
    out.write("null\n}\n" if first else "\n  ]\n}\n")


def _yaml(value: Any, depth: int) -> str:
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"\n{pad}{k}:{_yaml(v, depth + 1)}" for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"\n{pad}-{_yaml(v, depth + 1)}" for v in value)
    return " " + json.dumps(value, ensure_ascii=False)  # a JSON scalar is a YAML one


def write_yaml(out: TextIO, r: Report) -> None:
    out.write(_yaml(_totals(r), 0).lstrip("\n") + "\nfindings:")
    some = False
    for row in r.rows():
        out.write("\n-" + _yaml(_finding(row), 1))
        some = True
    out.write("\n" if some else " null\n")


def colours(out: TextIO) -> bool:
    return not os.environ.get("NO_COLOR") and out.isatty()


def _short(text: str | None, most: int) -> str:
    text = " ".join((text or "").split())
    return text if len(text) <= most else text[: most - 1] + "..."


def _tag(row: dict[str, Any]) -> str:
    if row["rule_id"].startswith("statwm."):
        return "B"
    return "Files" if row["rule_id"].startswith("container.") or row["family"] in ("c2pa", "metadata") else "A"


def write_table(out: TextIO, r: Report, colour: bool | None = None) -> None:
    colour = colours(out) if colour is None else colour
    paint = lambda how, text: f"{_PAINT[how]}{text}\033[0m" if colour and text else text
    sure = {"certain": "strong", "likely": "mild"}
    last, count = None, {"certain": 0, "likely": 0, "heuristic": 0}
    for row in r.rows():
        if row["path"] != last:
            out.write(("" if last is None else "\n") + paint("head", row["path"]) + "\n")
            last = row["path"]
        count[row["confidence"] if row["confidence"] in count else "heuristic"] += 1
        place = f"{row.get('line')}:{row.get('col')}"
        out.write(f"  {_tag(row):<5}  {place:<8}  {row['rule_id']}  {paint(sure.get(row['confidence'], 'weak'), row['confidence'])}\n")
        if row.get("symbol"):
            out.write(f"            {paint('plain', 'symbol ' + row['symbol'])}\n")
        if shown := _short(row.get("snippet"), 100) or _short(row.get("message"), 96):
            out.write(f"            {paint('weak', shown)}\n")
    c, n = r.counts, sum(count.values())
    if n:
        out.write(f"\n{c['scanned']} files scanned, {c['skipped']} skipped  text={c['texts']}  images={c['images']}  docs={c['docs']}\n{n} findings   " + "  ".join(f"{k}={v}" for k, v in count.items()) + "\n")
    else:
        out.write(f"No findings in {c['scanned']} file(s).\n")
    layers = r.layers()
    out.write(f"layers\n  A      {layers['a']} hits\n  Files  {layers['files']} hits\n  B      {layers['b'] or 'none'}\n" + "".join(f"         {p}\n" for p in r.eligible))
    change = lambda k, unit: f"{r.score[k]}{unit}" if not r.after or (unit == "" and r.after[k] == r.score[k]) else f"{r.score[k]}{unit} → {r.after[k]}{unit}"
    high = "strong" if r.score["percent"] >= 50 else "mild" if r.score["percent"] >= 20 else "weak"
    out.write(f"AI trace  {paint(high, change('percent', '%'))}\nlikely agent  {paint('plain', change('label', ''))}\n")
    if r.score["confidence"] != "none":
        out.write(f"origin confidence  {r.score['confidence']}\n")
    out.writelines(f"  evidence  {e}\n" for e in r.score["evidence"][:3])


def write_sarif(out: TextIO, r: Report, version: str = "dev") -> None:
    first = audit.ordered(r.findings).groupBy("rule_id").agg(F.min(F.struct("path", "start", (-F.col("end")).alias("minus"), "rule_id")).alias("at"), F.first("message").alias("message"))
    rules = [{"id": x["rule_id"], "shortDescription": {"text": x["message"]}} for x in sorted(first.collect(), key=lambda x: x["at"])]  # a row a rule
    props = {"aiTracePercent": r.score["percent"], "likelyAgent": r.score["label"], "originConfidence": r.score["confidence"]}
    props |= {"originEvidence": r.score["evidence"]} if r.score["evidence"] else {}
    props |= {"afterPercent": r.after["percent"], "afterAgent": r.after["label"]} if r.after else {}
    driver = json.dumps({"name": "spanwarden", "version": version, "rules": rules}, ensure_ascii=False)
    out.write(f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {driver}}}, "properties": {json.dumps(props, ensure_ascii=False)}, "results": [')
    for n, row in enumerate(r.rows()):
        said = " · ".join(x for x in (f"symbol {row['symbol']}" if row.get("symbol") else "", row.get("snippet") or row.get("message") or "") if x)
        region = {"startLine": row.get("line"), "startColumn": row.get("col"), "byteOffset": row["start"], "byteLength": row["end"] - row["start"], "snippet": {"text": row.get("snippet") or ""}}
        result = {"ruleId": row["rule_id"], "level": LEVELS.get(row["severity"], "note"), "message": {"text": said}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": row["path"]}, "region": region}}]}
        out.write(("," if n else "") + "\n" + json.dumps(result, ensure_ascii=False))
    out.write("]}]}\n")


WRITERS = {"": write_table, "table": write_table, "json": write_json, "yaml": write_yaml, "yml": write_yaml, "sarif": write_sarif}


def write(out: TextIO, how: str, r: Report) -> None:
    """Write a report by the name of its format."""
    name = how.strip().lower()
    if name not in WRITERS:
        raise ValueError(f"unknown format {how!r} (table, json, yaml, sarif)")
    WRITERS[name](out, r)
