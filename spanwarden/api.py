"""The library's front: scan, clean and report on folders or tables, in a few calls.

    from spanwarden.api import Scan

    scan = Scan.of_folder(spark, "src", exclude=("testdata/**",))
    scan.findings.show()
    scan.write(sys.stdout, "table")
    scan.cleaned().write.parquet("cleaned")     # texts and binaries; files stay as they are
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.operators import audit, binary, files, golang, report
from spanwarden.operators import scan as scanning
from spanwarden.plans.lineage import cut
from spanwarden.plans.shipping import ship
from spanwarden.sources import directory


class Scan:
    """A scan of units (path, content binary)."""

    def __init__(self, units: DataFrame, aggressive: bool = False, disabled: Sequence[str] = (), force_kind: str = "", force_text: bool = False):
        ship(units.sparkSession)
        self.aggressive, self.disabled = aggressive, tuple(disabled)
        self.decoded = files.decoded(units, force_kind, force_text)
        self.units = self.decoded.filter("not skipped")

    @classmethod
    def of_folder(cls, spark: SparkSession, *roots: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = files.MAX_BYTES, hidden: bool = False, **options) -> Scan:
        found = directory.walked(spark, roots, include, exclude, max_bytes, hidden)
        return cls(found.select("path", "content"), **options)

    @classmethod
    def of_texts(cls, units: DataFrame, **options) -> Scan:
        """A scan of (path, text)."""
        return cls(units.select("path", F.encode("text", "UTF-8").alias("content")), **options)

    @property
    def texts(self) -> DataFrame:
        return self.units.filter("kind not in ('image', 'container')").select("path", "text")

    @cached_property
    def raw(self) -> DataFrame:
        """What detectors find, before anything is dropped."""
        size = F.octet_length("content")
        data = binary.scanned(self.units.select("path", "content")).join(self.units.select(F.col("path").alias("u"), size.cast("long").alias("size")), F.col("path") == F.col("u"))
        whole = data.select("path", "rule_id", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(1).alias("line"), F.lit(1).alias("col"), "evidence", F.lit("").alias("replacement"), F.lit(None).cast("string").alias("clean"))
        whole = audit.with_rules(whole.withColumn("detector", F.lit("container")).withColumn("detector_order", F.lit(4)))
        return cut(scanning.raw(self.texts, self.aggressive).unionByName(whole))

    @cached_property
    def findings(self) -> DataFrame:
        return cut(audit.merged(self.raw, golang.protected(self.texts), self.disabled, self.aggressive))

    def fails(self, threshold: str) -> bool:
        """Whether any finding is as sure as the threshold."""
        return bool(self.findings.agg(audit.fails(self.findings, threshold).alias("f")).first()["f"])

    def report(self) -> report.Report:
        counts = files.counters(self.decoded).first().asDict()
        return report.report(self.units.select("path", "text"), self.raw, self.findings, counts)

    def write(self, out: TextIO, how: str = "table") -> None:
        report.write(out, how, self.report())

    def cleaned(self, nfkc: bool = False) -> DataFrame:
        """(path, content, changed): every unit as cleaning leaves it; nothing is written to where it came from."""
        text = audit.cleaned(self.texts, self.findings).select("path", F.col("cleaned").alias("text"))
        text = binary.normalised(text, "text") if nfkc else text
        other = binary.cleaned(self.units.filter("kind in ('image', 'container')").select("path", "content"))
        both = text.select("path", F.encode("text", "UTF-8").alias("new")).unionByName(other.select("path", F.col("content").alias("new")))
        same: Column = F.col("new").eqNullSafe(F.col("content"))
        return self.units.select("path", "content").join(both, "path").select("path", F.col("new").alias("content"), (~same).alias("changed"))

    def after(self) -> Scan:
        """A scan of what cleaning leaves: its findings are what is left over."""
        return Scan(cut(self.cleaned().select("path", "content")), self.aggressive, self.disabled)


