"""A scan: units to merged findings, with every detector and protection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.operators import audit, detect, golang
from spanwarden.plans.shipping import ship


def raw(units: DataFrame, aggressive: bool = False) -> DataFrame:
    """All detectors' findings of text units (path, text), with rules, before merging."""
    ship(units.sparkSession)
    found = golang.outside_strings(detect.detect(units, aggressive, containers=True), units)
    idents = golang.identifier_marks(units).withColumn("detector", F.lit("astgo")).withColumn("detector_order", F.lit(5))
    return audit.with_rules(found.unionByName(idents))


def scan(units: DataFrame, aggressive: bool = False, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Merged findings; what Go's literals protect is reported only."""
    return audit.merged(raw(units, aggressive), golang.protected(units), disabled, aggressive)
