"""Progress of a read or a write, by Spark's own observation of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    phase: str  # reading or writing
    features: int
    feature_total: int | None = None
    bytes: int = 0
    byte_total: int | None = None

    @property
    def fraction(self) -> float | None:
        """By features if their total is known, else by bytes, within 0 and 1; else None."""
        for done, total in ((self.features, self.feature_total), (self.bytes, self.byte_total)):
            if total:
                return min(1.0, max(0.0, done / total))
        return None


def fraction(features: Column, feature_total: Column, done: Column, byte_total: Column) -> Column:
    held = lambda a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / b))
    return F.when(feature_total > 0, held(features, feature_total)).when(byte_total > 0, held(done, byte_total))


def observed(df: DataFrame, phase: str) -> tuple[DataFrame, Observation]:
    """df, and an observation whose ``get`` has the number of features once an action ran over df."""
    watch = Observation(phase)
    return df.observe(watch, F.count(F.lit(1)).alias("features")), watch
