"""Logical schemas and the two views of a 64-bit id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "feat_id bigint, dim int, embedding array<float>"
MUTATION = "seq bigint, op string, feat_id bigint, dim int, embedding array<float>"
LOG = f"{MUTATION}, generation bigint"


def unsigned(feat_id: str | Column) -> Column:
    """The id as a number from 0 to 2**64 - 1; ids are stored as signed longs with the same bits."""
    c = F.col(feat_id) if isinstance(feat_id, str) else feat_id
    wide = c.cast("decimal(20,0)")
    return F.when(c >= 0, wide).otherwise(wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def signed(feat_id: int) -> int:
    """The long with the bits of an unsigned 64-bit id."""
    return feat_id - (1 << 64) if feat_id >> 63 else feat_id
