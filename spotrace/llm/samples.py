"""Bounded samples of a table for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def smallest_hashes(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``keys``.

    Only about twice as many rows pass a first filter on the hash, so tasks send few rows whatever the
    size of the table.  Counting the rows starts a job.
    """
    share = min(1.0, (2 * most + 50) / max(1, rows.count()))
    small = F.pmod(F.xxhash64(*keys), F.lit(_PARTS)) < int(share * _PARTS)
    return rows.where(small).orderBy(F.pmod(F.xxhash64(*keys), F.lit(_PARTS)), *keys).limit(most)
