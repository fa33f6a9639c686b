"""Seeded, partitioning-independent pseudo-random numbers.

``F.rand(seed)`` depends on the partition layout; these are functions of the
row key only, so a re-run, a retry after executor loss or a different number
of partitions gives the same draws. DuckDB computes the same values (md5 +
hex parse), which the oracle relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2 ** 52)


def _key(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def uniform(seed, *cols) -> Column:
    """u in (0, 1): (first 13 hex digits of md5('seed:k1:k2...') + 0.5) / 2^52."""
    h = F.substring(F.md5(_key(seed, cols)), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)


def shuffle_key(seed, *cols) -> Column:
    """Sort key of a seeded shuffle (the 52-bit hash as a double)."""
    h = F.substring(F.md5(_key(seed, cols)), 1, 13)
    return F.conv(h, 16, 10).cast("double")


def gumbel_key(log_weight: Column, seed, *cols) -> Column:
    """Gumbel-top-k key: ``log w - ln(-ln u)``.

    The k largest keys are a weighted sample without replacement with
    weights ``w`` (Efraimidis and Spirakis 2006; Kool et al. 2019).
    """
    u = uniform(seed, *cols)
    return log_weight - F.ln(-F.ln(u))
