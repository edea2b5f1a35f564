"""Reproducible draws: a number depends on the seed and the row's own key only.

`rand(seed)` depends on the partition a row sits in, so a retried or
repartitioned job draws again. These draws do not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13


def uniform(seed, *cols) -> Column:
    """Uniform in (0, 1): 52 bits of the md5 of 'seed|key|key..', moved to the cell centre."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + 0.5) / float(16 ** HEX_DIGITS)


def normal(seed, *cols) -> Column:
    """Standard normal by the Box-Muller transform of two uniform draws."""
    u1 = uniform(f"{seed}a", *cols)
    u2 = uniform(f"{seed}b", *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def pick(n: Column, seed, *cols) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(uniform(seed, *cols) * n).cast("long")
