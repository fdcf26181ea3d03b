"""Randomness that depends on the data and a seed only, so results are the same on any partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int | str, *cols: Column | str) -> Column:
    """Sorting rows by this text shuffles them: md5 of the seed and the columns, joined by `|`."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of that md5."""
    return F.conv(F.substring(shuffle_key(seed, *cols), 1, 8), 16, 10).cast("double") / 4294967296.0


def scope_seed(base: int, scope_index: int, bootstrap: bool = False) -> int:
    """Seeds of scopes lie 10,000 apart, those of bootstraps 100,000 beyond."""
    return base + 10_000 * scope_index + (100_000 if bootstrap else 0)
