"""Seeded splits by hash share, which need no order and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_split(key: Column, parts: dict[str, int], seed: int = 0) -> Column:
    """The part of a row by md5 of seed and key: a part gets its number of each 100 hash values."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % 100
    out, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(parts.items()):
        out = F.when(place < upto, name).otherwise(out)
        upto -= share
    return out
