"""Draws and orders from hashes of keys: the same in any partitioning, and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*parts) -> Column:
    """A text to sort by in place of a seeded shuffle."""
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts)))


def draw(*parts) -> Column:
    """A uniform number in [0, 1) from 52 bits of the hash."""
    return F.conv(F.substring(order_key(*parts), 1, 13), 16, 10).cast("double") / float(2**52)


def drawn_below(share: float, *parts) -> Column:
    """draw(*parts) < share: hex digits compare as their numbers do, and digits that equal the bound's are followed by more."""
    return order_key(*parts) < F.lit(f"{math.ceil(share * 2**52):013x}")


def order_sql(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def draw_sql(*parts: str) -> str:
    return f"(('0x' || substr({order_sql(*parts)}, 1, 13))::bigint / 4503599627370496.0)"
