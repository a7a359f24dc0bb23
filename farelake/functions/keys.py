"""Row keys derived from column values."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from farelake.schema import KEY_COLUMNS


def row_key(cols: Sequence[str] = KEY_COLUMNS, null_text: str = "nan", length: int = 32) -> Column:
    """First ``length`` hex digits of SHA-256 over the untrimmed values, joined by a bar.

    ``concat`` with explicit separators, since ``concat_ws`` would drop NULL parts.
    """
    parts = []
    for i, name in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(name), F.lit(null_text)))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, length)


def key_slot(cols: Sequence[str], seed: int, slots: int) -> Column:
    """Stable slot number 0..slots-1 of a row: same rows, same slots, on any partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("int")
