"""Text cleaning as Column expressions."""

from pyspark.sql import Column, functions as F

from farelake.schema import MISSING_TOKENS

# Code points of the characters Python's str.strip() removes.
WHITESPACE = "".join(
    map(
        chr,
        (
            0x9, 0xa, 0xb, 0xc, 0xd, 0x1c, 0x1d, 0x1e, 0x1f, 0x20, 0x85, 0xa0, 0x1680, 0x2000,
            0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200a, 0x2028,
            0x2029, 0x202f, 0x205f, 0x3000,
        ),
    )
)


def strip(col: Column) -> Column:
    """Remove all surrounding whitespace (Spark's plain ``trim`` only removes spaces)."""
    return F.trim(col, F.lit(WHITESPACE))


def present(*names: str) -> Column:
    """True where every named column is neither NULL nor blank."""
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(name).isNotNull() & (F.col(name) != "")
    return cond


def null_or_blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def missing_to_null(col: Column) -> Column:
    """NULL for every cell text that stands for a missing value."""
    return F.when(~col.isin(*MISSING_TOKENS), col)
