"""Title and text expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_title(c: Column | str) -> Column:
    """Underscores become spaces, then Unicode white space goes at both ends; null stays null."""
    return F.btrim(F.translate(_c(c), "_", " "), F.lit(WHITE_SPACE))


def ascii_fold(c: Column | str) -> Column:
    """A-Z to lower case and nothing else (no Unicode folding)."""
    return F.translate(_c(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaces_to_underscores(c: Column | str) -> Column:
    return F.translate(_c(c), " ", "_")


def underscores_to_spaces(c: Column | str) -> Column:
    return F.translate(_c(c), "_", " ")
