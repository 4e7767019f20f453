"""Column expressions on words: maximal runs of characters other than space and U+0009..U+000D."""

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone go the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text, in order; null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def new_key() -> int:
    """A secret number for ``keyed``, chosen by the driver for one run."""
    return int.from_bytes(os.urandom(8), "little", signed=True)


def keyed(key: int, *parts: Column) -> Column:
    """64-bit hash by a secret key: nobody can prepare words that collide."""
    return F.xxhash64(F.lit(key).cast("bigint"), *parts)
