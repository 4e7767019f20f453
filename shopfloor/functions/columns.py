"""Column expressions for labels, flags and ids, with the null rules of the process tables.

Missing stays missing: nothing here fills a value in.
"""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes null; run it on every source, as NaN sorts above all and passes ``> k``."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def any_positive(cols: list) -> Column:
    """1 if any cell is above 0, else 0; a null cell counts as not positive."""
    return F.coalesce((reduce(F.greatest, map(_col, cols)) if len(cols) > 1 else _col(cols[0])) > 0, F.lit(False)).cast("tinyint")


def type_flags(types: list[str], suffixes: tuple[str, ...] = ("_1", "_2"), prefix: str = "y_type_") -> dict[str, Column]:
    """One flag per type over its cells in all cavities."""
    return {f"{prefix}{t}": any_positive([f"{t}{s}" for s in suffixes]) for t in types}


def count_true(cols: list) -> Column:
    """Number of 0/1 flags that are set."""
    return reduce(add, [_col(c).cast("bigint") for c in cols])


def row_id(prefix: str, *parts: tuple[str, str]) -> Column:
    """``prefix_<tag><value>_...`` from (tag, column) pairs (P10); null where any value is null."""
    return F.concat(F.lit(prefix), *[x for tag, c in parts for x in (F.lit(f"_{tag}"), F.col(c).cast("string"))])


def any_null(cols: list[str]) -> Column:
    """Whether any of the columns is missing; never null."""
    return reduce(or_, [F.col(c).isNull() for c in cols])


def eligible(status: str, cols: list[str]) -> Column:
    """Status present and all process values present."""
    return F.col(status).isNotNull() & ~any_null(cols)


def combine_date_time(date: str, time: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Naive timestamp from date text and time text (P13); malformed text raises."""
    return F.to_timestamp_ntz(F.concat_ws(" ", F.col(date), F.col(time)), F.lit(fmt))


def masked(c: str | Column, low: float = 0) -> Column:
    """The value, or null where it is at most ``low``."""
    return F.when(_col(c) > low, _col(c))


def suspect_high(c: str | Column, high: float = 1500) -> Column:
    """Value above ``high``; a missing value is not suspect."""
    return F.coalesce(_col(c) > high, F.lit(False))


def mask_and_flag(df: DataFrame, cols: list[str], low: float = 0, high: float = 1500) -> DataFrame:
    """Keep ``<c>_raw``, mask values at most ``low`` and add ``<c>_suspect_high``."""
    out = df.withColumns({f"{c}_raw": F.col(c) for c in cols})
    out = out.withColumns({c: masked(f"{c}_raw", low) for c in cols})
    return out.withColumns({f"{c}_suspect_high": suspect_high(c, high) for c in cols})


def threshold_flag(c: str, k: float) -> Column:
    """Value above ``k``; missing where the value is."""
    return F.col(c) > k


def nullable_label(c: str) -> Column:
    """0/1 label that stays missing."""
    return F.col(c).cast("tinyint")
