"""One-to-one links between tables, and how well linked tables agree.

Rules for unusual input: a null key matches nothing, so its row is kept without a match on the left and is a gap on either
side; repeated keys on the right repeat left rows (``report.duplicate_keys`` finds them); missing cells are equal to
missing ones; helper columns begin with ``_sf_``, which is reserved; empty tables give empty results.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], take: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Left rows with ``take`` of their match; keys are unique on the right, so no row is gained or lost."""
    rename = rename or {}
    return left.join(right.select(*keys, *[F.col(c).alias(rename.get(c, c)) for c in take]), keys, "left")


def match_coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on one side only: ``side`` is ``a`` or ``b``."""
    only = lambda x, y, side: x.select(*keys).join(y.select(*keys), keys, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def cell_agreement(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``(column_name, n_rows, n_equal)`` over matched rows; missing equals missing, numbers compare as doubles."""
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"_sf_b_{c}") for c in cols])
    both = a.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).join(right, keys)
    sums = both.agg(F.count(F.lit(1)).alias("_sf_n"), *[F.coalesce(F.sum(F.col(c).eqNullSafe(F.col(f"_sf_b_{c}")).cast("bigint")), F.lit(0)).alias(c) for c in cols])
    return sums.select("_sf_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_equal")) for c in cols])).alias("_sf_x")).select("_sf_x.column_name", F.col("_sf_n").alias("n_rows"), "_sf_x.n_equal")


def match_rate(agreement: DataFrame) -> DataFrame:
    """Equal cells over compared cells."""
    return agreement.agg(F.sum("n_equal").alias("n_equal"), F.sum("n_rows").alias("n_cells")).withColumn("rate", F.col("n_equal") / F.col("n_cells"))


def join_gaps(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Violations: unmatched keys, and matched keys with an unequal cell (V1)."""
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"_sf_b_{c}") for c in cols])
    equal = F.lit(True)
    for c in cols:
        equal = equal & F.col(f"`{c}`").cast("double").eqNullSafe(F.col(f"_sf_b_{c}"))
    unequal = a.join(right, keys).where(~equal).select(*keys, F.lit("unequal").alias("side"))
    return match_coverage(a, b, keys).unionByName(unequal)
