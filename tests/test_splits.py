"""Roles against published counts, and what the splits must never do."""

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import report, splits, validate
from shopfloor.plans import casting

QUALITY = [1099, 1157, 397, 600, 725, 4, 635]
RECORDS = [1106, 1296, 743, 623, 733, 4, 656]
ELIGIBLE = [1105, 1183, 417, 623, 733, 4, 656]


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda prefix, sizes: spark.createDataFrame([(r, s + 1, f"{prefix}_r{r}_s{s + 1}", r * 10000 + s) for r, n in enumerate(sizes) for s in range(n)], "run_id bigint, Shot bigint, row_id string, source_row bigint")
    eligible = F.create_map(*[F.lit(x) for r, n in enumerate(ELIGIBLE) for x in (r, n)])
    timeline = make("m41", RECORDS).withColumn("gate_eligible", F.col("Shot") <= eligible[F.col("run_id").cast("int")]).withColumn("episode_id", F.lit(None).cast("string"))
    return make("q42", QUALITY).cache(), timeline.cache()


@pytest.fixture(scope="module")
def folds(tables):
    return casting.folds_table(*tables).cache()


def roles(folds, dataset, scheme, fold):
    got = {r["role"]: r["n"] for r in report.role_counts(folds.where((F.col("dataset") == dataset) & (F.col("scheme") == scheme) & (F.col("fold") == fold))).collect()}
    return tuple(got.get(r, 0) for r in ("train", "validation", "test", "excluded"))


def test_within_run(folds):
    assert roles(folds, "q42", "within_run", "primary") == (2579, 647, 1387, 4)


@pytest.mark.parametrize("fold,q,m", [
    ("0", (2879, 635, 1099, 4), (2956, 656, 1105, 444)), ("1", (2821, 635, 1157, 4), (2878, 656, 1183, 444)), ("2", (3581, 635, 397, 4), (3644, 656, 417, 444)),
    ("3", (3378, 635, 600, 4), (3438, 656, 623, 444)), ("4", (3253, 635, 725, 4), (3328, 656, 733, 444)), ("6", (3253, 725, 635, 4), (3328, 733, 656, 444)),
])
def test_run_holdout(folds, fold, q, m):
    assert roles(folds, "q42", "run_holdout", fold) == q
    assert roles(folds, "m41", "run_holdout", fold) == m


@pytest.mark.parametrize("fold,q,m", [
    ("2", (1099, 1157, 397, 1964), (1105, 1183, 417, 2456)), ("3", (2256, 397, 600, 1364), (2288, 417, 623, 1833)),
    ("4", (2653, 600, 725, 639), (2705, 623, 733, 1100)), ("6", (3253, 725, 635, 4), (3328, 733, 656, 444)),
])
def test_forward_run(folds, fold, q, m):
    assert roles(folds, "q42", "forward_run", fold) == q
    assert roles(folds, "m41", "forward_run", fold) == m


def test_combinations_coverage_and_overlap(tables, folds):
    assert folds.select("dataset", "scheme", "fold").distinct().count() == 22
    assert folds.count() == (4617 + 5161) * 11
    assert validate.role_overlap(folds).count() == 0
    assert validate.fold_coverage(tables[0], folds.where("dataset = 'q42'")).count() == 0


def test_shares_are_exact_fractions(spark):
    for n, want in ((20, (11, 3, 6, 0)), (19, (0, 0, 0, 19)), (90, (50, 13, 27, 0))):
        df = spark.range(n).select(F.lit(0).alias("run"), F.col("id").alias("o"))
        got = {r["role"]: r["count"] for r in splits.ratio_split(df, "run", "o").groupBy("role").count().collect()}
        assert tuple(got.get(r, 0) for r in ("train", "validation", "test", "excluded")) == want


def test_equal_times_share_a_role(spark):
    df = spark.range(20).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id div 2 as int) * 5)").alias("t"), "id")
    got = {r["role"]: r["count"] for r in splits.time_ratio_split(df, "t").groupBy("role").count().collect()}
    assert got == {"train": 10, "validation": 4, "test": 6}
    assert splits.time_ratio_split(df.limit(0), "t").count() == 0
