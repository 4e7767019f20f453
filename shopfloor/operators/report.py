"""Counts, rates and reports over process tables.

Rules for unusual input, where a docstring says nothing else: missing values count as not set, not positive and not
equal to a value; repeated rows count each; an empty table gives counts of 0, and rates, least and greatest values that
are missing; grouped reports then have no row.  Columns may have any name but those that a report adds; helper columns
begin with ``_sf_``.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0))


def _long(df: DataFrame, names: list[str], *fields: tuple[str, callable]) -> DataFrame:
    """One row per name from one pass of aggregates."""
    sums = df.agg(*[f(c).alias(f"{i}_{k}") for i, c in enumerate(names) for k, f in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{k}").alias(k) for k, _ in fields]) for i, c in enumerate(names)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def dedup_accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, removed and after (A3)."""
    b, a = before.agg(F.count(F.lit(1)).alias("n_before")), after.agg(F.count(F.lit(1)).alias("n_after"))
    return b.withColumn("_", F.lit(1)).join(a.withColumn("_", F.lit(1)), "_").select("n_before", (F.col("n_before") - F.col("n_after")).alias("n_removed"), "n_after")


def account(before: DataFrame, step: Callable[[DataFrame], DataFrame], measures: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, tuple]:
    """``{measure: (before, after)}`` of a step, counted in the one pass that writes its result.

    The measures are aggregates, observed on the rows that go in and on those that come out; nothing is read twice.
    """
    seen = [Observation(), Observation()]
    named = [v.alias(f"m{i}") for i, v in enumerate(measures.values())]
    write(step(before.observe(seen[0], *named)).observe(seen[1], *named))
    none = before.limit(0).agg(*named).first().asDict()

    def of(observed: Observation) -> dict:
        try:
            return observed.get
        except Py4JJavaError:  # Spark took the measures away with an input or result that it knows to be empty
            return none

    first, last = of(seen[0]), of(seen[1])
    return {k: (first[f"m{i}"], last[f"m{i}"]) for i, k in enumerate(measures)}


def null_account(before: DataFrame, step: Callable[[DataFrame], DataFrame], cols: list[str], write: Callable[[DataFrame], None]) -> DataFrame:
    """``(column_name, n_before, n_after)``: missing cells before and after a step (A4)."""
    found = account(before, step, {c: _n(F.col(f"`{c}`").isNull()) for c in cols}, write)
    return before.sparkSession.createDataFrame([(c, *found[c]) for c in cols], "column_name string, n_before bigint, n_after bigint")


def cell_account(before: DataFrame, step: Callable[[DataFrame], DataFrame], cols: list[str], lo: int, hi: int, write: Callable[[DataFrame], None]) -> DataFrame:
    """``(column_name, value, n_before, n_after)``: cells of each value from ``lo`` to ``hi`` before and after a step (A8); 0 is left out."""
    found = account(before, step, {(c, v): _n(F.col(f"`{c}`") == v) for c in cols for v in range(lo, hi + 1)}, write)
    rows = [(c, v, *n) for (c, v), n in found.items() if any(n)]
    return before.sparkSession.createDataFrame(rows, "column_name string, value bigint, n_before bigint, n_after bigint")


def null_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, n_null)`` (A4)."""
    return _long(df, cols or df.columns, ("n_null", lambda c: _n(F.col(c).isNull())))


def status_crosstab(df: DataFrame, status: str, missing: str) -> DataFrame:
    """``(status, missing, n, eligible)`` (A5)."""
    out = df.groupBy(F.col(status).alias("status"), F.col(missing).alias("missing")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("eligible", F.col("status").isNotNull() & ~F.col("missing"))


def status_totals(df: DataFrame, status: str, missing: str) -> DataFrame:
    """``(status, missing, level, n)``: the crosstab with its totals, from one aggregate over grouping sets (A5).

    ``level`` is 0 for a cell, 1 for a total over ``missing``, 2 for one over ``status`` and 3 for the whole, which tells a
    total's gap from a missing status.
    """
    sets = [("s", "m"), ("s",), ("m",), ()]
    named = df.select(F.col(status).alias("s"), F.col(missing).alias("m"))
    out = named.groupingSets([[F.col(c) for c in x] for x in sets], "s", "m").agg(F.grouping_id("s", "m").cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s").alias("status"), F.col("m").alias("missing"), "level", "n")


def island_summary(df: DataFrame, island: str, counter: str, observable: str) -> DataFrame:
    """Rows, counter span and observable rows of each stretch."""
    return df.where(F.col(island).isNotNull()).groupBy(island).agg(F.count(F.lit(1)).alias("n_rows"), F.min(counter).alias("first"), F.max(counter).alias("last"), _n(F.col(observable)).alias("n_observable"))


def rate(df: DataFrame, flag: str) -> DataFrame:
    """``(n, n_true, rate)``."""
    return df.agg(F.count(F.lit(1)).alias("n"), _n(F.col(flag) == 1).alias("n_true"), F.avg(F.col(flag).cast("double")).alias("rate"))


def cell_value_counts(df: DataFrame, cols: list[str], lo: int, hi: int) -> DataFrame:
    """``(column_name, value, n)`` of cells between lo and hi."""
    long = df.select(*[F.col(c).cast("bigint").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    return long.where(F.col("value").between(lo, hi)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def count_where(df: DataFrame, cond: Column) -> DataFrame:
    """``(n)`` (A9)."""
    return df.agg(_n(cond).alias("n"))


def masked_counts(df: DataFrame, cols: list[str], low: float = 0) -> DataFrame:
    """Cells at most ``low``, per raw column (A10)."""
    return _long(df, cols, ("n_masked", lambda c: _n(F.col(c) <= low)))


def flag_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Set cells per flag, and as ``any`` the rows with one: cells and rows are different counts."""
    some = F.lit(False)
    for c in cols:
        some = some | F.coalesce(F.col(c), F.lit(False))
    return _long(df.withColumn("any", some), [*cols, "any"], ("n_set", lambda c: _n(F.col(c))))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """``(n, n_labelled, n_positive)``."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("n_labelled"), _n(F.col(label) == 1).alias("n_positive"))


def time_extent(df: DataFrame, t: str) -> DataFrame:
    """First and last time as text, rows, and records at a time seen before."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    per = df.groupBy(t).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.date_format(F.min(t), fmt).alias("first"), F.date_format(F.max(t), fmt).alias("last"), F.sum("n").alias("n_rows"), (F.sum("n") - F.count(t) - F.coalesce(F.sum(F.when(F.col(t).isNull(), F.col("n"))), F.lit(0))).alias("n_extra"))


def role_counts(folds: DataFrame) -> DataFrame:
    """Rows of each role of each combination."""
    return folds.groupBy("dataset", "scheme", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


def run_report(quality: DataFrame, timeline: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: shots, defects, rate, records, warm-up rows, episodes (A15); sums first, then a full join."""
    q = quality.groupBy(run).agg(F.count(F.lit(1)).alias("n_shots"), _n(F.col("y_defect") == 1).alias("n_defects"))
    m = timeline.groupBy(run).agg(F.count(F.lit(1)).alias("n_records"), _n(F.col("status") == 1).alias("n_warm"), F.count_distinct("episode_id").alias("n_episodes"))
    out = q.join(m, run, "full").na.fill(0, ["n_shots", "n_defects", "n_records", "n_warm", "n_episodes"])
    return out.withColumn("defect_rate", F.when(F.col("n_shots") > 0, F.col("n_defects") / F.col("n_shots")))


def distinct_sketches(df: DataFrame, cols: list[str], parts: list[str] | None = None, precision: int = 12) -> DataFrame:
    """``(*parts, column_name, n_rows, n_null, sketch)``: a mergeable HyperLogLog sketch of each column, per values of ``parts``.

    One pass and 2^``precision`` registers a column; sketches of several tables or days are merged by ``merged_sketches``.
    """
    parts = parts or []
    text = lambda c: F.col(f"`{c}`").cast("string")
    made = [F.struct(F.count(F.lit(1)).alias("n_rows"), _n(F.col(f"`{c}`").isNull()).alias("n_null"), F.hll_sketch_agg(text(c), precision).alias("sketch")).alias(f"_sf_{i}") for i, c in enumerate(cols)]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"_sf_{i}")[k].alias(k) for k in ("n_rows", "n_null", "sketch")]) for i, c in enumerate(cols)]))
    return df.groupBy(*parts).agg(*made).select(*parts, rows.alias("_sf_x")).select(*parts, "_sf_x.*")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """``(column_name, n_rows, n_null, n_distinct)``, the last by estimate (about 1.6 % at the default precision)."""
    whole = sketches.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("sketch").alias("_sf_s"))
    return whole.select("column_name", "n_rows", "n_null", F.hll_sketch_estimate("_sf_s").alias("n_distinct"))


SUSPECT = 64  # estimates up to this are counted exactly


def run_report_totals(quality: DataFrame, timeline: DataFrame, run: str = "run_id") -> DataFrame:
    """``run_report`` with one more row for all runs (A15): sums are rolled up, rates and episodes worked out anew."""
    rows = run_report(quality, timeline, run)
    sums = [F.sum(c).alias(c) for c in ("n_shots", "n_defects", "n_records", "n_warm", "n_episodes")]
    out = rows.rollup(run).agg(F.grouping_id().cast("int").alias("level"), *sums)
    return out.withColumn("defect_rate", F.when(F.col("n_shots") > 0, F.col("n_defects") / F.col("n_shots")))


def constant_or_sparse(df: DataFrame, max_null_rate: float = 0.5) -> DataFrame:
    """``(column_name, n_distinct, null_rate, constant, sparse)``.

    One pass gives a sketch of each column; those with a small estimate, which could be constant, are counted exactly in
    another.  ``n_distinct`` is exact up to ``SUSPECT`` and an estimate beyond; missing values are no value.
    """
    if not df.columns:
        raise ValueError("no columns")
    near = {r["column_name"]: r for r in merged_sketches(distinct_sketches(df, df.columns)).collect()}  # one row per column
    low = [c for c in df.columns if (near[c]["n_distinct"] if c in near else 0) <= SUSPECT]
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(low)]).first() if low else ()
    counts = {c: r["n_distinct"] for c, r in near.items()} | dict(zip(low, exact))
    rows = []
    for c in df.columns:
        n, missing = near[c]["n_rows"], near[c]["n_null"]
        share = missing / n if n else None
        rows.append((c, counts[c], share, counts[c] <= 1, bool(n) and share > max_null_rate))
    return df.sparkSession.createDataFrame(rows, "column_name string, n_distinct bigint, null_rate double, constant boolean, sparse boolean")


def domain_violations(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """``(column_name, value, n)`` of values outside the domain; missing is in it."""
    return df.where(~F.col(col).isin(allowed)).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(col).alias("column_name"), "value", "n")


def slice_readiness(df: DataFrame, folds: DataFrame, label: str) -> DataFrame:
    """Rows, positives and whether a ranking score can be computed, per slice."""
    used = folds.where(F.col("role") != "excluded").select("dataset", "scheme", "fold", "role", "row_id").join(df.select("row_id", label), "row_id")
    out = used.groupBy("dataset", "scheme", "fold", "role").agg(F.count(F.lit(1)).alias("n"), _n(F.col(label) == 1).alias("n_positive"))
    return out.withColumn("auc_computable", (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contradictory_keys(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys with different measurements (A2); missing equals missing."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*cols)).alias("n_variants")).where("n_variants > 1")


def quality_scorecard(parts: list[tuple[str, str, DataFrame, Column, Column]], unmeasured: list[tuple[str, str]]) -> DataFrame:
    """``(dimension, dataset, numerator, denominator, value, status)``.

    ``parts`` are dimension, dataset, table, and aggregates for numerator and denominator; ``unmeasured`` are listed
    as such instead of guessed.
    """
    out = None
    for dimension, dataset, df, num, den in parts:
        row = df.agg(num.cast("double").alias("numerator"), den.cast("double").alias("denominator"))
        row = row.select(F.lit(dimension).alias("dimension"), F.lit(dataset).alias("dataset"), "numerator", "denominator", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("value"), F.lit("measured").alias("status"))
        out = row if out is None else out.unionByName(row)
    none = F.lit(None).cast("double")
    for dimension, dataset in unmeasured:
        out = out.unionByName(out.sparkSession.range(1).select(F.lit(dimension).alias("dimension"), F.lit(dataset).alias("dataset"), none.alias("numerator"), none.alias("denominator"), none.alias("value"), F.lit("not measured").alias("status")))
    return out
