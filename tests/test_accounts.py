"""Accounts of the writing pass, sketches, totals, hash trees, digests, footers and stored buckets."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import ordered, report, validate
from shopfloor.sources import files


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, 0, i % 4, None if i % 5 == 0 else 2.0, i % 4) for i in range(40)]
    rows += [(100 + i, 0, i % 4, None if i % 5 == 0 else 2.0, i % 4) for i in range(20)]
    return spark.createDataFrame(rows, "id bigint, run_id bigint, c int, `odd name` double, source bigint").withColumn("source_row", F.col("id"))


def test_before_and_after_in_one_pass(spark, cells, tmp_path):
    step = lambda d: ordered.dedup_keep_first(d, ["run_id"], ["id"], "source_row")
    once = step(cells)
    path = str(tmp_path / "out")
    got = report.null_account(cells, step, ["odd name", "c"], lambda d: d.write.parquet(path))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {"odd name": (12, once.where("`odd name` is null").count()), "c": (0, 0)}
    assert spark.read.parquet(path).count() == once.count() < cells.count()
    got = report.cell_account(cells, step, ["c"], 2, 3, lambda d: d.write.mode("overwrite").parquet(path))
    assert {(r.value, r.n_before, r.n_after) for r in got.collect()} == {(v, 15, once.where(f"c = {v}").count()) for v in (2, 3)}
    scans = []
    report.account(cells, step, {"n": F.count(F.lit(1))}, lambda d: (scans.append(d._jdf.queryExecution().optimizedPlan().toString()), d.write.mode("overwrite").parquet(path)))
    assert scans[0].count("LogicalRDD") == 1 and scans[0].count("CollectMetrics") == 2
    empty = report.null_account(cells.limit(0), step, ["c"], lambda d: d.write.mode("overwrite").parquet(path))
    assert [tuple(r) for r in empty.collect()] == [("c", 0, 0)]


def test_sketches_merge_and_constants_are_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("seven"), F.lit("x").alias("one"), F.when(F.col("id") % 3 == 0, 1).alias("thin"), F.lit(None).cast("int").alias("none"), (F.col("id") % 2).alias("column_name"))
    parts = [report.distinct_sketches(p, df.columns) for p in (df.where("k < 3000"), df.where("k >= 2000"))]
    merged = {r["column_name"]: r for r in report.merged_sketches(parts[0].unionByName(parts[1])).collect()}
    assert merged["k"]["n_rows"] == 6000 and abs(merged["k"]["n_distinct"] - 5000) < 250 and merged["seven"]["n_distinct"] == 7
    by_day = report.distinct_sketches(df.withColumn("day", F.col("k") % 3), ["seven"], ["day"])
    assert by_day.count() == 3 and report.merged_sketches(by_day).first()["n_distinct"] == 7
    got = {r["column_name"]: (r["n_distinct"], round(r["null_rate"], 3), r["constant"], r["sparse"]) for r in report.constant_or_sparse(df).collect()}
    assert abs(got.pop("k")[0] - 5000) < 250
    assert got == {"seven": (7, 0, False, False), "one": (1, 0, True, False), "thin": (1, 0.667, True, True), "none": (0, 1, True, True), "column_name": (2, 0, False, False)}
    assert {tuple(r)[1:] for r in report.constant_or_sparse(df.limit(0)).collect()} == {(0, None, True, False)}


def test_totals_tell_missing_from_all(spark):
    df = spark.createDataFrame([(0, True)] * 3 + [(None, False)] * 2 + [(1, False)], "status int, missing boolean")
    got = {tuple(r) for r in report.status_totals(df, "status", "missing").collect()}
    assert got == {(0, True, 0, 3), (None, False, 0, 2), (1, False, 0, 1), (0, None, 1, 3), (None, None, 1, 2), (1, None, 1, 1), (None, True, 2, 3), (None, False, 2, 3), (None, None, 3, 6)}


def test_hash_tree_names_the_keys_that_differ(spark):
    rnd = random.Random(1)
    rows = [(i, f"k{i % 50}", rnd.random() if i % 9 else None) for i in range(3000)] + [(None, "k", 1.0), (5, "k5", 2.0), (5, "k5", 2.0)]
    a = spark.createDataFrame(rows, "k bigint, s string, change double").repartition(4)
    assert validate.changed_keys(a, a.repartition(2), ["k"]).count() == 0
    b = a.where("k != 17 or k is null").withColumn("change", F.when(F.col("k") == 300, None).otherwise(F.col("change")))
    b = b.unionByName(spark.createDataFrame([(9000, "new", 1.0), (5, "k5", 2.0)], a.schema))
    assert {tuple(r) for r in validate.changed_keys(a, b, ["k"]).collect()} == {(17, "removed"), (9000, "added"), (5, "changed")} | ({(300, "changed")} if rows[300][2] is not None else set())
    trees = [validate.hash_tree(x, ["k", "s"]).cache() for x in (a, b)]
    top = trees[0].where("level = 0").first()
    assert (top["n"], trees[0].where("level = 3").agg(F.sum("n")).first()[0]) == (3003, 3003)
    assert validate.changed_keys(a, b, ["k", "s"], tuple(trees)).count() == validate.changed_keys(a, b, ["k"]).count()
    assert validate.differing_ranges(*trees).count() <= 5
    assert validate.changed_keys(a.limit(0), a.limit(0), ["k"]).count() == 0
    nulls = a.where("k is null")
    assert [tuple(r) for r in validate.changed_keys(nulls, nulls.limit(0), ["k"]).collect()] == [(None, "removed")]


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 5)  # a hole: no disk is taken
    state, part = hashlib.sha256(), bytes(1 << 24)
    for _ in range(128):
        state.update(part)
    state.update(bytes(5))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = files.file_digests(spark, [str(tmp_path)]).collect()
    assert [(os.path.basename(r.path), r.bytes, r.sha256) for r in got] == [("large.bin", (2 << 30) + 5, state.hexdigest())]
    assert files.file_digests(spark, [str(tmp_path / "absent")]).count() == 0


def test_footers_are_held_against_the_declaration(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = {"a": "bigint not null", "b": "tinyint", "flag": "boolean not null", "t": "timestamp_ntz"}
    df = spark.createDataFrame([(1, 2, True), (2, None, False)], "a int, b int, flag boolean").withColumn("t", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    files.write_table(df, path, kinds)
    assert files.footer_problems(spark, path, kinds).count() == 0
    assert sorted(r.a for r in files.read_table(spark, path, "a bigint, b tinyint, flag boolean, t timestamp_ntz", checked=True).collect()) == [1, 2]
    spark.createDataFrame([(3, 4)], "a int, b tinyint").write.mode("append").parquet(path)
    got = {(r.column_name, r.problem) for r in files.footer_problems(spark, path, {**kinds, "more": "int"}).collect()}
    assert got == {("a", "stored as int32"), ("flag", "missing"), ("t", "missing"), ("more", "missing")}
    with pytest.raises(ValueError, match="flag missing"):
        files.read_table(spark, path, "a bigint, b tinyint, flag boolean, t timestamp_ntz", checked=True)
    with pytest.raises(Exception, match="missing value in b"):
        files.write_table(df, str(tmp_path / "u"), {"a": "bigint", "b": "tinyint not null"})


def test_stored_buckets_are_joined_without_exchange(spark):
    a = spark.range(200).select((F.col("id") % 7).alias("run_id"), F.col("id").alias("Shot"), F.lit(1).alias("x"))
    b = a.withColumnRenamed("x", "y")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (files.store_bucketed(df, ["run_id", "Shot"], 4) for df in (a, b))
        joined = left.join(right, ["run_id", "Shot"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 200
        assert left.groupBy("run_id", "Shot").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
