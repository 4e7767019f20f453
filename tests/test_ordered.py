"""Runs, first of equals, episodes and history on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from shopfloor.functions import columns as fn
from shopfloor.operators import ordered, validate

RUN, ORDER = ["run_id"], "source_row"


def rows(spark, **cols):
    names = list(cols)
    data = [(i, *x) for i, x in enumerate(zip(*cols.values()))]
    kinds = {"shot": "bigint", "status": "int", "cycle": "double", "run_id": "bigint", "missing": "boolean", "id": "bigint"}
    return spark.createDataFrame(data, "source_row bigint, " + ", ".join(f"{n} {kinds[n]}" for n in names))


def values(df, col):
    return [r[0] for r in df.orderBy("source_row").select(col).collect()]


@pytest.mark.parametrize("block", [1, 7, 512])
def test_runs_do_not_depend_on_blocks(spark, block):
    df = rows(spark, shot=[1, 2, 2, 5, 1, 3, 2])
    assert values(ordered.segment_on_decrease(df, "source_row", "shot", block=block), "run_id") == [0, 0, 0, 0, 1, 1, 2]
    rnd = random.Random(block)
    shots = [rnd.randrange(20) for _ in range(900)]
    want, n = [], 0
    for i, s in enumerate(shots):
        n += i > 0 and s < shots[i - 1]
        want.append(n)
    df = rows(spark, shot=shots).repartition(5)
    assert values(ordered.segment_on_decrease(df, "source_row", "shot", block=block), "run_id") == want


def test_runs_per_machine_and_empty(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "b", 9), (2, "a", 1), (3, "b", 9)], "source_row bigint, m string, shot bigint")
    assert values(ordered.segment_on_decrease(df, "source_row", "shot", ("m",), block=2), "run_id") == [0, 0, 1, 0]
    assert ordered.segment_on_decrease(df.limit(0), "source_row", "shot").count() == 0


def test_keep_first_treats_missing_as_equal_and_keeps_runs_apart(spark):
    df = rows(spark, id=[1, 2, 3, 4], run_id=[0, 0, 0, 1], shot=[1, 1, 2, 1], cycle=[None, None, 7.0, None])
    kept = ordered.dedup_keep_first(df, RUN, ["id"], ORDER)
    assert values(kept, "id") == [1, 3, 4]
    assert values(ordered.with_position(kept, RUN, ORDER, "p"), "p") == [0, 1, 0]


def test_episodes(spark):
    df = rows(spark, run_id=[2] * 6, status=[1, 1, None, 1, 0, 1], shot=[4, 9, 10, 11, 12, 13])
    assert values(ordered.islands(df, RUN, ORDER, "status"), "episode_id") == ["r2_e1", "r2_e1", None, "r2_e2", None, "r2_e3"]


def test_history_columns(spark):
    one = [0] * 8
    df = rows(spark, run_id=one[:3], cycle=[5.0, None, 2.0])
    assert values(df.withColumn("x", ordered.lag_feature("cycle", RUN, ORDER)), "x") == [None, 5.0, None]
    df = rows(spark, run_id=one[:7], cycle=[9.0, 1.0, 2.0, None, 3.0, 4.0, 5.0])
    assert values(df.withColumn("x", ordered.rolling_max("cycle", 5, RUN, ORDER)), "x") == [None, 9, 9, 9, 9, 9, 4]
    df = rows(spark, run_id=one[:3], missing=[True, False, False])
    assert values(df.withColumn("x", ordered.rolling_count_true(F.col("missing"), 20, RUN, ORDER)), "x") == [None, 1, 1]
    df = rows(spark, run_id=one[:4], shot=[3, 4, 8, 8])
    assert values(df.withColumn("x", ordered.counter_gap("shot", RUN, ORDER)), "x") == [None, 0, 3, 0]
    df = rows(spark, run_id=one[:4], shot=[1, 2, 5, 6], status=[0, 1, 0, 1])
    assert values(df.withColumn("x", ordered.since_last("shot", "status", RUN, ORDER)), "x") == [None, None, 3, 4]
    df = rows(spark, run_id=one[:4], status=[1, 1, 0, 1])
    assert values(ordered.prior_islands(df, RUN, ORDER, "status"), "oracle_prior_episodes") == [0, 1, 1, 1]


def test_history_uses_one_shuffle_and_no_single_partition(spark):
    df = rows(spark, run_id=[0, 1], shot=[1, 1], status=[0, 1], cycle=[1.0, 2.0], missing=[False, False]).repartition(3)
    plan = ordered.history(df, RUN, ORDER, "shot", "status", "cycle", "missing")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(run_id") == 1 and "SinglePartition" not in plan


@pytest.mark.parametrize("block", [20, 33, 4096])
def test_blocked_history_equals_plain_windows(spark, block):
    rnd = random.Random(block)
    n = 700
    df = rows(spark, run_id=[i // 300 for i in range(n)], shot=[i % 300 * 2 + rnd.randrange(2) for i in range(n)], status=[rnd.choice([1, 1, 0, 0, 0, None]) if rnd.random() < 0.3 else 0 for _ in range(n)], cycle=[rnd.choice([None, rnd.random()]) for _ in range(n)], missing=[rnd.random() < 0.4 for _ in range(n)]).repartition(4)
    args = (RUN, ORDER, "shot", "status", "cycle", "missing")
    plain = ordered.islands(ordered.history(df, *args), RUN, ORDER, "status")
    blocked = ordered.history_blocked(df, *args, block=block)
    assert set(plain.columns) == set(blocked.columns)
    assert plain.orderBy(ORDER).collect() == blocked.select(*plain.columns).orderBy(ORDER).collect()


def test_leaks_and_mixes_are_found_in_every_run(spark):
    rnd = random.Random(4)
    df = rows(spark, run_id=[i // 30 for i in range(150)], cycle=[rnd.choice([None, rnd.random()]) for _ in range(150)]).repartition(3)
    change = {"cycle": F.coalesce("cycle", F.lit(0)) + 1000}
    keep = lambda by, c: lambda d: d.withColumn("x", c(by))
    past = keep(RUN, lambda by: ordered.rolling_max("cycle", 5, by, ORDER))
    ahead = keep(RUN, lambda by: F.lead("cycle").over(ordered._run(by, ORDER)))
    assert validate.history_leak(df, past, ORDER, "run_id", change, ["x"]).count() == 0
    found = {r[0] for r in validate.history_leak(df, ahead, ORDER, "run_id", change, ["x"]).collect()}
    assert found == {30 * k + i for k in range(5) for i in (13, 14)}
    pairs = lambda d: d.withColumn("two", F.expr("run_id div 2"))
    mixed = keep(["two"], lambda by: ordered.lag_feature("cycle", by, ORDER))
    assert validate.history_mix(df, past, ORDER, "run_id", change, ["x"]).count() == 0
    assert {r[0] for r in validate.history_mix(df, lambda d: mixed(pairs(d)), ORDER, "run_id", change, ["x"]).collect()} == {30, 90}
    assert validate.history_leak(df.limit(0), past, ORDER, "run_id", change, ["x"]).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0, 3, 1, 0, 2, 1), (0, 0, 0, 0, 0, None)], "Short_1 int, Short_2 int, Dent_1 int, Dent_2 int, Bub_1 int, Bub_2 int")
    kinds = ["Short", "Dent", "Bub"]
    out = df.select(fn.any_positive(df.columns).alias("y"), *[c.alias(k) for k, c in fn.type_flags(kinds).items()], fn.count_true(list(fn.type_flags(kinds).values())).alias("n")).collect()
    assert [tuple(r) for r in out] == [(1, 1, 1, 1, 3), (0, 0, 0, 0, 0)]


def test_mask_flag_and_thresholds(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1500.0,), (1501.0,), (None,)], "t double")
    out = fn.mask_and_flag(df, ["t"]).collect()
    assert [(r["t"], r["t_suspect_high"], r["t_raw"]) for r in out] == [(None, False, -1.0), (None, False, 0.0), (1500.0, False, 1500.0), (1501.0, True, 1501.0), (None, False, None)]
    assert [r[0] for r in df.select(fn.threshold_flag("t", 615)).collect()] == [False, False, True, True, None]
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "t double, k int")
    assert [r[0] for r in fn.nan_to_null(nan).select("t").collect()] == [None, 2.0]


def test_bad_time_raises(spark):
    df = spark.createDataFrame([("2021-13-45", "00:00:00")], "d string, t string")
    with pytest.raises(Exception):
        df.select(fn.combine_date_time("d", "t")).collect()
