"""The block scan and all that stands on it, against plain windows; places among distinct values."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopfloor.operators import link, ordered, splits, validate
from shopfloor.sources import files

BLOCKS = [1, 7, 512]


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(6)
    rows = [(i, i // 230, rnd.randrange(9), rnd.choice([1, 1, 0, None]), f"m{i % 2}") for i in range(900)]
    rows += [(900, 7, 1, 1, "m0"), (905, 8, None, None, "m1"), (7_000, 8, 3, 1, "m0")]
    return spark.createDataFrame(rows, "source_row bigint, run_id bigint, shot bigint, status int, m string").repartition(5).cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def run():
    return Window.partitionBy("run_id").orderBy("source_row")


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("levels", [1, 2, 4])
def test_any_associative_state_is_carried(spark, log, monkeypatch, block, levels):
    monkeypatch.setattr(ordered, "FAN", 5)
    # The longest text so far of the row's machine and the last two shots: neither a sum nor a maximum.
    local = lambda d, keys: d.withColumn("_sf_text", F.array_join(F.collect_list("shot").over(Window.partitionBy(*keys).orderBy("source_row").rowsBetween(Window.unboundedPreceding, 0)), ""))
    summary = {"s": F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_row", "shot"))), lambda x: x["shot"]), "")}
    join = lambda a, b: F.struct(F.concat(a["s"], b["s"]).alias("s"))  # noqa: E731  not commutative
    got = ordered.ordered_scan(log, "source_row", local, summary, join, ["run_id"], block, levels)
    got = got.select("source_row", F.concat(F.coalesce(F.col("_sf_carry")["s"], F.lit("")), "_sf_text").alias("t"))
    same(got, log.select("source_row", F.array_join(F.collect_list("shot").over(run().rowsBetween(Window.unboundedPreceding, 0)), "").alias("t")))


@pytest.mark.parametrize("block", BLOCKS)
def test_positions_episodes_and_shares_equal_plain_windows(log, block):
    W = run()
    place = log.withColumn("p", (F.row_number().over(W) - 1).cast("bigint"))
    same(ordered.with_position(log, ["run_id"], "source_row", "p", block), place)
    whole = log.withColumn("p", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_row")) - 1).cast("bigint"))
    same(ordered.with_position(log, [], "source_row", "p", block), whole)
    start = F.col("status").eqNullSafe(1) & ~F.coalesce(F.lag(F.col("status").eqNullSafe(1)).over(W), F.lit(False))
    plain = log.withColumn("_s", start.cast("int")).withColumn("_n", F.sum("_s").over(W))
    plain = plain.withColumn("e", F.when(F.col("status") == 1, F.format_string("r%d_e%d", "run_id", "_n"))).drop("_s", "_n")
    same(ordered.islands(log, ["run_id"], "source_row", "status", name="e", block=block), plain)
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    half = place.withColumn("n", n).where("p < n * 3 div 7").drop("p", "n")
    same(splits.head_fraction(log, "run_id", "source_row", 3, 7, block), half)
    role = F.expr("case when n < 20 then 'excluded' when p < (n * 7 div 10) * 8 div 10 then 'train' when p < n * 7 div 10 then 'validation' else 'test' end")
    same(splits.ratio_split(log, "run_id", "source_row", block=block), place.withColumn("n", n).withColumn("role", role).drop("p", "n"))


@pytest.mark.parametrize("block", BLOCKS)
def test_runs_by_machine_with_missing_counters(log, block):
    w = Window.partitionBy("m").orderBy("source_row")
    drop = F.coalesce((F.col("shot") < F.lag("shot").over(w)).cast("bigint"), F.lit(0))
    plain = log.withColumn("_d", drop).withColumn("r", F.sum("_d").over(w)).drop("_d")
    same(ordered.segment_on_decrease(log, "source_row", "shot", ("m",), block, "r"), plain)


def test_no_window_over_a_whole_run_in_any_plan(log):
    made = [
        ordered.with_position(log, ["run_id"], "source_row"), ordered.islands(log, ["run_id"], "source_row", "status"), splits.ratio_split(log, "run_id", "source_row"),
        splits.head_fraction(log, "run_id", "source_row", 1, 2), ordered.segment_on_decrease(log, "source_row", "shot"),
        ordered.history_blocked(log.withColumn("missing", F.lit(False)), ["run_id"], "source_row", "shot", "status", "shot", "missing"),
    ]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"windowspecdefinition\((.*?)source_row|windowspecdefinition\((.*?)_sf_place", plan)
        assert keys and all("_sf_block" in "".join(k) for k in keys)
        assert "SinglePartition" not in plan


def test_columns_of_any_name(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(i, f"f{i}", i * 10) for i in range(40)], "_k bigint, _file string, _b_x bigint").coalesce(1).write.parquet(path)
    got = files.with_source_row(spark.read.parquet(path)).orderBy("source_row").collect()
    assert [tuple(r) for r in got] == [(i, f"f{i}", i * 10, i) for i in range(40)]
    again = files.with_source_row(spark.read.parquet(path), "_k").orderBy("_k").collect()
    assert again[0].asDict() == {"_file": "f0", "_b_x": 0, "_k": 0}
    a = spark.createDataFrame([(1, 5, 5, "s"), (2, 6, 1, "t")], "k bigint, x bigint, _b_x bigint, side string")
    b = spark.createDataFrame([(1, 5, 7, "u"), (2, 7, 1, "v"), (3, 1, 1, "w")], "k bigint, x bigint, _b_x bigint, side string")
    assert sorted(tuple(r) for r in link.join_gaps(a, b, ["k"], ["x", "_b_x"]).collect()) == [(1, "unequal"), (2, "unequal"), (3, "b")]
    assert {r.column_name: (r.n_rows, r.n_equal) for r in link.cell_agreement(a, b, ["k"], ["x", "_b_x"]).collect()} == {"x": (2, 1), "_b_x": (2, 1)}
    assert [r.k for r in validate._differs(a, b, ["k"], ["_b_x"]).collect()] == [1]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        files.shared_folder(Session())
    path = files.shared_folder(spark)
    spark.range(3).write.parquet(path)
    assert files.discard(spark, [path]) == 1 and files.discard(spark, [path]) == 0


@pytest.mark.parametrize("kind", ["bigint", "timestamp_ntz", "date"])
def test_places_among_distinct_values(spark, kind):
    rnd = random.Random(3)
    # All in one day but for two far ones; repeats and nulls do not count.
    numbers = [rnd.randrange(80_000) for _ in range(900)] + [-(1 << 40), 1 << 40 if kind == "bigint" else 9_000_000] + [5] * 40
    cast = {"bigint": F.col("v"), "timestamp_ntz": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, v / 1000)"), "date": F.expr("date_add(date'2024-01-01', cast(v % 3000 as int))")}[kind]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)] * 5, "v bigint").select(cast.alias("t"))
    values = sorted(r.t for r in df.where("t is not null").distinct().collect())
    places = [1, 2, 17, len(values) // 2, len(values) - 1, len(values), 0, len(values) + 1]
    wanted = [values[k - 1] if 1 <= k <= len(values) else None for k in places]
    for most, parts in ((10_000, 1000), (3, 4), (1, 7)):
        assert splits.kth_distinct(df, "t", places, most, parts) == wanted
    assert splits.kth_distinct(df.limit(0), "t", [1, 2]) == [None, None]
    cuts = splits.time_cutoffs(df, "t", most=2)
    n_dev = len(values) * 7 // 10
    assert cuts == (values[n_dev * 8 // 10 - 1], values[n_dev - 1])
