"""Roles as bitmaps, and a store that a reader opens one fold of."""

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import bitmaps, report, splits, validate
from shopfloor.plans import casting
from shopfloor.sources import files


@pytest.fixture(scope="module")
def tables(spark):
    sizes = [40, 25, 7, 60, *[20 + k for k in range(36)]]  # 39 valid runs: the bitmaps have several words
    make = lambda p: spark.createDataFrame([(r, s + 1, f"{p}_r{r}_s{s + 1}", 1000 * r + s, (r + s) % 5 != 0, None) for r, n in enumerate(sizes) for s in range(n)], "run_id bigint, Shot bigint, row_id string, source_row bigint, gate_eligible boolean, episode_id string")
    return make("q42").drop("gate_eligible", "episode_id").cache(), make("m41").cache()


@pytest.fixture(scope="module")
def made(tables):
    maps, combinations = casting.fold_bitmaps(*tables)
    return maps.cache(), combinations.cache()


def plain(valid, run, first=2):
    """Roles of a run in every fold of both run schemes."""
    out = {}
    for i, test in enumerate(valid):
        hold = max(r for r in valid if r != test)
        out["run_holdout", str(test)] = "excluded" if run not in valid else "test" if run == test else "validation" if run == hold else "train"
        if i >= first:
            out["forward_run", str(test)] = "excluded" if run not in valid or run > test else "test" if run == test else "validation" if run == valid[i - 1] else "train"
    return out


def test_one_row_per_record_and_every_role(tables, made):
    maps, combinations = made
    assert maps.count() == sum(t.count() for t in tables)
    assert max(r[0] for r in maps.select(F.size("roles")).collect()) == 3
    long = bitmaps.expand(maps, combinations)
    valid = sorted(r.run_id for r in splits.valid_runs(tables[0], "run_id").collect())
    wanted = {r: plain(valid, r) for r in range(40)}
    within = {r.row_id: r.role for r in splits.ratio_split(tables[0], "run_id", "source_row").collect()}
    eligible = {r.row_id: r.gate_eligible for r in tables[1].collect()}
    n = 0
    for r in long.collect():
        n += 1
        if r.scheme == "within_run":
            assert r.dataset == "m41" or r.role == within[r.row_id]
        else:
            assert r.role == (wanted[r.run_id][r.scheme, r.fold] if eligible.get(r.row_id, True) else "excluded"), r
    assert n == maps.count() * (1 + 39 + 37)


def test_counts_and_checks_without_expansion(spark, tables, made):
    maps, combinations = made
    long = bitmaps.expand(maps, combinations).cache()
    rows = lambda df: sorted(map(tuple, df.select("dataset", "scheme", "fold", "role", "n").collect()))
    assert rows(bitmaps.role_counts(maps, combinations)) == rows(report.role_counts(long))
    labels = tables[1].select("row_id", F.when(F.col("Shot") % 3 == 0, 1).when(F.col("Shot") % 7 == 0, None).otherwise(0).alias("y"))
    ready = lambda df: sorted(tuple(r[c] for c in ("dataset", "scheme", "fold", "role", "n", "n_positive", "auc_computable")) for r in df.collect())
    assert ready(bitmaps.readiness(maps.where("dataset = 'm41'"), combinations, labels, "y")) == ready(report.slice_readiness(labels, long.where("dataset = 'm41'"), "y"))
    assert bitmaps.differing(maps).count() == 0 == bitmaps.uncovered(tables[0], maps.where("dataset = 'q42'")).count()
    torn = maps.where("row_id = 'q42_r0_s1'").withColumn("roles", F.transform("roles", lambda w: w.bitwiseXOR(1)))
    assert [(r.row_id, r.n) for r in bitmaps.differing(maps.unionByName(torn)).collect()] == [("q42_r0_s1", 2)]
    missing = bitmaps.uncovered(tables[0], maps.where("dataset = 'q42' and row_id != 'q42_r1_s2'").unionByName(torn.withColumn("row_id", F.lit("nobody"))))
    assert sorted(tuple(r) for r in missing.collect()) == [("nobody", 1, 0), ("q42_r1_s2", 0, 1)]
    place = combinations.where("dataset = 'm41' and scheme = 'forward_run' and fold = '30'").first().place
    one = splits.use_fold(tables[1], long, "m41", "forward_run", "30").select("row_id", "role")
    assert sorted(map(tuple, bitmaps.use_bitmap(tables[1], maps.where("dataset = 'm41'"), place).select("row_id", "role").collect())) == sorted(map(tuple, one.collect()))
    plan = bitmaps.role_counts(maps, combinations)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")  # records are summed up below the join with the folds


def test_few_runs_and_empty_tables(spark, tables):
    for n, folds in ((0, 0), (1, 1), (2, 2), (3, 4)):
        runs = spark.range(n).select(F.col("id").alias("run_id"))
        assert bitmaps.run_combinations(runs, "run_id").count() == 1 + folds
        words = {r.run_id: r["_sf_words"][0] for r in bitmaps.run_words(runs, "run_id").collect()}
        assert len(words) == n
    maps, combinations = casting.fold_bitmaps(tables[0].limit(0), tables[1].limit(0))
    assert maps.count() == 0 and bitmaps.expand(maps, combinations).count() == 0 and bitmaps.role_counts(maps, combinations).count() == 0


def test_store_opens_one_combination(spark, made, tmp_path):
    long = bitmaps.expand(*made)
    path = str(tmp_path / "store")
    files.write_fold_store(long, path, 2)
    one = files.read_fold_store(spark, path, "m41", "run_holdout", "3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(f"{c}#" in plan.split("PartitionFilters: [")[1].split("]")[0] for c in ("dataset", "scheme", "fold"))
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) >= 1
    names = ["dataset", "scheme", "fold", "row_id", "role"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rows(one) == rows(long.where("dataset = 'm41' and scheme = 'run_holdout' and fold = '3'"))
    wanted = made[1].where("fold in ('3', '4') and dataset = 'q42'")
    chosen = files.chosen_folds(files.read_fold_store(spark, path), wanted)
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString().lower()
    assert rows(chosen) == rows(long.join(wanted.select("dataset", "scheme", "fold"), ["dataset", "scheme", "fold"]))
    assert validate.role_overlap(files.read_fold_store(spark, path)).count() == 0


def test_bitmap_store_has_a_row_for_each_record_and_word(spark, tables, made, tmp_path):
    maps, combinations = made
    path = str(tmp_path / "words")
    files.write_bitmap_store(maps, combinations, path)
    store = files.read_bitmap_store(spark, path)
    assert store.count() == maps.count() * 3  # 77 combinations; the long store has a row for each
    wanted = combinations.where("fold in ('3', '4', '39')")
    counts = bitmaps.stored_counts(store, wanted)
    assert "dynamicpruning" in counts._jdf.queryExecution().executedPlan().toString().lower()
    rows = lambda df: sorted(map(tuple, df.select("dataset", "scheme", "fold", "role", "n").collect()))
    assert rows(counts) == rows(bitmaps.role_counts(maps, wanted))
    for scheme, fold in (("within_run", "primary"), ("run_holdout", "31"), ("forward_run", "30")):
        place = combinations.where((F.col("dataset") == "m41") & (F.col("scheme") == scheme) & (F.col("fold") == fold)).first().place
        one = files.read_bitmap_store(spark, path, "m41", place)
        filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "dataset#" in filters and "word#" in filters
        got = bitmaps.use_stored(tables[1], one, place).select("row_id", "role")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bitmaps.use_bitmap(tables[1], maps.where("dataset = 'm41'"), place).select("row_id", "role").collect()))


def test_alignment_by_bitmaps_equals_that_of_assignments(tables, made):
    maps, combinations = made
    keys = ["run_id", "shot"]
    with_shot = lambda df: df.withColumn("shot", F.regexp_extract("row_id", "_s(\\d+)$", 1).cast("bigint"))
    a, b = (with_shot(maps.where(F.col("dataset") == name)) for name in ("q42", "m41"))
    # Roles are torn in every word, the last place of a word too; some bits become excluded, which is no violation.
    torn = b.withColumn("roles", F.when(F.col("shot") % 7 == 0, F.transform("roles", lambda w: w.bitwiseXOR(-4611686018427387904 + 7))).otherwise(F.col("roles")))
    of_q = combinations.where("dataset = 'q42'")
    columns = ["scheme", "fold", *keys, "role_a", "role_b"]
    for other in (b, torn):
        found = bitmaps.role_alignment(a, other, of_q, keys)
        long = [with_shot(bitmaps.expand(x, combinations)) for x in (a, other)]
        wanted = validate.role_alignment(*long, ["scheme", "fold", *keys])
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    assert found.count() > 500


def test_assignments_are_written_compressed_in_files_of_bounded_rows(spark, made, tmp_path):
    long = bitmaps.expand(*made)
    path, plain = tmp_path / "folds", tmp_path / "plain"
    files.write_folds(long, str(path), 20_000)
    long.write.option("header", True).csv(str(plain))
    size = lambda folder: sum(f.stat().st_size for f in folder.glob("part-*"))
    assert 5 * size(path) < size(plain)
    assert max(spark.read.option("header", True).csv(str(f)).count() for f in path.glob("part-*")) <= 20_000
    rows = lambda df: sorted(map(str, df.select(*splits.COLUMNS).collect()))
    assert rows(files.read_folds(spark, str(path))) == rows(long)


def test_records_are_dealt_out_before_they_become_many_rows(made):
    long = bitmaps.expand(made[0].coalesce(1), made[1])
    by_task = [r["count"] for r in long.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 1 and max(by_task) < sum(by_task) / 2
    assert sum(by_task) == made[0].count() * 77
