"""Train, validation and test roles by place in a run, by run and by time.

Shares are fractions of integers, ``(7, 10)``: in doubles, floor(90 * 0.7) is 62.  ``within_run`` and
``run_holdout`` may train on runs later than the test, so they judge in retrospect; claims about future runs need
``forward_run``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, with_position

EXCLUDED = "excluded"
BROADCAST_FOLDS = 100_000  # names of folds that may be broadcast
SORTED = 10_000  # values that are sorted to find a place among them, at most
PARTS = 1_000  # ranges that a round of the search for a place counts
COLUMNS = ["dataset", "scheme", "fold", "row_id", "role", "order", "episode_id", "run_id"]


def valid_runs(df: DataFrame, by: str, least: int = 20) -> DataFrame:
    """Runs with at least ``least`` rows and their counts (P25)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def cutoffs(n: str, dev: tuple[int, int], train: tuple[int, int]) -> dict[str, Column]:
    """How many of ``n`` are for development, and how many of those for training; floors of exact fractions."""
    d = F.expr(f"cast({n} * {dev[0]} div {dev[1]} as bigint)")
    return {"n_dev": d, "n_train": F.expr(f"cast(({n} * {dev[0]} div {dev[1]}) * {train[0]} div {train[1]} as bigint)")}


def _role(place: Column, n_train: Column, n_dev: Column) -> Column:
    return F.when(place <= n_train, "train").when(place <= n_dev, "validation").otherwise("test")


def head_fraction(df: DataFrame, by: str, order: str, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """The first floor(N num / den) rows of each group (O3); places come from the block scan."""
    ranked = with_position(df, [by], order, "_sf_place", block)
    sized = ranked.join(df.groupBy(by).agg(F.count(F.lit(1)).alias("_sf_n")), by)
    return sized.where(F.expr(f"_sf_place < _sf_n * {num} div {den}")).select(*df.columns)


def ratio_split(df: DataFrame, by: str, order: str, dev=(7, 10), train=(8, 10), least: int = 20, block: int = BLOCK) -> DataFrame:
    """Add ``role``: by place in the run (W12, F1), from the block scan; runs under ``least`` rows are excluded."""
    cuts = valid_runs(df, by, least).withColumns({f"_sf_{c}": v for c, v in cutoffs("n", dev, train).items()}).select(by, "_sf_n_dev", "_sf_n_train")
    joined = with_position(df, [by], order, "_sf_place", block).join(cuts, by, "left")
    role = F.when(F.col("_sf_n_dev").isNull(), EXCLUDED).otherwise(_role(F.col("_sf_place") + 1, F.col("_sf_n_train"), F.col("_sf_n_dev")))
    return joined.withColumn("role", role).select(*[c for c in df.columns if c != "role"], "role")


def boundaries(split: DataFrame, by: str, counter: str) -> DataFrame:
    """Last train and last validation counter of each run."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.col(counter)))
    cuts = split.where(F.col("role") != EXCLUDED).groupBy(by).agg(last("train").alias("last_train"), last("validation").alias("last_validation"))
    return cuts.withColumn("last_validation", F.coalesce("last_validation", "last_train"))


def align_to_boundaries(df: DataFrame, cuts: DataFrame, by: str, counter: str) -> DataFrame:
    """Add ``role`` from another table's boundaries of the same run."""
    joined = df.join(cuts, by, "left")
    role = F.when(F.col("last_train").isNull(), EXCLUDED).otherwise(_role(F.col(counter), F.col("last_train"), F.col("last_validation")))
    return joined.withColumn("role", role).select(*df.columns, "role")


def expand_run_roles(runs: DataFrame, by: str, scheme: str, first: int = 2) -> DataFrame:
    """``(fold, run, role)`` for every pair of valid runs (J4): a table of runs squared, one row per run in each fold.

    ``run_holdout``: the last other run validates.  ``forward_run``: folds from the ``first``-th run on; the run
    before validates, earlier ones train, later ones are excluded.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(by)  # one row per run
    r = runs.select(by).distinct().withColumns({"_sf_k": F.row_number().over(order) - 1, "_sf_last": F.max(by).over(Window.partitionBy(F.lit(0))), "_sf_prev": F.lag(by).over(order)})
    r = r.withColumn("_sf_second", F.max(F.when(F.col(by) != F.col("_sf_last"), F.col(by))).over(Window.partitionBy(F.lit(0))))
    tests = r.select(F.col(by).alias("_sf_test"), F.col("_sf_k").alias("_sf_test_k"), "_sf_last", "_sf_second", F.col("_sf_prev").alias("_sf_test_prev"))
    pairs = r.select(F.col(by), F.lit(1).alias("_sf_one")).join(tests.withColumn("_sf_one", F.lit(1)), "_sf_one")
    if scheme == "run_holdout":
        val = F.when(F.col("_sf_test") == F.col("_sf_last"), F.col("_sf_second")).otherwise(F.col("_sf_last"))
        role = F.when(F.col(by) == F.col("_sf_test"), "test").when(F.col(by) == val, "validation").otherwise("train")
    else:
        pairs = pairs.where(F.col("_sf_test_k") >= first)
        role = F.when(F.col(by) == F.col("_sf_test"), "test").when(F.col(by) == F.col("_sf_test_prev"), "validation").when(F.col(by) < F.col("_sf_test"), "train").otherwise(EXCLUDED)
    return pairs.select(F.col("_sf_test").cast("string").alias("fold"), by, role.alias("role"))


def run_split(df: DataFrame, runs: DataFrame, by: str, scheme: str, first: int = 2) -> DataFrame:
    """Every row of ``df`` once per fold, with ``fold`` and ``role`` (F3, F4); rows of other runs are excluded."""
    roles = expand_run_roles(runs, by, scheme, first).withColumnsRenamed({"role": "_sf_role", "fold": "_sf_fold"})
    folds = roles.select("_sf_fold").distinct().withColumn("_sf_one", F.lit(1))
    if folds.limit(BROADCAST_FOLDS + 1).count() <= BROADCAST_FOLDS:
        folds = F.broadcast(folds)
    inside = df.join(roles, by)  # a run has one role in each fold
    other = df.join(runs.select(by).distinct(), by, "left_anti").withColumn("_sf_one", F.lit(1)).join(folds, "_sf_one").withColumn("_sf_role", F.lit(EXCLUDED))
    made = [*[c for c in df.columns if c not in ("fold", "role")], F.col("_sf_fold").alias("fold"), F.col("_sf_role").alias("role")]
    return inside.select(*made).unionByName(other.select(*made))


def distinct_times(df: DataFrame, t: str) -> DataFrame:
    """Distinct times."""
    return df.select(t).distinct()


def _number(t: str, kind: str) -> Column:
    """A time or number as a long of the same order; floating values by their bits."""
    c = F.col(t)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{t}`)")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("bigint")
    raise ValueError(f"no places among values of type {kind}")


def kth_distinct(df: DataFrame, t: str, places: list[int], most: int = SORTED, parts: int = PARTS) -> list:
    """The values at 1-based ``places`` among the distinct non-null values of ``t``, exactly; None outside them.

    Every place keeps a range of values with how many come before it.  A round cuts a range into ``parts`` equal ones
    and counts in each, which gives the one that holds the place; where a range has at most ``most`` values they are
    sorted.  So nothing but ``parts`` counts and ``most`` values is ever collected or sorted, however the values lie: a
    range of 2^63 is down to one value after seven rounds.
    """
    kind = df.schema[t].dataType.simpleString()
    values = df.where(F.col(t).isNotNull()).select(_number(t, kind).alias("_sf_v"), F.col(t).alias("_sf_t")).distinct()
    low, high, total = values.agg(F.min("_sf_v"), F.max("_sf_v"), F.count(F.lit(1))).first()
    ranges = {k: (low, high, 0, total) for k in places if 1 <= k <= total}  # least and greatest value, values before, values inside
    while True:
        wide = sorted({r for r in ranges.values() if r[3] > most and r[0] < r[1]})
        if not wide:
            break
        for lo, hi, before, n in wide:
            step = -(-(hi - lo + 1) // parts)
            inside = values.where(F.col("_sf_v").between(lo, hi))
            part = F.expr(f"cast((cast(_sf_v as decimal(20,0)) - {lo}) div {step} as int)")
            counts = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # at most ``parts`` rows
            for k in [k for k, r in ranges.items() if r == (lo, hi, before, n)]:
                seen = before
                for row in counts:
                    if seen + row["n"] >= k:
                        first = lo + row["p"] * step
                        ranges[k] = (first, min(hi, first + step - 1), seen, row["n"])
                        break
                    seen += row["n"]
    found = {}
    for lo, hi, before, n in sorted(set(ranges.values())):
        held = values.where(F.col("_sf_v").between(lo, hi)).orderBy("_sf_v").limit(min(n, most) if lo < hi else 1).collect()
        found |= {k: held[k - before - 1]["_sf_t"] for k, r in ranges.items() if r == (lo, hi, before, n)}
    return [found.get(k) for k in places]


def time_cutoffs(df: DataFrame, t: str, dev=(7, 10), train=(8, 10), most: int = SORTED) -> tuple:
    """Times of the last train and the last development place among the T distinct times."""
    total = df.where(F.col(t).isNotNull()).select(F.count_distinct(t)).first()[0]
    n_dev = total * dev[0] // dev[1]
    last_train, last_dev = kth_distinct(df, t, [n_dev * train[0] // train[1], n_dev], most)
    return last_train, last_dev


def time_ratio_split(df: DataFrame, t: str, dev=(7, 10), train=(8, 10), most: int = SORTED) -> DataFrame:
    """Add ``role`` by the rank of a row's time among distinct times; equal times get one role."""
    last_train, last_dev = time_cutoffs(df, t, dev, train, most)
    kind = df.schema[t].dataType
    upto = lambda cut: F.lit(False) if cut is None else F.col(t) <= F.lit(cut).cast(kind)
    role = F.when(F.col(t).isNull(), EXCLUDED).when(upto(last_train), "train").when(upto(last_dev), "validation").otherwise("test")
    return df.withColumn("role", role)


def apply_exclusions(folds: DataFrame, cond: Column) -> DataFrame:
    """Role ``excluded`` where ``cond`` holds; applied last."""
    return folds.withColumn("role", F.when(cond, EXCLUDED).otherwise(F.col("role")))


def order_key(c: str, is_time: bool = False) -> Column:
    """Position or time as text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if is_time else F.col(c).cast("string")


def as_folds(df: DataFrame, dataset: str, scheme: str, order: Column, fold: str | None = None, episode: str | None = None, run: str | None = None) -> DataFrame:
    """Rows with ``row_id`` and ``role`` as an assignment table (F8)."""
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(scheme).alias("scheme"), (F.lit(fold) if fold else F.col("fold")).alias("fold"), "row_id", "role",
        order.alias("order"), (F.col(episode) if episode else F.lit(None).cast("string")).alias("episode_id"), (F.col(run) if run else F.lit(None)).cast("bigint").alias("run_id"),
    )


def union_folds(parts: list[DataFrame]) -> DataFrame:
    """All assignment sets as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def use_fold(df: DataFrame, folds: DataFrame, dataset: str, scheme: str, fold: str, scored: bool = True) -> DataFrame:
    """Rows of one combination with their role; without excluded ones where ``scored``."""
    one = folds.where((F.col("dataset") == dataset) & (F.col("scheme") == scheme) & (F.col("fold") == fold))
    one = one.where(F.col("role") != EXCLUDED) if scored else one
    return df.join(one.select("row_id", "role"), "row_id")
