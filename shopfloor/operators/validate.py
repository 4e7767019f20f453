"""Violation queries: no row means that the check passes.

Rules for unusual input, where a docstring says nothing else: missing equals missing; repeated rows are violations of
their own where rows are counted; an empty table has no violation, but for rows that it ought to have; helper columns
begin with ``_sf_``, which is reserved.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .splits import BROADCAST_FOLDS, EXCLUDED


def _differs(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    right = b.select(*key, *[F.col(c).alias(f"_sf_b_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_sf_b_{c}"))
    return a.join(right, key).where(~same).select(*key)


def _where(change: dict[str, Column], cond: Column) -> dict[str, Column]:
    return {c: F.when(cond, v).otherwise(F.col(c)) for c, v in change.items()}


def middles(df: DataFrame, order: str, run: str) -> DataFrame:
    """``(run, _sf_cut)``: of each run, the last position in the lower half of its span."""
    spans = df.groupBy(run).agg(F.expr(f"(min({order}) + max({order})) div 2").alias("_sf_mid"))
    return df.select(run, order).join(spans, run).where(F.col(order) <= F.col("_sf_mid")).groupBy(run).agg(F.max(order).alias("_sf_cut"))


def history_leak(df: DataFrame, history: Callable[[DataFrame], DataFrame], order: str, run: str, change: dict[str, Column], cols: list[str]) -> DataFrame:
    """Rows up to their run's middle whose history moves when measurements at and after it are changed (V4)."""
    cut = df.join(middles(df, order, run), run)
    upto = F.col(order) <= F.col("_sf_cut")
    changed = cut.withColumns(_where(change, F.col(order) >= F.col("_sf_cut")))
    return _differs(history(cut).where(upto), history(changed).where(upto), [order], cols)


def history_mix(df: DataFrame, history: Callable[[DataFrame], DataFrame], order: str, run: str, change: dict[str, Column], cols: list[str]) -> DataFrame:
    """Rows whose history moves when measurements of neighbouring runs are changed (V5).

    Runs have numbers; those of odd number are changed to look at the even ones, and the other way round.
    """
    odd = F.col(run) % 2 == 1
    plain = history(df)
    moved = [_differs(plain.where(own), history(df.withColumns(_where(change, ~own))).where(own), [order], cols) for own in (odd, ~odd)]
    return moved[0].unionByName(moved[1])


def role_overlap(folds: DataFrame) -> DataFrame:
    """Rows with several roles in one combination."""
    return folds.groupBy("dataset", "scheme", "fold", "row_id").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def time_split(folds: DataFrame, time: str = "order") -> DataFrame:
    """Times whose rows have several roles (V7)."""
    used = folds.where(F.col("role") != EXCLUDED)
    return used.groupBy("dataset", "scheme", "fold", time).agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def role_alignment(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Same key in both, different roles, neither excluded."""
    x, y = (f.where(F.col("role") != EXCLUDED).select(*keys, F.col("role").alias(r)) for f, r in ((a, "role_a"), (b, "role_b")))
    return x.join(y, keys).where("role_a != role_b")


def episode_roles(folds: DataFrame) -> DataFrame:
    """Episodes with several roles in one fold (V9)."""
    used = folds.where((F.col("role") != EXCLUDED) & F.col("episode_id").isNotNull())
    return used.groupBy("dataset", "scheme", "fold", "episode_id").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def fold_coverage(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of ``df`` that a combination has not exactly once, and assignments of unknown rows."""
    combos = folds.select("dataset", "scheme", "fold").distinct()
    if combos.limit(BROADCAST_FOLDS + 1).count() <= BROADCAST_FOLDS:
        combos = F.broadcast(combos)
    expected = df.select("row_id").join(combos)  # as many rows as the assignments ought to have
    got = folds.groupBy("dataset", "scheme", "fold", "row_id").agg(F.count(F.lit(1)).alias("n"))
    both = expected.withColumn("wanted", F.lit(1)).join(got, ["dataset", "scheme", "fold", "row_id"], "full")
    return both.select("dataset", "scheme", "fold", "row_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wanted", F.lit(0)).alias("wanted")).where("n != wanted")


def fingerprint(df: DataFrame) -> DataFrame:
    """``(n, hash_sum, hash_xor)``: equal for equal contents in any order."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).cast("string").alias("hash_xor"))


FAN = 256  # children of a node of the hash tree


def _row_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as ``(_sf_place, n, s, x)``: place in the key space, and count, sum and xor of the rows' hashes, per place."""
    place = F.pmod(F.xxhash64(*keys), F.lit(FAN**3))
    h = F.xxhash64(*df.columns)
    hashed = df.select(place.alias("_sf_place"), h.alias("_sf_h"), F.xxhash64(F.lit(1), *df.columns).alias("_sf_g"))
    return hashed.groupBy("_sf_place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_sf_h").cast("decimal(38,0)")).alias("s"), F.bit_xor("_sf_g").alias("x"))


def hash_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(level, node, n, s, x)``: the sums of all rows (level 0), of 256 ranges of the key space, of 65,536 and of 16.8 million.

    A tree of that size at most, whatever the table; sums of children are sums of their parent, so one pass makes it.
    """
    leaves = _row_sums(df, keys)
    up = lambda level: F.expr(f"_sf_place div {FAN ** (3 - level)}")
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")]
    parts = [leaves.groupBy(up(level).alias("node")).agg(*sums).select(F.lit(level).alias("level"), "node", "n", "s", "x") for level in range(3)]
    parts.append(leaves.select(F.lit(3).alias("level"), F.col("_sf_place").alias("node"), "n", "s", "x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(node,)``: leaves of two hash trees that differ, found level by level: below equal nodes nothing is looked at.

    The trees are best stored ones, as each level reads them.
    """
    nodes = None
    for level in range(1, 4):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (a, b))
        if nodes is not None:
            if not nodes.limit(1).count():
                return nodes
            wanted = nodes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.col("node") * FAN + i)).alias("node"))
            x, y = x.join(wanted, "node", "left_semi"), y.join(wanted, "node", "left_semi")
        both = x.join(y.toDF("node", "n2", "s2", "x2"), "node", "full")
        same = F.col("n").eqNullSafe(F.col("n2")) & F.col("s").eqNullSafe(F.col("s2")) & F.col("x").eqNullSafe(F.col("x2"))
        nodes = both.where(~same).select("node")
    return nodes


def changed_keys(a: DataFrame, b: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(*keys, change)``: keys whose rows differ, ``added`` or ``removed`` if only ``b`` or ``a`` has them, else ``changed``.

    Only rows in ranges where the hash trees differ are compared; ``trees`` are stored ones, if there are.  Rows of one key
    count as a bag.  Both tables have the same columns.
    """
    tree_a, tree_b = trees or (files.stored(hash_tree(a, keys)), files.stored(hash_tree(b, keys)))
    ranges = files.stored(differing_ranges(tree_a, tree_b).withColumnRenamed("node", "_sf_place"))
    few = ranges.limit(BROADCAST_FOLDS + 1).count() <= BROADCAST_FOLDS
    ranges = F.broadcast(ranges) if few else ranges

    def of(df: DataFrame, side: str) -> DataFrame:
        own = df.withColumn("_sf_place", F.pmod(F.xxhash64(*keys), F.lit(FAN**3))).join(ranges, "_sf_place", "left_semi")
        rows = F.sort_array(F.collect_list(F.struct(*a.columns))).alias(f"_sf_{side}")
        return own.groupBy(*[F.col(k).alias(f"_sf_{side}{i}") for i, k in enumerate(keys)]).agg(rows)

    cond = F.lit(True)
    for i in range(len(keys)):
        cond = cond & F.col(f"_sf_a{i}").eqNullSafe(F.col(f"_sf_b{i}"))
    both = of(a, "a").join(of(b, "b"), cond, "full").where(~F.col("_sf_a").eqNullSafe(F.col("_sf_b")))
    change = F.when(F.col("_sf_a").isNull(), "added").when(F.col("_sf_b").isNull(), "removed").otherwise("changed")
    return both.select(*[F.coalesce(f"_sf_a{i}", f"_sf_b{i}").alias(k) for i, k in enumerate(keys)], change.alias("change"))


def same_result(build: Callable[[], DataFrame]) -> DataFrame:
    """Fingerprints of two builds that are not equal."""
    a, b = fingerprint(build()), fingerprint(build())
    return a.subtract(b).unionByName(b.subtract(a))
