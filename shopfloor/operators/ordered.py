"""Operators on ordered records: runs, positions, first-of-equals, episodes and history.

A run is one machine's records between two resets of its counter.  History features look only at earlier rows
of the same run.  Whatever depends on all earlier rows goes through ``ordered_scan``, block by block, so no task
sorts a whole run or table.

Rules for unusual input, where a docstring says nothing else
-----------------------
null order             such a row has no place; orders are not null
ties                   orders are unique in the table or, with ``by``, in the run
null counter           is no decrease, and neither is the row after it; there is no gap on either side
null status            is not the value looked for: it ends a stretch
repeated rows          are rows of their own, but for ``dedup_keep_first``
helper columns         begin with ``_sf_``, which is reserved; other names never clash
empty table            empty result
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16  # order values in a block
FAN = 512  # summaries that are folded at a time
CARRY = "_sf_carry"

Combine = Callable[[Column, Column], Column]


def _prefixes(states: DataFrame, by: list[str], combine: Combine, levels: int) -> DataFrame:
    """``(*by, _sf_block, _sf_carry)``: ``combine`` of the states ``_sf_state`` of all earlier blocks, null for the first.

    ``FAN`` consecutive blocks are folded at a time; their totals are scanned in the same way, one level up.
    """
    up = F.floor(F.col("_sf_block") / FAN).cast("bigint") if levels > 1 else F.lit(0).cast("bigint")
    grouped = states.groupBy(*by, up.alias("_sf_up")).agg(F.sort_array(F.collect_list(F.struct("_sf_block", "_sf_state"))).alias("_sf_list"))
    kind = states.schema["_sf_state"].dataType.simpleString()
    begin = F.struct(F.lit(None).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("seen"))
    after = lambda a, x: F.when(a["at"].isNull(), x["_sf_state"]).otherwise(combine(a["at"], x["_sf_state"]))
    folded = grouped.withColumn("_sf_fold", F.aggregate("_sf_list", begin, lambda a, x: F.struct(after(a, x).alias("at"), F.array_append(a["seen"], a["at"]).alias("seen"))))
    each = folded.select(*by, "_sf_up", F.explode(F.arrays_zip(F.col("_sf_list._sf_block").alias("b"), F.col("_sf_fold.seen").alias("c"))).alias("_sf_x"))
    inside = each.select(*by, "_sf_up", F.col("_sf_x.b").alias("_sf_block"), F.col("_sf_x.c").alias(CARRY))
    if levels == 1:
        return inside.drop("_sf_up")
    above = _prefixes(folded.select(*by, F.col("_sf_up").alias("_sf_block"), F.col("_sf_fold.at").alias("_sf_state")), by, combine, levels - 1)
    above = above.withColumnsRenamed({"_sf_block": "_sf_up", CARRY: "_sf_above"})
    both = inside.join(above, [*by, "_sf_up"])
    carry = F.when(F.col("_sf_above").isNull(), F.col(CARRY)).when(F.col(CARRY).isNull(), F.col("_sf_above")).otherwise(combine(F.col("_sf_above"), F.col(CARRY)))
    return both.select(*by, "_sf_block", carry.alias(CARRY))


def ordered_scan(
    df: DataFrame, order: str, local: Callable[[DataFrame, list[str]], DataFrame], summary: dict[str, Column], combine: Combine,
    by: tuple[str, ...] | list[str] = (), block: int | Column = BLOCK, levels: int = 2,
) -> DataFrame:
    """Scan rows in the order of ``order``, per ``by``, block by block; adds ``_sf_carry`` and ``_sf_block``.

    A block is ``block`` consecutive order values, or what a column of integers says, which ascends with ``order``.
    ``local(df, keys)`` adds columns by windows over ``keys``, the rows of one block; ``summary`` are aggregates of a
    block, as a struct; ``combine(a, b)`` joins the structs of neighbouring stretches, and has to be associative.
    ``_sf_carry`` is the struct of everything before the row's block, null where there is nothing.

    No window and no task has more than a block's rows or ``FAN`` summaries (all of them on the last of ``levels``: with two,
    that is one for each ``FAN`` blocks of a ``by``).
    """
    by = list(by)
    number = F.floor(F.col(order) / block).cast("bigint") if isinstance(block, int) else block.cast("bigint")
    keys = [*by, "_sf_block"]
    inside = local(df.withColumn("_sf_block", number), keys)
    states = inside.groupBy(*keys).agg(F.struct(*[v.alias(k) for k, v in summary.items()]).alias("_sf_state"))
    return inside.join(_prefixes(states, by, combine, levels), keys)


def levels_for(rows: int | None, block: int) -> int:
    """Levels of a scan over so many rows, so that no fold has more than ``FAN`` summaries; two where the number is not known."""
    if rows is None:
        return 2
    levels, reach = 1, block * FAN
    while reach < rows:
        levels, reach = levels + 1, reach * FAN
    return levels


def _upto(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def segment_on_decrease(df: DataFrame, order: str, counter: str, by: tuple[str, ...] = (), block: int = BLOCK, name: str = "run_id") -> DataFrame:
    """Run number, from 0, plus 1 at each strict decrease of ``counter`` in the order of ``order``.

    Blocks count their own decreases; between blocks the last counter before and the first one after are compared.
    """

    def local(d: DataFrame, keys: list[str]) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy(order)
        d = d.withColumn("_sf_drop", F.coalesce((F.col(counter) < F.lag(counter).over(own)).cast("bigint"), F.lit(0)))
        return d.withColumns({"_sf_local": F.sum("_sf_drop").over(_upto(keys, order)), "_sf_first": F.first(counter).over(_upto(keys, order))})

    dropped = lambda a, b: F.coalesce((b < a).cast("bigint"), F.lit(0))
    summary = {"n": F.sum("_sf_drop"), "first": F.min_by(counter, order), "last": F.max_by(counter, order)}
    combine = lambda a, b: F.struct((a["n"] + b["n"] + dropped(a["last"], b["first"])).alias("n"), a["first"].alias("first"), b["last"].alias("last"))
    out = ordered_scan(df, order, local, summary, combine, by, block)
    before = F.coalesce(F.col(CARRY)["n"], F.lit(0)) + dropped(F.col(CARRY)["last"], F.col("_sf_first"))
    return out.select(*df.columns, (F.col("_sf_local") + before).alias(name))


def with_position(df: DataFrame, by: list[str], order: str, name: str = "shot_position", block: int | Column = BLOCK, rows: int | None = None) -> DataFrame:
    """Add the 0-based place in the group (W2): the place in the block, after the counts of the blocks before.

    ``rows`` is the greatest order value, if it is known: it saves levels of the scan.
    """
    local = lambda d, keys: d.withColumn("_sf_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    out = ordered_scan(df, order, local, {"n": F.count(F.lit(1))}, lambda a, b: F.struct((a["n"] + b["n"]).alias("n")), by, block, levels_for(rows, block) if isinstance(block, int) else 2)
    place = (F.col("_sf_k") + F.coalesce(F.col(CARRY)["n"], F.lit(0))).cast("bigint")
    return out.select(*[c for c in df.columns if c != name], place.alias(name))


def _run(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def dedup_keep_first(df: DataFrame, within: list[str], ignore: list[str], order: str) -> DataFrame:
    """One row, the first, of rows equal in all columns but ``ignore`` and ``order``; nulls are equal.

    Equal rows meet in partial aggregates before the shuffle, so many copies of one row cost little.
    """
    keys = [*within, *[c for c in df.columns if c not in {*within, *ignore, order}]]
    kept = df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in ignore])
    return kept.select(*df.columns)


def _is(status: str, value) -> Column:
    return F.col(status).eqNullSafe(F.lit(value))


def island_start(status: str, value, by: list[str], order: str) -> Column:
    """1 where a stretch of ``value`` begins: the row before is another value, missing, or of another run."""
    before = F.coalesce(F.lag(_is(status, value)).over(_run(by, order)), F.lit(False))
    return (_is(status, value) & ~before).cast("bigint")


def _stretches(status: str, value, order: str):
    """``summary`` and ``combine`` that count stretches: one that goes on over a block's edge is one."""
    on = _is(status, value)
    summary = {"n": F.sum("_sf_start"), "first": F.min_by(on, order), "last": F.max_by(on, order)}
    joined = lambda a, b: (a["last"] & b["first"]).cast("bigint")
    combine = lambda a, b: F.struct((a["n"] + b["n"] - joined(a, b)).alias("n"), a["first"].alias("first"), b["last"].alias("last"))
    return summary, combine


def islands(df: DataFrame, by: list[str], order: str, status: str, value=1, first: int = 1, name: str = "episode_id", label: str = "r%d_e%d", block: int = BLOCK) -> DataFrame:
    """Number contiguous stretches of ``value``; ``name`` is null on other rows (W4).  Ids need one ``by`` column."""

    def local(d: DataFrame, keys: list[str]) -> DataFrame:
        d = d.withColumn("_sf_start", island_start(status, value, keys, order))
        return d.withColumns({"_sf_n": F.sum("_sf_start").over(_upto(keys, order)), "_sf_on": F.first(_is(status, value)).over(_upto(keys, order))})

    out = ordered_scan(df, order, local, *_stretches(status, value, order), by, block)
    going = F.coalesce((F.col(CARRY)["last"] & F.col("_sf_on")).cast("bigint"), F.lit(0))  # the block begins inside a stretch
    n = F.col("_sf_n") + F.coalesce(F.col(CARRY)["n"], F.lit(0)) - going + first - 1
    episode = F.when(_is(status, value), F.format_string(label, F.col(by[0]), n))
    return out.select(*[c for c in df.columns if c != name], episode.alias(name))


def lag_feature(c: str, by: list[str], order: str) -> Column:
    """Value of the row before, missing if it is."""
    return F.lag(c).over(_run(by, order))


def rolling_max(c: str, rows: int, by: list[str], order: str) -> Column:
    """Largest value of up to ``rows`` earlier rows, null without any."""
    return F.max(c).over(_run(by, order).rowsBetween(-rows, -1))


def rolling_count_true(flag: Column, rows: int, by: list[str], order: str) -> Column:
    """How many of up to ``rows`` earlier rows have the flag; null, not 0, without an earlier row."""
    return F.sum(flag.cast("bigint")).over(_run(by, order).rowsBetween(-rows, -1)).cast("double")


def counter_gap(counter: str, by: list[str], order: str) -> Column:
    """Counter values skipped before this row, at least 0; null on a run's first row."""
    before = F.lag(counter).over(_run(by, order))
    return F.when(before.isNotNull(), F.greatest(F.col(counter) - before - 1, F.lit(0))).cast("double")


def since_last(counter: str, status: str, by: list[str], order: str, value=1) -> Column:
    """Counter minus that of the last earlier row with ``value``; null if there is none."""
    w = _run(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.col(counter) - F.last(F.when(_is(status, value), F.col(counter)), ignorenulls=True).over(w)).cast("double")


def prior_islands(df: DataFrame, by: list[str], order: str, status: str, value=1, empty: float = 0.0, name: str = "oracle_prior_episodes") -> DataFrame:
    """Stretches that began before this row."""
    w = _run(by, order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_sf_start", island_start(status, value, by, order))
    return out.withColumn(name, F.coalesce(F.sum("_sf_start").over(w).cast("double"), F.lit(empty))).drop("_sf_start")


def history(df: DataFrame, by: list[str], order: str, counter: str, status: str, cycle: str, missing: str) -> DataFrame:
    """All six history columns by plain windows, over the table before any filter.

    One shuffle and one sort, for runs that fit a task; ``history_blocked`` takes runs of any length.
    """
    out = df.withColumns({
        "prev_cycle_time": lag_feature(cycle, by, order),
        "max_cycle_previous_5": rolling_max(cycle, 5, by, order),
        "missing_process_previous_20": rolling_count_true(F.col(missing), 20, by, order),
        "missing_shots_before_current": counter_gap(counter, by, order),
        "oracle_shots_since_warm": since_last(counter, status, by, order),
    })
    return prior_islands(out, by, order, status)


def history_blocked(df: DataFrame, by: list[str], order: str, counter: str, status: str, cycle: str, missing: str, block: int = BLOCK, value=1, rows: int | None = None) -> DataFrame:
    """``history`` and ``episode_id`` for runs of any length: the same columns, block by block.

    Blocks are cut by rows of a run.  Each gets the last 20 rows of the one before as a halo for the bounded frames and
    for the row before; episodes begun and the last warm-up counter are carried on by the scan.  ``rows`` is the number of
    rows, if it is known.
    """
    halo = 20
    if block < halo:
        raise ValueError("a block holds at least the halo")
    placed = with_position(df, by, order, "_sf_place", block)
    at = "_sf_place"
    warm = F.when(_is(status, value), F.col(counter))

    def local(d: DataFrame, keys: list[str]) -> DataFrame:
        edge = d.where(F.col(at) % block >= block - halo).withColumn("_sf_block", F.col("_sf_block") + 1)
        both = d.withColumn("_sf_halo", F.lit(False)).unionByName(edge.withColumn("_sf_halo", F.lit(True)))
        out = both.withColumns({
            "prev_cycle_time": lag_feature(cycle, keys, at),
            "max_cycle_previous_5": rolling_max(cycle, 5, keys, at),
            "missing_process_previous_20": rolling_count_true(F.col(missing), 20, keys, at),
            "missing_shots_before_current": counter_gap(counter, keys, at),
            "_sf_start": island_start(status, value, keys, at),
        }).where(~F.col("_sf_halo"))
        earlier = _run(keys, at).rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumns({"_sf_begun": F.coalesce(F.sum("_sf_start").over(earlier), F.lit(0)), "_sf_last": F.last(warm, ignorenulls=True).over(earlier)})

    # A halo shows where a stretch goes on, so the starts of blocks simply add up.
    summary = {"n": F.sum("_sf_start"), "warm": F.max_by(warm, F.when(warm.isNotNull(), F.col(at)))}
    combine = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(b["warm"], a["warm"]).alias("warm"))
    out = ordered_scan(placed, at, local, summary, combine, by, block, levels_for(rows, block))
    begun = F.col("_sf_begun") + F.coalesce(F.col(CARRY)["n"], F.lit(0))
    out = out.withColumns({
        "episode_id": F.when(_is(status, value), F.format_string("r%d_e%d", F.col(by[0]), begun + F.col("_sf_start"))),
        "oracle_shots_since_warm": (F.col(counter) - F.coalesce("_sf_last", F.col(CARRY)["warm"])).cast("double"),
        "oracle_prior_episodes": begun.cast("double"),
    })
    return out.drop(at, "_sf_block", "_sf_halo", "_sf_start", "_sf_begun", "_sf_last", CARRY)


def sort_stable(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Total order by time, ties by position (O1)."""
    return df.orderBy(time, tie)


def keep_order(df: DataFrame, order: str) -> DataFrame:
    """Rows in order within and across range partitions, for a writer (O2)."""
    return df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
