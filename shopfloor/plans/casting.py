"""The three process tables: quality rows, equipment timeline and the separate process log.

Only this module and the stand-ins know column names of the casting data; operators take names as parameters.  A builder
writes its rows once they have runs, to the shared folder, as the scans after it read them twice.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import bitmaps, link, ordered, splits
from ..sources import files

# Column names of the source tables.
PROCESS = ["Velocity_1", "Velocity_2", "Velocity_3", "High_Velocity", "Cylinder_Pressure", "Rapid_Rise_Time", "Biscuit_Thickness", "Clamping_Force", "Cycle_Time", "Pressure_Rise_Time", "Casting_Pressure", "Spray_Time", "Spray_1_Time", "Spray_2_Time"]
SENSORS = ["Melting_Furnace_Temp", "Air_Pressure", "Coolant_Temp", "Coolant_Pressure", "Factory_Temp", "Factory_Humidity"]
LIMITS = [f"{c}_{e}" for c in ("Air_Pressure", "Coolant_Temp", "Factory_Temp", "Factory_Humidity") for e in ("Min", "Max")]
MAIN_TYPES = ["Short_Shot", "Bubble", "Exfoliation", "Blow_Hole"]
OTHER_TYPES = ["Stain", "Dent", "Deformation", "Contamination", "Impurity", "Crack", "Scratch", "Buring_Mark", "Inclusions"]
TYPES = MAIN_TYPES + OTHER_TYPES
TEMPERATURES = ["mold_temperature", "sleeve_temperature", "top_temp1", "top_temp2", "top_temp3", "bottom_temp1", "bottom_temp2", "bottom_temp3"]
P40_DROPPED = ["line_unit", "production", "top_temp4", "bottom_temp4", "molten_capacity"]
HISTORY = ["prev_cycle_time", "max_cycle_previous_5", "missing_process_previous_20", "missing_shots_before_current", "oracle_shots_since_warm", "oracle_prior_episodes"]


def quality_table(raw: DataFrame) -> DataFrame:
    """Quality rows with runs, without repeats and constant limits, with labels, ids and positions.

    ``raw`` has ``source_row``.  Runs are cut before repeats go, positions counted after.
    """
    runs = ordered.segment_on_decrease(raw, "source_row", "Shot")
    kept = files.stored(ordered.dedup_keep_first(runs, ["run_id"], ["id"], "source_row").drop(*LIMITS))
    cells = lambda k: [f"{t}_{k}" for t in TYPES]
    out = kept.withColumns({
        "row_id": fn.row_id("q42", ("r", "run_id"), ("s", "Shot")),
        "y_defect": fn.any_positive(cells(1) + cells(2)), "y_cavity_1": fn.any_positive(cells(1)), "y_cavity_2": fn.any_positive(cells(2)),
        **fn.type_flags(TYPES),
    })
    out = out.withColumns({"defect_type_count": fn.count_true([f"y_type_{t}" for t in TYPES]), "y_type_Etc": fn.any_positive([f"y_type_{t}" for t in OTHER_TYPES])})
    return ordered.with_position(out, ["run_id"], "source_row")


def timeline_table(raw: DataFrame) -> DataFrame:
    """All timeline records with runs, eligibility, episodes and history; ``raw`` has ``source_row``."""
    kept = files.stored(ordered.segment_on_decrease(raw, "source_row", "Shot"))
    out = kept.withColumns({
        "row_id": fn.row_id("m41", ("r", "run_id"), ("s", "Shot")),
        "process_missing": fn.any_null(PROCESS), "gate_eligible": fn.eligible("Machine_Status", PROCESS),
    })
    return ordered.history_blocked(out, ["run_id"], "source_row", "Shot", "Machine_Status", "Cycle_Time", "process_missing", rows=kept.count())


def joined_table(quality: DataFrame, timeline: DataFrame) -> DataFrame:
    """Quality rows with the timeline's status, position, episode and history."""
    take = ["Machine_Status", "source_row", "episode_id", *HISTORY]
    return link.link_one_to_one(quality, timeline, ["run_id", "Shot"], take, {"source_row": "source_row_m41"})


def process_table(raw: DataFrame) -> DataFrame:
    """The process log with time, masked and flagged temperatures and nullable label, ordered by time; ``raw`` has ``source_row``."""
    out = raw.drop(*P40_DROPPED).withColumns({"row_id": fn.row_id("p40", ("", "source_row")), "event_time": fn.combine_date_time("timestamp", "date")})
    out = fn.mask_and_flag(out, TEMPERATURES)
    out = out.withColumns({"label_available": F.col("PassOrFail").isNotNull(), "normal_pressure": fn.threshold_flag("injection_pressure", 615), "y_defect": fn.nullable_label("PassOrFail")})
    return ordered.sort_stable(out, "event_time", "source_row")


def fold_bitmaps(
    quality: DataFrame, timeline: DataFrame, process: DataFrame | None = None, run: str = "run_id", shot: str = "Shot", order: str = "source_row",
    eligible: str = "gate_eligible", time: str = "event_time", labelled: str = "label_available", least: int = 20, names=("q42", "m41", "p40"),
) -> tuple[DataFrame, DataFrame]:
    """``(dataset, row_id, order, episode_id, run_id, roles)``, one row for each row of each table, and the combinations.

    The role of a run in every fold of the run schemes is worked out once for the run.
    """
    q, m, p = names
    text = F.lit(None).cast("string")
    keys = lambda df, name, place, episode, of: df.select(F.lit(name).alias("dataset"), "row_id", place.alias("order"), episode.alias("episode_id"), of.cast("bigint").alias("run_id"), "roles")
    by_place = splits.ratio_split(quality, run, order, least=least)
    aligned = splits.align_to_boundaries(timeline, splits.boundaries(by_place, run, shot), run, shot)
    runs = splits.valid_runs(quality, run, least).select(run)
    words = bitmaps.run_words(runs, run)
    parts = [
        keys(bitmaps.with_roles(by_place, words, run), q, splits.order_key(order), text, F.col(run)),
        keys(bitmaps.with_roles(aligned, words, run, used=F.col(eligible)), m, splits.order_key(order), F.col("episode_id"), F.col(run)),
    ]
    of_runs = bitmaps.run_combinations(runs, run)
    combinations = [of_runs.withColumn("dataset", F.lit(name)) for name in (q, m)]
    if process is not None:
        timed = splits.apply_exclusions(splits.time_ratio_split(process, time), ~F.col(labelled)).withColumn("roles", bitmaps.single(F.col("role")))
        parts.append(keys(timed, p, splits.order_key(time, True), text, F.lit(None)))
        one = quality.sparkSession.range(1).select(F.lit("chronological").alias("scheme"), F.lit("primary").alias("fold"), F.lit(0).cast("bigint").alias("place"), F.lit(p).alias("dataset"))
        combinations.append(one)
    return splits.union_folds(parts), splits.union_folds(combinations)


def folds_table(*tables: DataFrame, **how) -> DataFrame:
    """Every row of each table once in every combination of its schemes and folds (F8), from ``fold_bitmaps``."""
    return bitmaps.expand(*fold_bitmaps(*tables, **how))
