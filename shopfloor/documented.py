"""Queries over the documented tables: files in the shape of the raw ones are made from the star schema and go through
the builders of ``plans.casting``; each with the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import contract, ordered, report
from .plans import casting, standins as st
from .queries import QL, TL, query
from .sources import files

OTHER_PROCESS = [c for c in casting.PROCESS if c != "Cycle_Time"]
CELLS = {
    **{f"{t}_{k}": "0" for t in casting.TYPES for k in (1, 2)},
    "Short_Shot_1": "case when base % 11 = 0 then 3 else 0 end", "Bubble_1": "case when base % 13 = 0 then 1 else 0 end", "Bubble_2": "case when base % 26 = 0 then 2 else 0 end",
    "Stain_2": "case when base % 17 = 0 then 1 else 0 end", "Inclusions_1": "case when base % 19 = 0 then 1 end",
}
SENSOR = "case when base % {m} = 0 then null else cast(base % {n} as double) end"
SENSORS = {c: SENSOR.format(m=40 + i if c.startswith("Factory") else 1_000_000_007, n=50 + i) for i, c in enumerate(casting.SENSORS)}
GAP = 41  # every so manieth record lacks one process value
MTL = TL.replace("cycle_time is null process_missing", f"(cycle_time is null or source_row % {GAP} = 0) process_missing").replace("and cycle_time is not null gate_eligible", f"and cycle_time is not null and source_row % {GAP} <> 0 gate_eligible")
MQL = QL.replace(TL, MTL)


def raw_timeline(spark, d: str) -> DataFrame:
    """The equipment log with its 14 process values."""
    rows = st.raw_timeline(spark, d)
    made = {c: F.expr(f"cast(source_row % {31 + i} as double)") for i, c in enumerate(OTHER_PROCESS)}
    made["Spray_2_Time"] = F.expr(f"case when source_row % {GAP} = 0 then null else 1.5D end")
    return rows.select("source_row", F.col("source_row").alias("_id"), F.col("shot").alias("Shot"), F.col("status").cast("double").alias("Machine_Status"), F.col("cycle_time").alias("Cycle_Time"), *[v.alias(c) for c, v in made.items()])


def raw_quality(spark, d: str) -> DataFrame:
    """The quality log with process values, sensors, their constant limits and 26 defect cells."""
    rows = st.raw_quality(spark, d).withColumn("base", F.expr("id % 1000000000"))
    made = {c: F.expr(f"cast(base % {31 + i} as double)") for i, c in enumerate(OTHER_PROCESS)} | {c: F.expr(v) for c, v in SENSORS.items()}
    made |= {c: F.lit(float(i)) for i, c in enumerate(casting.LIMITS)} | {c: F.expr(f"cast({v} as bigint)") for c, v in CELLS.items()}
    return rows.select("id", F.lit(1).cast("bigint").alias("Product_Type"), F.col("shot").alias("Shot"), F.col("cycle_time").alias("Cycle_Time"), "source_row", *[v.alias(c) for c, v in made.items()])


def raw_process(spark, d: str) -> DataFrame:
    """The process log of the other line, with its constant and sparse columns."""
    o = st.table(spark, d, "orders")
    temps = {c: F.expr(f"cast(o_orderkey % {900 + 150 * i} as double)") for i, c in enumerate(casting.TEMPERATURES)}
    rest = {c: F.expr(f"cast(o_orderkey % {70 + i} as double)") for i, c in enumerate(("facility_CycleTime", "production_CycleTime", "mechanical_strength", "biscuit_thickness", "cooling_water_temp"))}
    dropped = {c: F.lit(1) for c in casting.P40_DROPPED}
    return o.select(
        F.col("o_orderkey").alias("source_row"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.date_format("o_orderdate", "HH:mm:ss").alias("date"),
        F.expr("case when o_orderkey % 50 = 0 then null else cast(600 + o_orderkey % 40 as double) end").alias("injection_pressure"),
        F.expr("case o_orderstatus when 'F' then 1D when 'O' then 0D end").alias("PassOrFail"), *[v.alias(c) for c, v in {**temps, **rest, **dropped}.items()],
    )


def timeline(spark, d: str) -> DataFrame:
    return casting.timeline_table(raw_timeline(spark, d))


def quality(spark, d: str) -> DataFrame:
    return casting.quality_table(raw_quality(spark, d))


_HISTORY = """(lag(cycle_time) over w)::double prev_cycle_time, max(cycle_time) over (partition by run_id order by source_row rows between 5 preceding and 1 preceding) max_cycle_previous_5,
  (case when row_number() over w = 1 then null else count(*) filter (where process_missing) over (partition by run_id order by source_row rows between 20 preceding and 1 preceding) end)::double missing_process_previous_20,
  (case when row_number() over w > 1 then greatest(shot - lag(shot) over w - 1, 0) end)::double missing_shots_before_current,
  (shot - max(case when status = 1 then shot end) over (partition by run_id order by source_row rows between unbounded preceding and 1 preceding))::double oracle_shots_since_warm,
  (select count(*) from epi e where e.run_id = tl.run_id and e.began < tl.source_row)::double oracle_prior_episodes"""
HIST = MQL + f", hl as (select tl.*, {_HISTORY} from tl window w as (partition by run_id order by source_row))"
_cell = lambda c: f"coalesce({CELLS[c]}, 0)".replace("base", "id")
_flag = lambda cells: "case when " + " or ".join(f"{_cell(c)} > 0" for c in cells) + " then 1 else 0 end"
_of = lambda types: [f"{t}_{k}" for t in types for k in (1, 2)]


@query(HIST + "select source_row, run_id, row_id, process_missing, gate_eligible, episode_id, " + ", ".join(casting.HISTORY) + " from hl")
def doc_timeline(spark, d: str) -> DataFrame:
    return timeline(spark, d).select("source_row", "run_id", "row_id", "process_missing", "gate_eligible", "episode_id", *casting.HISTORY)


@query(
    MQL + "select id::bigint id, source_row, run_id, row_id, (place - 1)::bigint shot_position, "
    + ", ".join(f"({_flag(c)})::bigint {n}" for n, c in [("y_defect", list(CELLS)), *[(f"y_cavity_{k}", [f"{t}_{k}" for t in casting.TYPES]) for k in (1, 2)], *[(f"y_type_{t}", _of([t])) for t in casting.TYPES], ("y_type_Etc", _of(casting.OTHER_TYPES))])
    + ", (" + " + ".join(_flag(_of([t])) for t in casting.TYPES) + ")::bigint defect_type_count, "
    + ", ".join(f"({v.replace('base', 'id')})::double {c}" for c, v in SENSORS.items()) + " from ql"
)
def doc_quality(spark, d: str) -> DataFrame:
    """Labels, positions and the six sensors with their nulls (P4); the limits are gone."""
    q = quality(spark, d)
    if set(casting.LIMITS) & set(q.columns):
        raise ValueError("constant limits are kept")
    made = ["y_defect", "y_cavity_1", "y_cavity_2", *[f"y_type_{t}" for t in casting.TYPES], "y_type_Etc", "defect_type_count"]
    return q.select("id", "source_row", "run_id", "row_id", "shot_position", *[F.col(c).cast("bigint").alias(c) for c in made], *casting.SENSORS)


@query(HIST + "select q.row_id, t.status::double Machine_Status, t.source_row source_row_m41, t.episode_id, " + ", ".join(f"t.{c}" for c in casting.HISTORY) + " from ql q left join hl t on t.run_id = q.run_id and t.shot = q.shot")
def doc_joined(spark, d: str) -> DataFrame:
    return casting.joined_table(quality(spark, d), timeline(spark, d)).select("row_id", "Machine_Status", "source_row_m41", "episode_id", *casting.HISTORY)


_TEMP = {c: f"(o_orderkey % {900 + 150 * i})" for i, c in enumerate(casting.TEMPERATURES)}


@query(
    "with p as (select *, case when o_orderkey % 50 = 0 then null else 600 + o_orderkey % 40 end pressure from orders) select o_orderkey source_row, 'p40_' || o_orderkey row_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') event_time, "
    + ", ".join(f"{v}::double {c}_raw, nullif({v}, 0)::double {c}, {v} > 1500 {c}_suspect_high" for c, v in _TEMP.items())
    + ", o_orderstatus in ('F', 'O') label_available, pressure > 615 normal_pressure, (case o_orderstatus when 'F' then 1 when 'O' then 0 end)::bigint y_defect from p"
)
def doc_process(spark, d: str) -> DataFrame:
    p = casting.process_table(raw_process(spark, d))
    temps = [x for c in casting.TEMPERATURES for x in (f"{c}_raw", c, f"{c}_suspect_high")]
    return p.select("source_row", "row_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), *temps, "label_available", "normal_pressure", F.col("y_defect").cast("bigint").alias("y_defect"))


CONTRACT = {
    "q42_A0": casting.PROCESS, "q42_A": [*casting.PROCESS, *casting.SENSORS, "Product_Type", "shot_position"],
    "m41_gate": [*casting.PROCESS, "prev_cycle_time", "max_cycle_previous_5"],
    "leaky": ["Cycle_Time", "Machine_Status", "oracle_prior_episodes", "absent_column"],
    "target_columns": ["y_*", "Machine_Status", "PassOrFail"], "forbidden": ["run_id", "source_row", "episode_id", "oracle_*"],
}


@query(MQL + f"""select * from (select 'q42_A0' list_name, {len(CONTRACT["q42_A0"])}::bigint n_inputs, 0::bigint n_violations, count(*)::bigint n_complete from ql
union all select 'q42_A', {len(CONTRACT["q42_A"])}, 0, count(*) filter (where {" and ".join(f"({v.replace('base', 'id')}) is not null" for v in SENSORS.values())}) from ql
union all select 'm41_gate', {len(CONTRACT["m41_gate"])}, 0, count(*) filter (where not process_missing and p is not null and m is not null) from (select *, lag(cycle_time) over (partition by run_id order by source_row) p, max(cycle_time) over (partition by run_id order by source_row rows between 5 preceding and 1 preceding) m from tl)
union all select 'leaky', 4, 3, null)""")
def contract_file(spark, d: str) -> DataFrame:
    """A contract file read back by Spark (S9) and held against the built tables (P21): per list, violations and rows with all inputs."""
    path = files.shared_folder(spark)
    spark.createDataFrame([(json.dumps(CONTRACT),)], "value string").write.text(path)
    lists = files.read_contract(spark, path)
    q, t = files.stored(quality(spark, d)), files.stored(timeline(spark, d))
    tables = {"q42_A0": q, "q42_A": q, "m41_gate": t, "leaky": t}
    bad = contract.check_contract(spark, lists, {k: df.columns for k, df in tables.items()}).groupBy("list_name").agg(F.count(F.lit(1)).alias("n_violations"))
    out = None
    for k, df in tables.items():
        whole = F.lit(None).cast("bigint")
        if set(lists[k]) <= set(df.columns):
            chosen = contract.select_inputs(df, lists, k, [])
            row = chosen.na.drop().agg(F.count(F.lit(1)).alias("n_complete"))
        else:
            row = spark.range(1).select(whole.alias("n_complete"))
        row = row.select(F.lit(k).alias("list_name"), F.lit(len(lists[k])).cast("bigint").alias("n_inputs"), "n_complete")
        out = row if out is None else out.unionByName(row)
    return out.join(bad, "list_name", "left").select("list_name", "n_inputs", F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"), "n_complete")


@query(TL + "select source_row, (row_number() over (order by source_row) - 1)::bigint place, cycle_time from tl")
def ordered_parquet(spark, d: str) -> DataFrame:
    """Written in order (O2), read back: the place in the files is the place in the order."""
    path = files.shared_folder(spark)
    ordered.keep_order(st.raw_timeline(spark, d), "source_row").write.parquet(path)
    return files.with_source_row(spark.read.parquet(path), "place").select("source_row", "place", "cycle_time")


# --- accounts of the pass that writes, totals, stored tables -------------------------------------------------

_BEFORE = {c: v.replace("base", "(id % 1000000000)") for c, v in {**SENSORS, **CELLS}.items()}
_both = lambda c, cond: f"select '{c}' column_name{{more}}, (select count(*) filter (where {cond}) from qr)::bigint n_before, (select count(*) filter (where {cond}) from ql)::bigint n_after"


def _runs(spark, d: str) -> DataFrame:
    return files.stored(ordered.segment_on_decrease(raw_quality(spark, d), "source_row", "Shot"))


def _dedup(df: DataFrame) -> DataFrame:
    return ordered.dedup_keep_first(df, ["run_id"], ["id"], "source_row")


def _writer(spark):
    path = files.shared_folder(spark)
    return lambda df: df.write.parquet(path)


@query(MQL + "select * from (" + " union all ".join(_both(c, f"({_BEFORE[c]}) is null").format(more="") for c in SENSORS) + ")")
def doc_null_account(spark, d: str) -> DataFrame:
    """Missing sensor values before and after repeats go (A4), counted while the rows are written."""
    return report.null_account(_runs(spark, d), _dedup, list(SENSORS), _writer(spark))


@query(MQL + "select * from (" + " union all ".join(_both(c, f"({_BEFORE[c]}) = {v}").format(more=f", {v}::bigint as value") for c in CELLS for v in (2, 3)) + ") where n_before > 0 or n_after > 0")
def doc_cell_account(spark, d: str) -> DataFrame:
    """Defect cells of 2 and 3 before and after repeats go."""
    return report.cell_account(_runs(spark, d), _dedup, list(CELLS), 2, 3, _writer(spark))


@query(MQL + "select status::double status, process_missing missing, grouping(status, process_missing)::int as level, count(*)::bigint n from tl group by grouping sets ((status, process_missing), (status), (process_missing), ())")
def doc_status_totals(spark, d: str) -> DataFrame:
    """Status by completeness with all totals, from one aggregate."""
    return report.status_totals(timeline(spark, d), "Machine_Status", "process_missing")


_STORED = {"source_row": "bigint not null", "run_id": "bigint not null", "row_id": "string not null", "process_missing": "boolean not null", "Machine_Status": "double", "Cycle_Time": "double"}


@query(MQL + "select source_row, run_id, row_id, process_missing, status::double Machine_Status, cycle_time Cycle_Time, 0::bigint n_problems, 3::bigint n_planted from tl")
def doc_schema_contract(spark, d: str) -> DataFrame:
    """A table written with its declared types, without missing values where none are allowed, and read back with checked footers.

    ``n_planted`` counts what is found if the file is held against a declaration with another type, another name and one more.
    """
    path = files.shared_folder(spark)
    files.write_table(timeline(spark, d), path, _STORED)
    other = {c: t for c, t in _STORED.items() if c not in ("run_id", "Cycle_Time")} | {"run_id": "int", "Cycle": "double"}
    found = files.footer_problems(spark, path, other).groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).count()
    clean = files.footer_problems(spark, path, _STORED).count()
    kinds = ", ".join(f"{c} {t.removesuffix(' not null')}" for c, t in _STORED.items())
    read = files.read_table(spark, path, kinds, checked=True)
    return read.withColumns({"n_problems": F.lit(clean).cast("bigint"), "n_planted": F.lit(found).cast("bigint")})


@query(HIST + "select q.row_id, t.status::double Machine_Status, t.source_row source_row_m41, t.episode_id, " + ", ".join(f"t.{c}" for c in casting.HISTORY) + " from ql q left join hl t on t.run_id = q.run_id and t.shot = q.shot")
def doc_joined_stored(spark, d: str) -> DataFrame:
    """``doc_joined`` over tables stored in buckets of run and shot, sorted: the join needs no exchange."""
    q, t = (files.store_bucketed(df, ["run_id", "Shot"]) for df in (quality(spark, d), timeline(spark, d)))
    return casting.joined_table(q, t).select("row_id", "Machine_Status", "source_row_m41", "episode_id", *casting.HISTORY)
