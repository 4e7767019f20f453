"""Process tables made from the star schema: a timeline and quality rows from ``events``, defect cells from
``lineitem``, and a process log from ``orders``."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import ordered
from ..sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_row, shot, ts, status, cycle_time``: the counter restarts daily, views are gaps, one day is cut short."""
    day = F.to_date("ts")
    e = table(spark, sf_dir, "events").withColumn("shot", F.row_number().over(Window.partitionBy(day).orderBy("event_id")).cast("bigint"))
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 1).when((F.col("event_type") == "signup") & (k < 50), None).otherwise(0)
    cut = (day == F.lit("2024-01-06").cast("date")) & (F.col("shot") > 30)
    e = e.where((F.col("event_type") != "view") & ~cut)
    return e.select(F.col("event_id").alias("source_row"), "shot", "ts", status.cast("int").alias("status"), F.when(F.col("value") >= 5, F.col("value")).alias("cycle_time"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.segment_on_decrease(raw_timeline(spark, sf_dir), "source_row", "shot")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline with runs, ids, eligibility, episodes and history; scans read the stored runs, not their plan twice."""
    kept = files.stored(runs(spark, sf_dir))
    out = kept.withColumns({
        "row_id": fn.row_id("m41", ("r", "run_id"), ("s", "shot")),
        "process_missing": fn.any_null(["cycle_time"]), "gate_eligible": fn.eligible("status", ["cycle_time"]),
    })
    return ordered.history_blocked(out, ["run_id"], "source_row", "shot", "status", "cycle_time", "process_missing", rows=kept.count())


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, shot, cycle_time, source_row`` with exact repeats (other id) right after every third position."""
    base = raw_timeline(spark, sf_dir).where((F.col("status") == 0) & F.col("cycle_time").isNotNull())
    one = base.select(F.col("source_row").alias("id"), "shot", "cycle_time", (F.col("source_row") * 2).alias("source_row"))
    again = base.where(F.col("source_row") % 3 == 0).select((F.col("source_row") + 1_000_000_000).alias("id"), "shot", "cycle_time", (F.col("source_row") * 2 + 1).alias("source_row"))
    return one.unionByName(again)


def quality_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.segment_on_decrease(raw_quality(spark, sf_dir), "source_row", "shot")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rows without repeats, with ids, positions and a label (cycle times of 90 and more)."""
    out = files.stored(ordered.dedup_keep_first(quality_runs(spark, sf_dir), ["run_id"], ["id"], "source_row"))
    out = out.withColumn("row_id", fn.row_id("q42", ("r", "run_id"), ("s", "shot")))
    out = ordered.with_position(out, ["run_id"], "source_row")
    return out.withColumn("y_defect", (F.col("cycle_time") >= 90).cast("int"))


CELLS = {
    "Chip_1": "cast(round(l_discount * 100) as int) % 3", "Chip_2": "cast(round(l_tax * 100) as int) % 3",
    "Void_1": "l_linenumber % 2", "Void_2": "cast(l_suppkey % 4 as int)",
    "Mark_1": "cast(l_partkey % 3 as int)", "Mark_2": "case when l_returnflag = 'R' then 1 else 0 end",
    "Bend_1": "cast(l_quantity as int) % 2", "Bend_2": "case when l_linestatus = 'O' then null else 0 end",
}
TYPES, MAIN = ["Chip", "Void", "Mark", "Bend"], ["Chip", "Void"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defect cells 0..3 (one may be null) of four types in two cavities."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(v).alias(k) for k, v in CELLS.items()])


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_row, row_id, event_time, price_raw, price, price_suspect_high, label, label_available, y_defect``."""
    o = table(spark, sf_dir, "orders")
    out = o.select(F.col("o_orderkey").alias("source_row"), fn.row_id("p40", ("", "o_orderkey")).alias("row_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).cast("double").alias("label"))
    out = fn.mask_and_flag(out, ["price"], 10000, 450000)
    return out.withColumns({"label_available": F.col("label").isNotNull(), "y_defect": fn.nullable_label("label"), "normal_price": fn.threshold_flag("price", 200000)})
