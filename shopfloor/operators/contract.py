"""Model inputs only by named lists, checked against targets and forbidden columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select_inputs(df: DataFrame, contract: dict, key: str, keep: list[str]) -> DataFrame:
    """``keep`` and the columns of one list, in order (P20); never by numeric type."""
    return df.select(*keep, *contract[key])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named columns."""
    return df.drop(*names)


def check_contract(spark: SparkSession, contract: dict, schemas: dict[str, list[str]]) -> DataFrame:
    """``(list_name, column_name, problem)``: inputs that hit a target or forbidden pattern, or are not in the schema.

    ``schemas`` gives the columns of the table that each list is for; ``*`` in a pattern stands for any text (P21).
    """
    inputs = spark.createDataFrame([(k, c) for k in schemas for c in contract[k]], "list_name string, column_name string")
    banned = [("target", p) for p in contract["target_columns"]] + [("forbidden", p) for p in contract["forbidden"]]
    patterns = spark.createDataFrame(banned, "problem string, pattern string").withColumn("regex", F.concat(F.lit("^"), F.replace("pattern", F.lit("*"), F.lit(".*")), F.lit("$")))
    hits = inputs.join(F.broadcast(patterns), F.expr("column_name rlike regex")).select("list_name", "column_name", "problem")
    known = spark.createDataFrame([(k, c) for k, cols in schemas.items() for c in cols], "list_name string, column_name string")
    absent = inputs.join(known, ["list_name", "column_name"], "left_anti").withColumn("problem", F.lit("not in table"))
    return hits.unionByName(absent).distinct()
